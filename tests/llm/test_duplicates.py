"""Repeats, contamination, near copies and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from scenelake.llm import components, decontaminate, exchange, near_duplicates, repeats  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long, answers string, value string"
low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "v") for i, t in rows], DDL).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(40)
    out = [(i, text(rng.randint(0, 120))) for i in range(40)]
    out += [(100 + i, f"{text(10)} {passage} {text(10)}") for i in range(20)]
    base = text(80).split(" ")
    for i in range(60):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, "aaaa " * rng.randint(5, 40)) for i in range(6)]
    out += [(400, None), (401, ""), (402, "one"), (403, "One"), (404, "two words"), (405, passage[:49]), (406, passage[:50]), (407, passage[1:52])]
    out += [(500 + i, out[k][1]) for i, k in enumerate(range(0, 100, 7))]
    rng.shuffle(out)
    return out


def brute_repeats(rows, width):
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    least: dict = {}
    for i, b in texts:
        for k in range(len(b) - width + 1):
            least.setdefault(b[k : k + width], i)
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out[i] = (bytes(c for c, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), [m.span() for m in re.finditer(b"\1+", bytes(gone))])
    return out


@pytest.mark.parametrize(("block", "hot"), [(1 << 23, 1 << 16), (600, 1 << 16), (600, 5)])
def test_repeats(spark, rows, monkeypatch, block, hot):
    """Also with small blocks, and with anchors dealt window by window."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", 128 if block == 600 else repeats.CHUNK)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, [tuple(s) for s in r.spans]) for r in repeats.cut(frame(spark, rows)).collect()}
    want = brute_repeats(rows, 50)
    assert {i: got[i] for i in want if got[i] != want[i]} == {}
    assert sum(w[2] for w in want.values()) > 1000


def test_repeats_of_odd_rows(spark):
    same = "x" * 60 + "y" * 60
    df = frame(spark, [(1, same), (1, same), (None, same), (2, same), (3, None)])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in repeats.cut(df).collect()))
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 120), (False, 3, 0), (True, 0, 120)]
    assert repeats.cut(df.limit(0)).count() == 0
    cut = "é" * 40  # 80 bytes, of which a window may begin within a character
    out = repeats.without_repeats(frame(spark, [(1, "a" + cut), (2, cut + "b")])).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in out} == {1: ("a" + cut, 41), 2: ("b", 1)}
    assert repeats.without_repeats(df).columns == df.columns
    clash = df.select(*df.columns, *(F.lit(k).alias(c) for k, c in enumerate(("kept", "n_bytes", "n_removed", "spans", "others", "rest"))))
    rows = repeats.without_repeats(clash).collect()
    assert repeats.without_repeats(clash).columns == clash.columns and {(r.kept, r.spans, r.others, r.rest) for r in rows} == {(0, 3, 4, 5)}
    long = "".join(f"{k} " for k in range(300_000))
    got = {r.doc_id: r.n_removed for r in repeats.cut(frame(spark, [(1, long), (2, long[1000:2_000_000]), (3, "z" * 3_000_000)])).collect()}
    assert got == {1: 0, 2: len(long[1000:2_000_000]), 3: 0}


def test_repeats_put_no_stretches_to_tables(spark, tmp_path, monkeypatch):
    """What is left in the shared folder beside the blocks' files is far less than the text that repeats; anchors travel without what their bucket says."""
    monkeypatch.setattr(exchange, "workdir", lambda _: f"file://{tmp_path}/work")
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 40_000)
    rng = random.Random(47)
    passages = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)) for _ in range(60)]
    got = {r.doc_id: r.n_removed for r in repeats.cut(frame(spark, [(i, f"{i} {passages[i % 60]}") for i in range(120)])).collect()}
    assert all(got[i] >= 2000 if i >= 60 else got[i] == 0 for i in range(120))
    assert sum(f.stat().st_size for f in (tmp_path / "work").glob("*/*.parquet")) < 60_000
    block = repeats._Block()
    block.value, block.docs = np.arange(0, 70_000, 7, dtype=np.uint64), lambda: np.zeros(10_000, np.int64)
    gaps = {b: exchange.unpack(x)[0] for b, x in block.anchors(100)}
    assert sorted(int(v) * 100 + b for b, x in gaps.items() for v in np.cumsum(x, dtype=np.uint64)) == block.value.tolist()


def brute_overlap(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for i, t in items:
        w = word.findall(low(t or ""))
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = Counter()
    for i, t in rows:
        w, hit, found = word.findall(low(t or "")), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out[i, len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize(("block", "limit"), [(1 << 23, 1 << 23), (500, 200)])
def test_decontamination(spark, rows, monkeypatch, block, limit):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", block)
    monkeypatch.setattr(decontaminate, "SET_BYTES", limit)
    texts = [t for _, t in rows if t]
    items = [(0, texts[3]), (1, texts[5][:40].upper()), (2, None), (3, ""), (4, "..."), (5, "one"), (6, "two words"), (11, texts[3]), (7, " ".join(texts[9].split()[:10]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    df = frame(spark, [*rows, (None, texts[3]), (402, "one")])
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.overlaps(df, bench).collect())
    want = brute_overlap([*rows, (None, texts[3]), (402, "one")], items)
    assert got == want and any(k[2] for k in want)
    clean = decontaminate.without_overlaps(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    assert decontaminate.overlaps(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0


def brute_groups(rows, shingle):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append((i, frozenset(zip(*[w[k:] for k in range(shingle)], strict=False)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("shingle", "most", "cell", "block"), [(2, 4096, 512, 1 << 23), (2, 5, 3, 2000), (5, 3, 512, 1 << 23)])
def test_near_copies(spark, rows, monkeypatch, shingle, most, cell, block):
    """Also with lists in pieces, cells of a few documents and small blocks."""
    monkeypatch.setattr(near_duplicates, "LIST", most)
    monkeypatch.setattr(near_duplicates, "CELL_DOCS", cell)
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", block)
    monkeypatch.setattr(near_duplicates, "FOLLOWERS", cell)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.groups(frame(spark, rows), shingle).collect())
    want = brute_groups(rows, shingle)
    assert got == want
    assert Counter(k[2] for k in want).most_common(1)[0][1] > 10


def test_sets_are_kept_as_texts(spark, tmp_path):
    """Blocks' files are far smaller than the hashes of all shingles, tables that nothing reads any more are gone, and sets come back whole."""
    rng = random.Random(53)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(40)]
    rows = [(i, texts[i % 40] + " end" * (i // 40)) for i in range(80)] + [(90, None), (91, "é One"), (92, "É one")]
    folder = f"file://{tmp_path}/groups"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.groups(frame(spark, rows), 2, folder=folder).collect()}
    assert all(got[i][1] == i % 40 for i in range(80)) and got[90] == (0, 90) and got[91] == (1, 91) and got[92] == (1, 92)
    files = [f for f in (tmp_path / "groups" / "sets").iterdir() if not f.name.startswith(".")]
    assert sum(f.stat().st_size for f in files) < 4 * sum(n for n, _ in got.values())
    assert not (tmp_path / "groups" / "messages").exists() and not (tmp_path / "groups" / "postings").exists()
    of = {}
    for f in files:
        block = near_duplicates.Block.read(folder, int(f.name), True)
        at = np.arange(len(block.size))[::-1].repeat(2)
        for k, whole, least in zip(at, block.sets(at, True), block.sets(at, False), strict=True):
            of[int(block.head["least"][k])] = whole
            assert len(whole) == 8 * block.size[k] and least == whole[: 8 * 64]
    for i in (3, 45, 91):
        text = dict(rows)[i]
        assert of[i] == near_duplicates.shingle_hashes(pa.array([text]), 2)[0].tobytes()


def test_near_copies_of_odd_rows(spark):
    df = frame(spark, [(5, "a b c"), (5, "a b c"), (9, "A b  c"), (None, "a b c"), (6, None), (7, ""), (8, None)])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_duplicates.groups(df, 2).collect())
    assert got == [(False, 5, 5), (False, 5, 5), (False, 6, 6), (False, 7, 7), (False, 8, 8), (False, 9, 5), (True, 0, 5)]
    assert near_duplicates.groups(df.limit(0), 2).count() == 0
    left = near_duplicates.without_near_copies(df, 2)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [5, 5, 6, 7, 8]
    clash = df.select("lang", *(F.lit(k).alias(c) for k, c in enumerate(("row", "block", "at", "component_id", "text_hash"))), "text", "doc_id", F.lit(None).cast("string").alias("none"))
    rows = near_duplicates.without_near_copies(clash, 2)
    assert rows.columns == clash.columns and rows.schema.simpleString() == clash.schema.simpleString()
    assert Counter((r.doc_id, r.text, r.lang, r.row, r.block, r["at"], r.component_id, r.text_hash, r.none) for r in rows.collect()) == Counter({(i, t, "en", 0, 1, 2, 3, 4, None): n for i, t, n in [(5, "a b c", 2), (6, None, 1), (7, "", 1), (8, None, 1)]})
    assert near_duplicates.without_near_copies(clash.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        near_duplicates.groups(df, 2, 70, 100)


def test_cell_links_join_what_is_similar():
    """A star of dissimilar neighbours and a group of similar ones: fewer links than documents, the same components."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(1000, 100, False)).astype("<u8") for _ in range(3)]
    sets += [np.sort(np.append(np.delete(sets[0], k), 2000 + k)).astype("<u8") for k in range(40)]
    n = len(sets)
    rid, asks = np.tile(np.arange(n), 2), np.repeat([True, False], n)
    links = near_duplicates.cell_links(rid, rid, asks, sets * 2, 80, 100)
    assert len(links) == 40 and {x for link in links for x in link} == {0, *range(3, n)}


def test_estimates():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 150, 100).astype("<u8")) for _ in range(2))
    got = near_duplicates.estimates([a[:64]], [b[:64]])[0]
    union = np.union1d(a, b)[:64]
    assert got == pytest.approx(len([v for v in union if v in a and v in b]) / len(union))


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(df, exchange.workdir(spark)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


def test_radix_groups():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(400 - 9)
    alive, group = repeats.radix_groups(data, starts, 9)
    want: dict = {}
    for s in starts:
        want.setdefault(data[s : s + 9].tobytes(), []).append(int(s))
    got: dict = {}
    for a, g in zip(alive.tolist(), group.tolist(), strict=True):
        got.setdefault(g, []).append(a)
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


EXTRA = ("score", "quality_score", "kept", "n_bytes", "spans", "row", "value", "block")


def written(spark, folder, rows, labels, items):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(EXTRA)))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_equals_its_stages_by_hand(spark, rows, tmp_path):
    """Also null and empty texts, rows that repeat, and columns with the names of results."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    junk = [(1000 + i, " ".join(f"{rng.choice('ABCDEF')}{rng.choice('XYZ')}!!" for _ in range(60))) for i in range(80)]
    everything = [*rows, rows[3], *junk]
    folder = str(tmp_path)
    item = next(t for i, t in rows if t and len(t.split()) > 30 and 0 <= i < 40)
    df = written(spark, folder, everything, [(i, int(i < 1000), 0) for i, t in everything if i >= 1000 or t and len(t) > 30], [(1, item), (2, None)])
    assert all(stage(spark, df, folder).columns == df.columns for _, stage in pipeline.STAGES[:4])
    out = Counter((r.doc_id, r.text) for r in pipeline.run(spark, folder).collect())
    scored = [(r.doc_id, r.text) for r in pipeline.quality(spark, df, folder).collect()]
    assert not Counter(scored) - Counter(everything) and sum(i >= 1000 for i, _ in scored) <= 4
    assert {i for i, t in rows if t and len(t) > 30} <= {i for i, _ in scored}
    heads = {k[0] for k in brute_groups(scored, 5) if k[0] == k[2]}
    kept = [(i, t) for i, t in scored if i in heads]
    cut = {i: v[0].decode(errors="ignore") for i, v in brute_repeats(kept, 50).items()}
    dirty = {k[0] for k in brute_overlap(list(cut.items()), [(1, item)]) if k[2]}
    assert out == Counter((i, cut[i]) for i, _ in kept if i not in dirty)


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    written(spark, f"{tmp_path}/none", [], [], [])
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    text = " ".join(f"w{k}" for k in range(30))  # every document goes on the way
    written(spark, f"{tmp_path}/all", [(1, text), (2, text), (3, text + " x")], [], [(1, text)])
    assert pipeline.run(spark, f"{tmp_path}/all").count() == 0

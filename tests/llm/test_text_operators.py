"""Encoding, counting, files, archives, rules and scores against plain versions, on rows that are hard."""

import base64
import hashlib
import math
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from scenelake.llm import bpe, classifier, exchange, language_model, quality_rules, splitting, token_counts, token_files, vocab, web_archives  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "It's we'll they've I'd don't 'tis 's", "tab\tand\r\nlines\n\n\n x", "Größe naïve 中文字 ٣٤ 😀😀 é", "<|endoftext|> a<|endoftext|>b <|endof text|>", "</s> <s> <unk> ▁x ▁ y",
    "a" * 300, "the same words the same words", "the same words the same words", "x  y z", "\u0085　 end  ", "1234567 3.14 #$%&*|<>",
]
DDL = "doc_id long, text string, lang string, n_chars long, score double, block string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "".join(rng.choice(["a", "B", "'s", " ", "  ", "\n", "é", "1", "!", "中", " the", "<|endoftext|>"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(7, "a repeated id"), (None, "no id"), (500, "word " * 20000), (-5, "below zero")]
    return spark.createDataFrame([(i, t, "en", 1, 0.5, "b") for i, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_special_classes_follow_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    rng = random.Random(5)
    table = splitting._classes()
    for c in [*range(0x250), *(rng.randrange(0x250, 0x30000) for _ in range(3000))]:
        if 0xD800 <= c < 0xE000:
            continue
        spans = [x[1] for x in split(f"a{chr(c)}1!")]
        kind = splitting.LETTER if (0, 2) in spans else splitting.NUMBER if (1, 3) in spans and table[c] == splitting.NUMBER else None
        assert kind is None or table[c] == kind, hex(c)


def test_every_entry_of_the_vocabulary_is_itself():
    """What the equality of rank merges and the library's merges rests on."""
    v = vocab.ByteBpe(vocab.read(BPE))
    assert v.by_rank and all(v.encode([piece]) == [[k]] for piece, k in v.ranks.items())


def test_encode_and_decode(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    got = bpe.decode(bpe.encode(docs, BPE), BPE).collect()
    want = Counter()
    for i, t in pairs(docs):
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.text) for r in got) == want
    assert bpe.decode(bpe.encode(empty, BPE), BPE).count() == 0


def test_decode_of_broken_ids(spark):
    tok = vocab.ByteBpe(vocab.read(BPE))
    half = tok.encode(["é".encode()[:1]])[0]
    df = spark.createDataFrame([(1, bytearray(np.array(half, "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in bpe.decode(df, BPE).collect()} == {1: "�", 2: None}


def test_token_counts(docs, empty):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, PIECES).collect())
    assert got == Counter((i, len(t.encode()), len(sp.encode(t))) for i, t in pairs(docs))
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_rank_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.integers(0, 1 << rng.integers(1, 33), n, dtype=np.uint64).astype(np.uint32)
        control, data = token_files.encode_ranks(x)
        assert (token_files.decode_ranks(control, data, n) == x).all()
    with pytest.raises(ValueError):
        token_files.read_shard(__file__)


def test_token_files(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SHARD_IDS", 5000)
    tok = Tokenizer.from_file(BPE)
    manifest = token_files.write(docs, BPE, exchange.workdir(spark))
    assert manifest.count() > 1
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read(spark, manifest).collect()), key=lambda r: r[2])
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)
    start = 0
    for g in got:
        assert g[2] == start and g[3] * 4 == len(g[4])
        start += g[3]
    want = Counter((i, np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in pairs(docs))
    assert Counter((g[1] if g[0] else None, g[4]) for g in got) == want
    assert token_files.read(spark, token_files.write(empty, BPE, exchange.workdir(spark))).count() == 0


def test_archives(spark):
    rows = [(1, "u1", "<p>same</p>"), (2, "u2", "<p>other é</p>"), (3, None, "<p>same</p>"), (4, "u4\r\nX: y", None), (5, "u5", ""), (0, "u0", "<p>same</p>\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    listed = web_archives.write(pages, exchange.workdir(spark), package_bytes=20)
    assert listed.count() > 1
    got = {r.page_id: r for r in web_archives.read(spark, listed).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload == (body if i == first else None)
    paths = [r.path.removeprefix("file://") for r in listed.collect()]
    with zipfile.ZipFile(paths[0]) as z:
        assert z.testzip() is None and sorted(z.namelist()) == [web_archives.ARCHIVE, web_archives.INDEX]
    assert web_archives.read(spark, web_archives.write(pages.limit(0), exchange.workdir(spark))).count() == 0
    large = web_archives.with_referents(pages, least=12).filter("refers_to is not null").count()
    assert large == 0


def test_archives_of_repeated_and_null_ids(spark):
    """Each row gives a record, and each payload is stored once."""
    rows = [(3, "A"), (4, "B"), (5, "A"), (5, "B"), (6, "A"), (6, "C"), (7, "D"), (7, "D"), (7, "D"), (None, "A"), (None, "E"), (None, "E"), (8, "long " * 200_000)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").repartition(4)
    got = web_archives.read(spark, web_archives.write(pages, exchange.workdir(spark))).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    stored = Counter(bytes(r.payload).decode() for r in got if r.record_type == "response")
    assert stored == {"A": 1, "B": 1, "C": 1, "D": 1, "E": 2, "long " * 200_000: 1}
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds[5, "revisit", 3] == kinds[5, "revisit", 4] == kinds[6, "revisit", 3] == kinds[6, "response", None] == 1
    assert kinds[7, "response", None] == 1 and kinds[7, "revisit", 7] == 2 and kinds[None, "revisit", 3] == 1 and kinds[None, "response", None] == 2


def test_rows_of_one_page_are_spread(spark, monkeypatch):
    """Half of the rows have one page_id and payload, in part one url; no task gets more than a few times the mean."""
    monkeypatch.setattr(web_archives, "REPEATED", 50)
    monkeypatch.setattr(web_archives, "HOT_BYTES", 2000)
    monkeypatch.setattr(exchange, "deal", lambda *_: 16)
    rows = [(-1, None if i % 5 == 0 else "u" if i % 3 else f"v{i}", "hot") for i in range(3000)] + [(i, "u", f"cold {i % 2500}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    dealt = web_archives.with_referents(pages)
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) <= 1000
    got = web_archives.read(spark, web_archives.write(pages, exchange.workdir(spark))).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((i, u or "about:blank") for i, u, _ in rows)
    assert [r.url for r in got if r.page_id == -1 and r.record_type == "response"] == ["u"]
    assert all((r.payload_bytes, r.payload_digest, r.refers_to) == (3, base64.b32encode(hashlib.sha1(b"hot").digest()).decode(), None if r.record_type == "response" else -1) for r in got if r.page_id == -1)
    assert all(r.refers_to == (r.page_id - 2500 if r.page_id >= 2500 else None) for r in got if r.page_id >= 0)


def test_token_files_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else i, f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(4)
    parts = Counter()
    for r in token_files.write(docs, BPE, exchange.workdir(spark)).collect():
        parts[r.part] += r.n_docs
    assert sum(parts.values()) == 4000 and max(parts.values()) <= 3 * 4000 / len(parts)


def test_zip64(tmp_path):
    path = tmp_path / "a.wacz"
    with path.open("wb") as out:
        w = web_archives.PackageWriter(out, zip64_from=10)
        w.add("archive/x", b"x" * 50)
        w.add("indexes/y", b"y" * 5)
        w.close()
    with zipfile.ZipFile(path) as z:
        assert z.read("archive/x") == b"x" * 50 and z.read("indexes/y") == b"y" * 5
    p = web_archives.Package(str(path))
    assert {k: n for k, (_, n) in p.members.items()} == {"archive/x": 50, "indexes/y": 5}
    p.close()


def test_rules(spark, docs, empty):
    rng = random.Random(1)
    lines = ["one two three four five six seven eight", "x y", " ", "", "#1 $2"]
    rows = [(1000 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r)[:6] for r in quality_rules.judged(both, np.zeros(quality_rules.BUCKETS)).collect())
    want = Counter()
    for i, t in pairs(both):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(cover)] += 1
    assert got == want
    assert quality_rules.judged(empty, np.zeros(quality_rules.BUCKETS)).count() == 0


def test_ratio_tells_target_from_junk(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["stone", "river", "over", "under", "light"]) for _ in range(60)) for _ in range(40)]
    junk = [" ".join(rng.choice(["ZZQ!!", "XXK!!", "QQV!!"]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    trusted = df.filter("doc_id < 20").select("doc_id")
    ratios = quality_rules.fit(df, trusted)
    got = {r.doc_id: r.score for r in quality_rules.judged(df, ratios).collect()}
    assert min(got[i] for i in range(40)) > 0 > max(got[i] for i in range(40, 80))
    assert not quality_rules.fit(df, trusted.limit(0)).any()


def test_ratio_is_the_plain_one_and_equal_for_equal_texts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc de\u00e9") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["the same text again"] * 300
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(1)
    ratios = quality_rules.fit(df, df.filter("doc_id < 20").select("doc_id"))

    def slot(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 + c) & 0xFFFFFFFF
        h ^= h >> 15
        return ((h * 0x2C1B3C6D) & 0xFFFFFFFF) >> 16 & quality_rules.BUCKETS - 1

    grams = [[slot(t.encode()[k : k + 4]) for k in range(len(t.encode()) - 3)] for t in texts]
    corpus, target = Counter(g for x in grams for g in x), Counter(g for x in grams[:20] for g in x)
    n, m = sum(corpus.values()), sum(target.values())
    ratio = lambda g: math.log((target[g] + quality_rules.PRIOR * corpus[g] / n) / (m + quality_rules.PRIOR) / (corpus[g] / n))
    for parts in (1, 7):
        got = {r.doc_id: r for r in quality_rules.judged(df.repartition(parts), ratios).collect()}
        for i, x in enumerate(grams):
            assert got[i].score == pytest.approx(sum(map(ratio, x)) / max(len(x), 1), rel=1e-9, abs=1e-12)
            assert got[i].kept == (not got[i].base_failed and got[i].score >= quality_rules.THRESHOLD)
        assert len({got[i].score for i in range(60, 360)}) == 1


def test_classifier_learns_and_scores(spark, docs, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "ren"]) for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(rng.randint(20, 60))) + "." for _ in range(120)]
    junk = [" ".join(word().upper() + "!!" for _ in range(40)) for _ in range(60)] + [" ".join([word()] * 50) for _ in range(60)]
    df = spark.createDataFrame([(i, t, int(i < 120)) for i, t in enumerate(good + junk)], "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").filter("doc_id % 3 <> 1")
    model = classifier.fit(df.drop("quality"), labels)
    got = {r.doc_id: r.score for r in classifier.scored(df.select("doc_id", "text"), model).collect()}
    held = [i for i in range(240) if i % 3 == 1]
    assert sum((got[i] >= 0.5) == (i < 120) for i in held) / len(held) > 0.95
    words = pa.array([b"a", b"", b"two", b"three\xc3\xa9", b"x" * 30], pa.binary())
    feature, at = classifier.word_features(words)
    weights = np.random.default_rng(0).random(classifier.BUCKETS)
    total, many = classifier.word_sums(words, weights)
    assert (many == np.diff(at)).all() and total == pytest.approx([weights[feature[x:y]].sum() for x, y in zip(at[:-1], at[1:], strict=True)])
    again = classifier.fit(df.drop("quality").repartition(5), labels)
    assert (again.weights == model.weights).all()
    scored = classifier.scored(docs, model)
    rows = scored.collect()
    assert sorted(scored.columns) == sorted(docs.columns) and len(rows) == docs.count()
    for r in rows:  # a plain mean over the features of the text, one by one
        text = (r.text or "").encode()
        own = [w for w in re.split(rb"[\x20\x09-\x0D]+", text) if w]
        sums, n = 0.0, 0
        for k, w in enumerate(own):
            one, _ = classifier.word_features(pa.array([w], pa.binary()))
            two = pa.array(own[max(k - 1, 0) : k + 1], pa.binary())
            pair = classifier.pairs(two, np.arange(len(two)), np.array([0, len(two)]))[-1]
            back = next((j for j in range(1, k + 1) if own[k - j] == w), 0)
            slot = classifier.BUCKETS + (min(math.ceil(math.log2(back)) + 1, classifier.DISTANCES - 1) if back else 0)
            sums += model.weights[one].sum(dtype=np.float64) + model.weights[pair] + model.weights[slot]
            n += len(one) + 2
            if n > 20000:
                break
        if n <= 20000:
            assert r.score == pytest.approx(1 / (1 + math.exp(-(model.bias + sums / (n + classifier.PRIOR)))), rel=1e-4)
    assert classifier.scored(empty, model).count() == 0
    assert classifier.scored(docs, model, "quality_score").columns == [*docs.columns, "quality_score"]
    assert classifier.fit(df.drop("quality"), labels.limit(0)).bias == 0


@pytest.mark.parametrize(("most", "size"), [(0, 1 << 15), (2, 4), (7, 1 << 15)])
def test_katz_model(spark, docs, empty, most, size):
    rows = docs.filter("doc_id is not null and doc_id <> 7")
    train = F.pmod("doc_id", F.lit(8)) >= most
    got = {r.doc_id: r for r in language_model.scores(rows, train, size).collect()}
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "\n"] for i, t in pairs(rows)}
    learned = [i for i in tokens if i % 8 >= most]
    one = Counter(w for i in learned for w in tokens[i])
    two = Counter(p for i in learned for p in zip([" ", *tokens[i]], tokens[i], strict=False))
    total, many, history, after = sum(one.values()), len(one), Counter(), defaultdict(list)
    for (h, w), c in two.items():
        history[h] += c
        after[h].append((w, c))
    d1 = language_model.discounts(np.array([0, *(sum(c == r for c in one.values()) for r in range(1, 7))]))
    d2 = language_model.discounts(np.array([0, *(sum(c == r for c in two.values()) for r in range(1, 7))]))
    cut = lambda d, c: (d[c] if c <= 5 else 1) * c
    left = sum(c - cut(d1, c) for c in one.values())
    n1 = total + (0 if left > 1e-12 else 1)
    unknown = (left if left > 1e-12 else 1) / n1
    p1 = lambda w: cut(d1, one[w]) / n1 if one[w] else unknown
    assert sum(map(p1, one)) + unknown == pytest.approx(1)
    back, whole = {}, {}
    for h, l in after.items():
        rest = sum(c - cut(d2, c) for _, c in l)
        whole[h] = history[h] + (0 if rest > 1e-12 else 1)
        back[h] = (rest if rest > 1e-12 else 1) / whole[h] / (1 - sum(p1(w) for w, _ in l))
        assert sum(cut(d2, c) for _, c in l) / whole[h] + back[h] * (1 - sum(p1(w) for w, _ in l)) == pytest.approx(1)
    p2 = lambda h, w: cut(d2, two[h, w]) / whole[h] if two[h, w] else back.get(h, 1) * p1(w)
    three, follow = Counter(x for i in learned for x in zip([" ", *tokens[i]], tokens[i], tokens[i][1:], strict=False)), defaultdict(list)
    for (u, v, w), c in three.items():
        follow[u, v].append((w, c))
    d3 = language_model.discounts(np.array([0, *(sum(c == r for c in three.values()) for r in range(1, 7))]))
    back3, whole3 = {}, {}
    for h, l in follow.items():
        rest = sum(c - cut(d3, c) for _, c in l)
        whole3[h] = two[h] + (0 if rest > 1e-12 else 1)
        back3[h] = (rest if rest > 1e-12 else 1) / whole3[h] / (1 - sum(p2(h[1], w) for w, _ in l))
        assert two[h] == sum(c for _, c in l)
        assert sum(cut(d3, three[(*h, w)]) / whole3[h] if three[(*h, w)] else back3[h] * p2(h[1], w) for w in one) + back3[h] * back[h[1]] * unknown == pytest.approx(1)
    p3 = lambda u, v, w: cut(d3, three[u, v, w]) / whole3[u, v] if three[u, v, w] else back3.get((u, v), 1) * p2(v, w)
    assert most == 7 or any(three[x] > 5 for x in three)
    for i, t in tokens.items():
        score = math.log10(p2(" ", t[0])) + sum(math.log10(p3(*x)) for x in zip([" ", *t], t, t[1:], strict=False))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(one[w] > 0 for w in t), total, i % 8 < most)
        assert r.score == pytest.approx(score, rel=1e-6) and r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (total + many + 1)) for w in t), rel=1e-9, abs=1e-9)
    odd = language_model.scores(docs, F.lit(True)).collect()  # repeated and null ids are rows like others
    assert len(odd) == docs.count() and Counter(r.doc_id for r in odd)[7] == 2
    if not most:
        assert language_model.scores(empty, F.lit(True)).count() == 0
        alone = language_model.scores(rows.limit(3), F.lit(False)).collect()
        assert all(r.train_tokens == 0 and r.score == 0 for r in alone)


def test_crc_is_unsigned():
    assert zlib.crc32(b"x") >= 0

"""Maximal verbatim matches with their places."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from scenelake.llm import decontaminate


def brute(doc, item, width):
    out = set()
    width = min(width, len(item))
    for p in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while p + n < len(doc) and j + n < len(item) and doc[p + n] == item[j + n]:
                n += 1
            if n >= width > 0 and not (p and j and doc[p - 1] == item[j - 1]):
                out.add((p, n))
    return out


@pytest.mark.parametrize("set_bytes", [8 << 20, 100])
def test_matches_are_maximal(spark, monkeypatch, set_bytes):
    monkeypatch.setattr(decontaminate, "SET_BYTES", set_bytes)
    rng = np.random.default_rng(2)
    items = {"a": [f"w{i}" for i in range(60)], "b": list(rng.choice(["x", "y"], 14)), "c": ["w7"], "d": ["p", "q", "r"]}
    docs = {
        1: ["z", *items["a"][5:55], "z", *items["a"][10:22]],
        2: list(rng.choice(["x", "y"], 400)),
        3: ["w7", "p", "q", "r", "p", "q", "r"],
        4: ["nothing"],
        5: [],
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id string, text string")
    got = {r.doc_id: r.matches for r in decontaminate.overlaps(df, bench, 10 if set_bytes > 100 else 4).collect()}
    for i, w in docs.items():
        want = {(k, *m) for k, x in items.items() for m in brute(w, x, 10 if set_bytes > 100 else 4)}
        assert sorted((m.item, m.first, m.words) for m in got[i]) == sorted(want)
        assert [m.words for m in got[i]] == sorted((m.words for m in got[i]), reverse=True)
    assert (got[1][0].item, got[1][0].first, got[1][0].words) == ("a", 1, 50)


def reported(docs, items, monkeypatch, expanded, width=10):
    """What one shard reports of one set of items, without Spark."""
    monkeypatch.setattr(decontaminate, "EXPANDED", expanded)
    monkeypatch.setattr(decontaminate, "_loaded", lambda path: path)
    sets = [decontaminate.Items([i for i, _ in part], pa.array([" ".join(w) for _, w in part], pa.large_string()), width) for part in items]
    _, _, counts, words = decontaminate._words(pa.array([" ".join(w) for w in docs], pa.large_string()))
    return decontaminate._reports(pa.array(range(len(docs)), pa.int64()), words.dictionary_encode(), counts, sets)


@pytest.mark.parametrize("expanded", [1 << 20, 40, 1])
@pytest.mark.parametrize("n_sets", [1, 3])
def test_shared_windows(monkeypatch, expanded, n_sets):
    """Items with one opening, repeated ids and no ids; documents that quote it, whatever is expanded at once."""
    rng = np.random.default_rng(5)
    opening = [f"o{i}" for i in range(12)]
    items = [(str(i) if i % 7 else None, [*opening, *rng.choice(["x", "y"], 6).tolist()]) for i in range(30)]
    items += [("3", ["one"]), ("short", ["a", "b"]), ("none", []), ("last", opening[3:])]
    docs = [[*opening, *rng.choice(["x", "y"], 6).tolist(), "one", *opening], ["z", *opening[1:], "a", "b"], [], ["one"], opening, ["clean"] * 20]
    got = [r for b in reported(docs, [items[k::n_sets] for k in range(n_sets)], monkeypatch, expanded) for r in b.to_pylist()]
    for d, r in zip(docs, got, strict=True):
        want = {(i, *m) for i, w in items for m in brute(d, w, 10)}
        assert {(m["item"], m["first"], m["words"]) for m in r["matches"]} == want
        assert len(r["matches"]) == len(want)
        assert r["items"] == sorted({i for i, _, _ in want if i is not None})
        hit = {p + k for _, p, n in want for k in range(n)}
        assert r["n_hit"] == len(hit) == sum(h["last"] - h["first"] for h in r["hits"])
        assert {k for h in r["hits"] for k in range(h["first"], h["last"])} == hit
        assert r["n_words"] == len(d)
    assert got[0]["matches"] and not got[5]["hits"]


def test_an_opening_of_thousands_of_items(monkeypatch):
    """3000 items with one opening, quoted by 1500 documents twice: the search sees one window, and rows leave in bounded batches."""
    opening = [f"o{i}" for i in range(10)]
    items = [(str(i), [*opening, f"rest{i}"]) for i in range(3000)]
    docs = [[*opening, "z", *opening]] * 1500
    built = decontaminate.Items([i for i, _ in items], pa.array([" ".join(w) for _, w in items], pa.large_string()), 10)
    _, _, counts, words = decontaminate._words(pa.array([" ".join(w) for w in docs], pa.large_string()))
    place, window = decontaminate.places(built, words.dictionary_encode(), counts)
    assert len(place) == 3000 and len(set(window.tolist())) == 1
    sizes = [(b.num_rows, len(b.column("matches").flatten()), pc.unique(pc.list_value_length(b.column("items"))).to_pylist()) for b in reported(docs, [items], monkeypatch, 1 << 20)]
    assert sum(n for n, _, _ in sizes) == 1500
    assert all(m == 6000 * n <= 1 << 20 and known == [3000] for n, m, known in sizes)


def test_items_without_ids_hit_but_are_not_counted(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text), (None, "w0"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (None, None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.overlaps(docs, bench).collect()}
    assert (got[1].n_hit, got[1]["items"], [(m.item, m.first, m.words) for m in got[1].matches]) == (12, [], [(None, 0, 12)])
    assert got[None].n_hit == got[2].n_hit == 0
    assert sorted(r.doc_id or 0 for r in decontaminate.without_overlaps(docs, bench).collect()) == [0, 2]

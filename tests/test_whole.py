"""Queries take all rows of their tables, also those beyond the smallest tables' ids."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import clustering as K
from scenelake.operators import points as P
from scenelake.operators import retrieval as S
from scenelake.operators import rooms as R
from scenelake.plans import catalogue
from scenelake.sources import annotations as A
from scenelake.sources import work as W


def saved(spark, folder, ids, labels, vectors):
    rows = [(int(i), [float(v) for v in x], int(k)) for i, k, x in zip(ids, labels, vectors, strict=True)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"file://{folder}/embeddings.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("block", [7, 1024])
def test_medoids_of_whole_labels(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(K, "MEDOID_BLOCK", block, raising=False)
    rng = np.random.default_rng(5)
    ids, labels = np.arange(90) * 11, np.arange(90) % 3
    x = rng.normal(size=(90, 64)).astype(np.float32).astype(np.float64)
    x[60:75] = x[60]
    got = {r.label: (r.vec_id, r.total) for r in catalogue.vector_medoid(spark, saved(spark, tmp_path, ids, labels, x)).collect()}
    for k in range(3):
        at = np.flatnonzero(labels == k)
        total = np.sqrt(((x[at][:, None] - x[at][None]) ** 2).sum(2)).sum(1).round(6)
        best = min(zip(total, ids[at], strict=True))
        assert got[k][0] == best[1]
        assert got[k][1] == pytest.approx(best[0], abs=2e-6)
    assert len(got) == 3


def test_suppression_of_all_images(spark, tmp_path):
    rng = np.random.default_rng(7)
    ids, labels = np.arange(120) * 13, np.arange(120) % 2
    x = rng.uniform(-0.4, 0.4, (120, 64)).astype(np.float32).astype(np.float64)
    got = sorted((r.label, r.pos) for r in catalogue.nms_fold(spark, saved(spark, tmp_path, ids, labels, x)).collect())
    kept: dict[tuple, list[int]] = {}
    for i in np.lexsort((ids, -x[:, 4])):
        mine = kept.setdefault((labels[i], ids[i] // 500), [])
        shared = [np.prod(np.maximum(0.3 - np.abs(x[i, :2] - x[k, :2]), 0)) for k in mine]
        if all(s / (0.18 - s + 1e-6) <= 0.5 for s in shared):
            mine.append(i)
    want = sorted((int(k), int(ids[i])) for (k, _), m in kept.items() for i in m)
    assert got == want
    assert len(want) < 120 and max(p for _, p in got) > 1000


def test_dbscan_of_all_points(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 160
    middle = np.repeat(rng.uniform(-0.4, 0.4, (8, 3)), n // 8, 0)
    x = np.zeros((n, 64))
    x[:, :3] = middle + rng.normal(0, 0.018, (n, 3))
    x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(n) * 7
    got = {r.pid: r.cluster for r in catalogue.dbscan_cells(spark, saved(spark, tmp_path, ids, np.arange(n) % 10, x)).collect()}
    near = ((x[:, None, :3] - x[None, :, :3]) ** 2).sum(2) <= 0.03**2
    core = near.sum(1) >= 4
    label = np.where(core, ids, -1)
    for _ in range(n):
        label = np.where(core, [label[near[i] & core].min() if core[i] else -1 for i in range(n)], -1)
    want = {int(ids[i]): int(label[near[i] & core].min()) if (near[i] & core).any() else None for i in range(n)}
    assert got == want
    border = sum(want[int(ids[i])] is not None and not core[i] for i in range(n))
    assert len(set(want.values()) - {None}) > 1 and None in want.values() and border


def test_every_20th_row_is_a_query_and_blocks_do_not_matter(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(11)
    ids, x = np.arange(150) * 4, rng.normal(size=(150, 64)).astype(np.float32).astype(np.float64)
    at = saved(spark, tmp_path, ids, np.arange(150) % 10, x)
    runs = []
    for most in (4096, 7):
        monkeypatch.setattr(S, "QUERIES_AT_ONCE", most)
        runs.append([sorted((r.query_id, r["rank"], r.pos) for r in catalogue.QUERIES[name](spark, at).collect()) for name in ("vec_topk_multi", "rank_zsum")])
    assert runs[0] == runs[1]
    asked = np.flatnonzero(ids % 20 == 0)
    best = np.argsort(-(x[asked] @ x.T), axis=1)[:, :5]
    assert runs[0][0] == [(int(ids[q]), k + 1, int(ids[i])) for q, row in zip(asked, best, strict=True) for k, i in enumerate(row)]
    halves = [x[asked][:, h] @ x[:, h].T for h in (slice(0, 32), slice(32, 64))]
    z = sum((s - s.mean(1, keepdims=True)) / s.std(1, keepdims=True) for s in halves)
    best = np.argsort(-z, axis=1)[:, :10]
    assert runs[0][1] == [(int(ids[q]), k + 1, int(ids[i])) for q, row in zip(asked, best, strict=True) for k, i in enumerate(row)]


def test_rows_without_a_modality(spark):
    rows = [(0, 1, "text", 1.0), (0, 1, "visual", 5.0), (0, 2, "text", 3.0), (0, 3, "visual", 7.0)]
    got = {r.pos: r.fused for r in S.fused_mean(spark.createDataFrame(rows, "query_id long, pos long, modality string, score double")).collect()}
    text = (np.array([1.0, 3.0, 0.0]) - 4 / 3) / np.std([1.0, 3.0, 0.0])
    assert got == pytest.approx({1: (text[0] - 1) / 2, 2: text[1], 3: (text[2] + 1) / 2})


def test_whole_texts(spark, tmp_path):
    head = "word " * 100
    texts = {1: head + "one", 2: head + "two\nend", 3: "", 4: "x" * 30_001}
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", "web") for i, t in texts.items()], "doc_id bigint, text string, lang string, source string"),
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(k, f"N{k}", 0) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "part": spark.createDataFrame([(30, "box", "B", "TIN")], "p_partkey bigint, p_name string, p_brand string, p_type string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    at = f"file://{tmp_path}"
    got = {r.id: r.content for r in catalogue.QUERIES["chunk_build"](spark, at).collect()}
    assert len(got) == 1 + 25 + 4 + 1
    assert all(got[f"frame_{i}_{i}"] == (f"{t}\n" if t else "") + "en; web" for i, t in texts.items())
    assert got["part_30"].startswith("Object: box. Attributes: B; TIN.")
    ids = {r.doc_id: r.id for r in catalogue.QUERIES["safe_id"](spark, at).collect()}
    assert ids[1] != ids[2] and ids[1][:70] == ids[2][:70] and all(len(i) <= 80 for i in ids.values())
    content = {r.doc_id: r.content for r in catalogue.QUERIES["embedding_input"](spark, at).collect()}
    assert content == {i: t.replace("\n", " ")[:30_000] for i, t in texts.items()}


def test_rooms_of_all_floors(spark):
    n = 1003
    floors = spark.range(n).select(F.col("id").cast("string").alias("floor_id"), (F.col("id") * 10.0).alias("low"), (F.col("id") * 10.0 + 2.5).alias("high"))
    cell = spark.range(144).select((F.col("id") % 12 / 4 + 0.1).alias("x"), (F.floor(F.col("id") / 12) / 4 + 0.1).alias("z"))
    points = floors.select((F.col("low") + 0.5).alias("y")).crossJoin(cell).select("x", "y", "z")
    assert R.rooms(points, floors, 0.25).select("floor_id").distinct().count() == n


def test_poses_and_counts_of_all_rooms_and_floors(spark):
    n = 10_005
    square = "array(named_struct('x', {0}, 'z', 0D), named_struct('x', {0} + 1D, 'z', 0D), named_struct('x', {0} + 1D, 'z', 1D), named_struct('x', {0}, 'z', 1D))"
    rooms = spark.range(n).select(F.lit("0").alias("floor_id"), F.col("id").cast("string").alias("room_id"), F.expr(square.format("2D * id")).alias("polygon"))
    poses = spark.range(n).select(F.col("id").cast("int").alias("frame_index"), F.expr("transform(sequence(0, 15), i -> case i when 3 then 2D * id + 0.5D when 7 then 1D when 11 then 0.5D else 0D end)").alias("pose")).filter("frame_index % 500 = 4")
    floors = spark.createDataFrame([("0", 0.0, 2.5)], "floor_id string, low double, high double")
    got = {r.frame_index: r.room_id for r in R.poses_in_rooms(poses, floors, rooms).collect()}
    assert got == {i: str(i) for i in range(4, n, 500)}
    bands = spark.range(n).select(F.col("id").cast("string").alias("floor_id"), F.col("id").cast("double").alias("low"), (F.col("id") + 0.5).alias("high"))
    points = spark.range(n).select((F.col("id") + 0.25).alias("y"))
    assert A.floors_measured(bands, points).filter("n_points <> 1").count() == 0


@pytest.mark.parametrize("contained", [False, True])
def test_boxes_meet_once_whatever_the_blocks(spark, tmp_path, monkeypatch, contained):
    """Crowded boxes, some equal, some touching, over several strips and blocks, against all pairs."""
    monkeypatch.setattr(P, "BOXES_OF_A_STRIP", 8, raising=False)
    monkeypatch.setattr(P, "BOXES_AT_ONCE", 32, raising=False)
    rng = np.random.default_rng(31)
    n, ids = 300, rng.permutation(300) * 3
    x = rng.normal(0, 0.125, (n, 64)).astype(np.float32).astype(np.float64)
    x[40:60] = x[40]
    low, high = x[:, :3], x[:, :3] + (np.abs(x[:, 3:6]) + 0.05)
    want = {}
    for i in range(n):
        for j in range(n):
            side = np.minimum(high[i], high[j]) - np.maximum(low[i], low[j])
            if ids[i] < ids[j] and (side > 0).all():
                s, va, vb = side.prod(), (high[i] - low[i]).prod(), (high[j] - low[j]).prod()
                value = max(s / (va + vb - s), s / min(va, vb)) if contained else s / (va + vb - s + 1e-8)
                if not contained or value > 0.5:
                    want[int(ids[i]), int(ids[j])] = value
    query = catalogue.box_contained_pairs if contained else catalogue.box_iou_pairs
    rows = query(spark, saved(spark, tmp_path, ids, np.arange(n) % 10, x)).collect()
    got = {(r.a_id, r.b_id): r[2] for r in rows}
    assert len(rows) == len(got) and got == pytest.approx(want, abs=1e-6)
    rows = P.box_similarities(catalogue._boxes(spark, f"file://{tmp_path}"), contained, 0.5).collect()
    assert {(r.a_id, r.b_id) for r in rows} == {k for k, v in want.items() if v > 0.5}


def odd_vectors(spark):
    """Copies, nulls, other lengths, no numbers and equal scores beside plain rows."""
    rng = np.random.default_rng(37)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    x[50:150] = x[50]
    rows = [(k * 7 % 401, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(1000, None), (1001, [1.0] * 3), (1002, [None] + [1.0] * 7), (1003, [float("nan")] + [1.0] * 7), (1004, [float("inf")] + [1.0] * 7), (1005, [])]
    asked = [(k, [float(v) for v in r]) for k, r in enumerate(x[45:75])] + [(3, [2.0] * 8), (90, None), (91, [1.0] * 3), (92, [0.0] * 8), (93, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "pos long, vec array<float>").repartition(5), spark.createDataFrame(asked, "query_id long, qvec array<float>").repartition(3)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [3, 60, 405])
def test_search_by_blocks_is_the_plain_search(spark, monkeypatch, metric, k):
    """Exactly the scores of all pairs ranked, whatever the blocks."""
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(S, "VECTORS_AT_ONCE", 50, raising=False)
    v, q = odd_vectors(spark)
    seen = lambda df: sorted((r.query_id, r["rank"], r.pos, str(r.score)) for r in df.collect())
    order = [F.desc("score") if metric == "ip" else F.asc_nulls_last("score"), F.asc("pos")]
    want = seen(S.ranked(S._plain(v, q, metric), ["query_id"], order, k))
    assert seen(S.search_many(v, q, k, metric)) == want
    kinds = v.withColumn("doc_type", F.col("pos").cast("string"))
    assert seen(S.search_many(kinds, q, k, metric).filter("doc_type = cast(pos as string)")) == want


def test_thousands_of_queries_end(spark):
    """30000 rows and 6000 queries: 180 million pairs, of which only the best become rows."""
    number = lambda i: (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2001)) / 1000 - 1).cast("float")
    v = spark.range(30_000).select(F.col("id").alias("pos"), F.array(*(number(i) for i in range(64))).alias("vec"))
    q = v.filter("pos % 5 = 0").select(F.col("pos").alias("query_id"), F.col("vec").alias("qvec"))
    began = time.monotonic()
    got = S.search_many(v, q, 5).agg(F.count("*"), F.count_if((F.col("rank") == 1) & (F.col("pos") == F.col("query_id")))).first()
    assert time.monotonic() - began < 60 and got[0] == 30_000 and got[1] > 5900


def test_probabilities_of_odd_rows(spark, monkeypatch):
    """One row a pair, null where there is no product."""
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(S, "VECTORS_AT_ONCE", 50, raising=False)
    v, q = odd_vectors(spark)
    rows = S.probabilities(v, q, 0.5, -2.0, 9).collect()
    assert len(rows) == v.count() * q.count()
    got = {(r.query_id, r.pos): r.probability for r in rows if r.query_id != 3 and r.probability is not None}
    want = {(r.query_id, r.pos): r.score for r in S._plain(v, q).collect() if r.query_id != 3 and r.score is not None}
    assert got.keys() == want.keys()
    for k, s in want.items():
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(np.float64(s) * np.exp(0.5) - 2))), abs=1e-8, nan_ok=True)


@pytest.mark.parametrize("odd", [False, True])
def test_modalities_by_blocks_are_the_plain_ones(spark, monkeypatch, odd):
    """Copies, a flat modality, and, if odd, rows that have no score or share a key."""
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(S, "VECTORS_AT_ONCE", 50, raising=False)
    rng = np.random.default_rng(41)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    x[50:120] = x[50]
    asked = x[45:65].copy()
    asked[3, 4:] = 0
    rows, ask = [(k * 7 % 301, r.tolist()) for k, r in enumerate(x)], [(k, r.tolist()) for k, r in enumerate(asked)]
    if odd:
        rows += [(0, [1.0] * 8), (1000, None), (1001, [1.0] * 5)]
        ask += [(3, [2.0] * 8), (90, None)]
    v = spark.createDataFrame(rows, "pos long, vec array<float>").repartition(5)
    q = spark.createDataFrame(ask, "query_id long, qvec array<float>").repartition(3)
    parts = {"text": (1, 4), "visual": (5, 4)}
    plain = S.modal_scores(v, q, parts)
    want = {(r.query_id, r.pos): r.fused for r in S.fused_mean(plain).collect()}
    got = S.fused_modalities(v, q, parts).collect()
    assert len(got) == len(want) and {(r.query_id, r.pos): r.fused for r in got if r.fused is not None} == pytest.approx({k: x for k, x in want.items() if x is not None}, abs=1e-9)
    top = lambda df: sorted((r.query_id, r["rank"], r.pos, None if r.score is None else round(r.score, 8)) for r in df.collect())
    for k in (4, 80, 400):
        assert top(S.rank_modalities(v, q, parts, k)) == top(S.rank_by_zscores(plain, k))


def test_rounded_numbers_leave_in_order():
    """The same rows in stretches of so many, each ordered, also with what is no number, -0.0 and what is too great for a key."""
    rng = np.random.default_rng(43)
    for odd in ([], [np.nan, np.inf, -np.inf], [1e300]):
        x = np.r_[np.round(rng.normal(size=997), 2), odd, -0.0]
        rows = (np.arange(len(x)), x)
        parts = [tuple(c[n : n + 90] for c in rows) for n in range(0, len(x), 90)]
        place, got = (np.concatenate(c) for c in zip(*W.in_order(iter(parts), 2, 400), strict=True))
        assert sorted(place) == list(range(len(x))) and np.array_equal(got, x[place], equal_nan=True) and np.array_equal(np.signbit(got), np.signbit(x[place]))
        for n in range(0, len(x), 400):
            assert (np.diff(got[n : n + 400][~np.isnan(got[n : n + 400])]) >= 0).sum() == (~np.isnan(got[n : n + 400])).sum() - 1
        assert np.array_equal(np.concatenate([p[0] for p in W.in_order(iter(parts), None, 400)]), rows[0])


def stretches(df, name):
    """How often a number is less than the one before it in its partition, and how many numbers there are."""
    rows = df.select(F.spark_partition_id().alias("part"), name).collect()
    return sum(a.part == b.part and b[1] < a[1] for a, b in zip(rows, rows[1:], strict=False)), len(rows)


def test_box_pairs_leave_in_order_of_similarity(spark, tmp_path, monkeypatch):
    """Pairs are as many as overlap, so what one takes on disk counts: equal similarities are neighbours."""
    rng = np.random.default_rng(47)
    x = rng.normal(0, 0.125, (400, 64)).astype(np.float32).astype(np.float64)
    at = saved(spark, tmp_path, np.arange(400), np.arange(400) % 10, x)
    falls, n = stretches(catalogue.box_iou_pairs(spark, at), "iou")
    assert n > 10_000 and falls == 0
    monkeypatch.setattr(P, "BOX_PAIRS_AT_ONCE", 100, raising=False)
    falls, again = stretches(catalogue.box_iou_pairs(spark, at), "iou")
    assert again == n and 0 < falls <= n / 100


def many_pairs(spark, folder):
    rng = np.random.default_rng(53)
    x = rng.normal(0, 0.125, (1200, 64)).astype(np.float32).astype(np.float64)
    x[100:200] = x[100]
    return x, saved(spark, folder, np.arange(1200) * 2, np.arange(1200) % 10, x)


def test_probabilities_leave_in_order(spark, tmp_path, monkeypatch):
    """Every pair is a row, so what one takes on disk counts: equal numbers are neighbours, however many a task holds."""
    x, at = many_pairs(spark, tmp_path)
    query = catalogue.QUERIES["sigmoid_prob"]
    falls, n = stretches(query(spark, at), "probability")
    assert n == 144_000 and falls == 0
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 4000, raising=False)
    rows = query(spark, at).collect()
    want = 1 / (1 + np.exp(-(x[::10] @ x.T * np.exp(1.5) - 2)))
    assert len({(r.query_id, r.pos) for r in rows}) == len(rows) == n
    assert max(abs(want[r.query_id // 20, r.pos // 2] - r.probability) for r in rows) < 1e-6
    falls, _ = stretches(query(spark, at), "probability")
    assert 0 < falls < 60


def test_rows_go_by_query_where_keys_fit_no_dictionary(spark, tmp_path, monkeypatch):
    _, at = many_pairs(spark, tmp_path)
    monkeypatch.setattr(S, "DICTIONARY", 1000, raising=False)
    rows = catalogue.QUERIES["sigmoid_prob"](spark, at).select(F.spark_partition_id().alias("part"), "query_id").collect()
    assert len(rows) == 144_000 and sum(a != b for a, b in zip(rows, rows[1:], strict=False)) < 500


def test_fused_scores_leave_in_order(spark, tmp_path, monkeypatch):
    """As probabilities do, also where a task makes them class by class."""
    x, at = many_pairs(spark, tmp_path)
    query = catalogue.QUERIES["fuse_zscore_two_modalities"]
    falls, n = stretches(query(spark, at), "fused")
    assert n == 144_000 and falls == 0
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 4000, raising=False)
    rows = query(spark, at).collect()
    halves = [x[::10][:, h] @ x[:, h].T for h in (slice(0, 32), slice(32, 64))]
    want = sum((s - s.mean(1, keepdims=True)) / s.std(1, keepdims=True) for s in halves) / 2
    assert len({(r.query_id, r.pos) for r in rows}) == len(rows) == n
    assert max(abs(want[r.query_id // 20, r.pos // 2] - r.fused) for r in rows) < 1e-6

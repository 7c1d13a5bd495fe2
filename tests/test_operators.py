"""Operators on hand-made rows."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.functions import text as T
from scenelake.functions import vectors as V
from scenelake.operators import chunks as C
from scenelake.operators import clustering as K
from scenelake.operators import evaluation as E
from scenelake.operators import masks as M
from scenelake.operators import objects as O
from scenelake.operators import points as P
from scenelake.operators import retrieval as S
from scenelake.operators import rooms as R


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_json_of_all_kinds(spark):
    cases = {'{"a": 1}': '{"a": 1}', '```json\n{"a": 1}\n```': '{"a": 1}', 'Well: {"a": 1}': '{"a": 1}', '{"a": 1} so': '{"a": 1}', "[1, 2] so": "[1, 2]", "{broken": None, "": None}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for r in df.select("raw", "want", T.json_between(F.col("raw")).alias("got")).collect():
        assert r.got == r.want, r.raw


def test_description_defaults(spark):
    got = one(spark, a=T.frame_description(F.lit('{"caption": "c", "objects": {}}')), b=T.frame_description(F.lit("just words")))
    assert (got.a.caption, got.a.description, got.a.objects) == ("c", "", "[]")
    assert got.b.description == "just words"


def test_tags(spark):
    got = one(
        spark,
        a=T.normalize_tags(F.array(*map(F.lit, (" A ", "b", "", "a", "B"))), 80),
        b=T.tags_from_response(F.lit('{"objects": ["X", "x", "y"]}')),
        c=T.tags_from_response(F.lit("one, Two,one")),
        d=T.normalize_tags(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: i.cast("string"))),
        e=T.functional_tags(F.lit("door handle. lamp - switch, door"), F.array(F.lit("door"), F.lit("lamp"))),
    )
    assert (got.a, got.b, got.c, len(got.d)) == (["a", "b"], ["x", "y"], ["one", "two"], 80)
    assert got.e == ["handle", "- switch"]


def test_sentences_are_packed(spark):
    text = "One two three. Four five six! Seven? " + "x" * 100 + "."
    got = one(spark, a=T.packed_sentences(F.lit(text), 8)).a
    assert "".join(got).replace(" ", "") == text.replace(" ", "")
    assert all(len(p) // 4 <= 8 for p in got)


def test_sample_standardization(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (3, 5.0), (3, 5.0)], "g int, x double")
    w = Window.partitionBy("g")
    rows = df.select("g", V.standardized(F.col("x"), w).alias("a"), V.standardized(F.col("x"), w, "zero").alias("b")).collect()
    assert sorted(r.a for r in rows if r.g == 1) == [-1.0, 1.0]
    assert all(r.a == 0 and r.b == 0 for r in rows if r.g > 1)


@pytest.mark.parametrize(
    ("a", "b", "iou", "contained"),
    [((0, 0, 0, 1, 1, 1), (2, 2, 2, 3, 3, 3), 0, 0), ((0, 0, 0, 1, 1, 1), (1, 0, 0, 2, 1, 1), 0, 0), ((0, 0, 0, 1, 1, 1), (0, 0, 0, 1, 1, 1), 1, 1), ((0, 0, 0, 2, 2, 2), (0, 0, 0, 1, 1, 1), 0.125, 1), ((0, 0, 0, 0, 1, 1), (0, 0, 0, 1, 1, 1), 0, 0)],
)
def test_boxes(spark, a, b, iou, contained):
    box = lambda x: ([F.lit(float(v)) for v in x[:3]], [F.lit(float(v)) for v in x[3:]])
    got = one(spark, i=G.iou(box(a), box(b)), j=G.iou(box(b), box(a)), c=G.iou_or_contained(box(a), box(b)))
    assert got.i == pytest.approx(iou, abs=1e-6) and got.i == got.j and got.c == pytest.approx(contained)


def test_poses(spark):
    angle = 0.7
    pose = [math.cos(angle), 0, math.sin(angle), 1.0, 0, 1, 0, 2.0, -math.sin(angle), 0, math.cos(angle), 3.0, 0, 0, 0, 1.0]
    p = F.array(*map(F.lit, map(float, pose)))
    x = [F.lit(0.5), F.lit(-0.25), F.lit(2.0)]
    got = one(spark, back=F.array(*G.transformed(G.rigid_inverse(p), G.transformed(p, x))), q=G.quaternion(p))
    assert got.back == pytest.approx([0.5, -0.25, 2.0])
    assert got.q == pytest.approx([0, math.sin(angle / 2), 0, math.cos(angle / 2)])
    half = one(spark, q=G.quaternion(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0))))).q
    assert half == pytest.approx([1, 0, 0, 0])
    with pytest.raises(Exception, match="numbers"):
        one(spark, k=G.camera_of(G.matrix_of(F.lit("1 2 3"))))


def test_polygon_column_and_literal_agree(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(float(x) / 4 + 0.1, float(z) / 4 + 0.1) for x in range(-2, 20) for z in range(-2, 20)], "x double, z double")
    polygon = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("z")) for a, b in shape))
    rows = df.select("x", "z", G.in_polygon(F.col("x"), F.col("z"), shape).alias("a"), G.in_polygon_column(F.col("x"), F.col("z"), polygon).alias("b"), G.in_polygon(F.col("x"), F.col("z"), shape, 0.2).alias("c")).collect()
    for r in rows:
        inside = (0 < r.x < 4 and 0 < r.z < 1) or (0 < r.x < 1 and 0 < r.z < 4)
        assert r.a == r.b == inside and (r.c or not r.a)


def test_search_can_give_fewer_than_k(spark):
    rows = [(i, [float(20 - i), 0.0], "a" if i < 15 else "b") for i in range(20)]
    v = spark.createDataFrame(rows, "pos long, vec array<double>, doc_type string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, qvec array<double>")
    assert S.search(v, q, 1, ("b",), expand=10).count() == 0
    assert [r.pos for r in S.search(v, q, 1, ("b",), exact_filter=True).collect()] == [15]
    assert [r.pos for r in S.search(v, q, 2, ("b",), expand=8).collect()] == [15]


def test_confidence_of_zero_never_wins(spark):
    rows = [("a", 0.0, 0, 0), ("b", 0.5, 1, 0), ("b", 0.5, 0, 1), ("b", 0.0, 0, 0)]
    df = spark.createDataFrame(rows, "object_id string, confidence double, frame_pos int, object_pos int")
    assert [(r.object_id, r.frame_pos, r.object_pos) for r in O.best_descriptions(df).collect()] == [("b", 0, 1)]


def test_replacement_keeps_places(spark):
    base = spark.createDataFrame([(0, "a", "1"), (5, "b", "2")], "pos long, id string, content string")
    new = spark.createDataFrame([(0, "c", "x"), (1, "b", "y"), (2, "d", "z")], "pos long, id string, content string")
    assert sorted(tuple(r) for r in C.replaced(base, new).collect()) == [(0, "a", "1"), (5, "b", "y"), (6, "c", "x"), (7, "d", "z")]


def test_metrics_of_classes_on_one_side(spark):
    gt = [[0, 0, 1, 1], [0, 2, 1, 1], [2, 2, 0, 0], [2, 2, 0, 0]]
    pred = [[0, 0, 1, 3], [0, 1, 1, 1], [0, 0, 0, 0], [3, 3, 0, 0]]
    rows = [(0, y, x, gt[y][x]) for y in range(4) for x in range(4)]
    found = [(0, y, x, pred[y][x]) for y in range(4) for x in range(4)]
    schema = "image_id int, y int, x int, label int"
    table = E.confusion(E.same_size(spark.createDataFrame(rows, schema), spark.createDataFrame(found, schema)))
    iou = {r["class"]: r.iou for r in E.class_iou(table).collect()}
    assert iou == pytest.approx({0: 7 / 9, 1: 3 / 5, 2: 0.0, 3: 0.0})
    s = E.summary(table).first()
    assert s.pixel_accuracy == pytest.approx(10 / 16) and s.mean_accuracy == pytest.approx((1 + 3 / 4 + 0) / 3) and s.mean_iou == pytest.approx((7 / 9 + 3 / 5) / 3)
    s = E.summary(table, ignore=(0,)).first()
    assert s.mean_iou == pytest.approx(3 / 5 / 2) and s.frequency_weighted_iou == pytest.approx(4 * 3 / 5 / 9)
    with pytest.raises(Exception, match="sizes"):
        E.same_size(spark.createDataFrame(rows, schema), spark.createDataFrame(found[:-1], schema)).collect()


def test_hits_have_empty_buckets(spark):
    df = spark.createDataFrame([(0.3, True), (0.05, None)], "iou double, is_easy boolean")
    got = {(r.split, r.value, r.threshold): (r.total, r.hits) for r in E.hits(df, (0.1,), ("is_easy",)).collect()}
    assert got == {("overall", "all", 0.1): (2, 1), ("is_easy", "false", 0.1): (1, 0), ("is_easy", "true", 0.1): (1, 1)}


def test_dbscan_equals_local(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (30, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 2, 1))] + [rng.uniform(-3, 3, (15, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, x double, y double, z double")
    got = {r.pid: r.cluster for r in K.dbscan(df, 0.2, 4, f"file://{tmp_path}").collect()}
    want = K.local_dbscan(x, 0.2, 4)
    cores = [i for i in range(len(x)) if (np.linalg.norm(x - x[i], axis=1) <= 0.2).sum() >= 4]
    assert {i for i in got if got[i] is None} == set(np.flatnonzero(want < 0))
    for i in cores:
        for j in cores:
            assert (got[i] == got[j]) == (want[i] == want[j])


def test_hierarchical_clusters_find_three_groups():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, (25, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [np.array([[10.0, 10.0]])])
    labels = K.condensed_clusters(np.linalg.norm(x[:, None] - x[None], axis=2), 10)
    assert labels[-1] == -1 and len(set(labels[:25])) == 1
    assert len({tuple(sorted(set(labels[k : k + 25]) - {-1})) for k in (0, 25, 50)}) == 3


def test_keyframes_without_clusters_are_all_frames(spark):
    eye = [1.0 if k % 5 == 0 else 0.0 for k in range(16)]
    df = spark.createDataFrame([("r", i, [*eye[:3], float(i), *eye[4:]]) for i in range(4)], "room_id string, frame_index int, pose array<double>")
    assert sorted(r.frame_index for r in K.keyframes(df).collect()) == [0, 1, 2, 3]


def test_floors_of_two_storeys(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(c, 0.01, 4000) for c in (0.0, 2.5, 3.0, 5.5)] + [rng.uniform(0, 5.5, 400)])
    got = K.floors(spark.createDataFrame([(float(v),) for v in y], "y double")).orderBy("floor_id").collect()
    assert len(got) == 2 and abs(got[0].high - 2.5) < 0.1 and abs(got[1].low - 3.0) < 0.1


def test_smoothing_mirrors_and_keeps_the_sum(spark):
    rows = [(i, n) for i, n in enumerate([5, 0, 0, 1, 0, 7, 2])]
    got = [r.smooth for r in K.smoothed(spark.createDataFrame(rows, "bin long, n long"), 1.0).orderBy("bin").collect()]
    assert sum(got) == pytest.approx(15)


def test_run_lengths_round_trip(spark):
    mask = np.zeros((4, 5), bool)
    mask[1:3, 0] = mask[0, 2] = mask[3, 4] = True
    pixels = spark.createDataFrame([("m", int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "mask_id string, y int, x int")
    size = spark.createDataFrame([("m", 4, 5), ("none", 2, 2)], "mask_id string, h int, w int")
    got = {r.mask_id: r.counts for r in M.run_lengths(pixels, size).collect()}
    flat = [b for k, n in enumerate(got["m"]) for b in [k % 2 == 1] * n]
    assert (np.array(flat).reshape(5, 4).T == mask).all() and got["none"] == [4]


def test_suppression(spark):
    rows = [("i", 0, 0.5, 0.0, 0.0, 2.0, 2.0), ("i", 1, 0.9, 0.1, 0.0, 2.1, 2.0), ("i", 2, 0.4, 5.0, 5.0, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "image string, pos long, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.pos for r in M.suppressed(df, "image").collect()) == [1, 2]


def test_merge_follows_input_order(spark):
    cube = [[x / 10, y / 10, z / 10] for x in range(4) for y in range(4) for z in range(4)]
    far = [[a + 5, b, c] for a, b, c in cube]
    rows = [("r", 0, "a", "chair", cube, [1]), ("r", 1, "b", "seat", cube, [2]), ("r", 2, "c", "table", far, [3])]
    df = spark.createDataFrame(rows, "room_id string, pos long, object_id string, label string, xyz array<array<double>>, frame_indices array<int>")
    got = {r.object_id: r for r in O.merge(df, radius=0.05).collect()}
    assert set(got) == {"a", "c"} and got["a"].label == "chair, seat" and got["a"].frame_indices == [1, 2]
    long = df.select("room_id", F.col("object_id").alias("id"), F.posexplode("xyz").alias("pid", "p")).select("room_id", "id", "pid", *(F.col("p")[k].alias(c) for k, c in enumerate("xyz")))
    assert [(r.a_id, r.b_id, r.similarity) for r in O.linked(long, radius=0.05).collect()] == [("a", "b", 1.0)]


def test_near_ratio_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((60, 3)), rng.random((40, 3)) + 0.3
    frame = lambda x: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, x double, y double, z double")
    d = np.linalg.norm(a[:, None] - b[None], axis=2) < 0.2
    r = P.near_ratio(frame(a), frame(b), 0.2).first()
    assert (r.a_share, r.b_share) == pytest.approx((d.any(1).mean(), d.any(0).mean()))


def test_overlapping_boxes_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    low = rng.random((40, 3)) * 3
    high = low + rng.random((40, 3))
    rows = [(i, *map(float, low[i]), *map(float, high[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    got = sorted((r.a_id, r.b_id) for r in P.overlapping_boxes(df, 0.5).collect())
    want = [(i, j) for i in range(40) for j in range(i + 1, 40) if (low[i] < high[j]).all() and (low[j] < high[i]).all()]
    assert got == want


def test_pose_stops_at_its_floor(spark):
    eye = lambda x, y, z: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, z, 0.0, 0.0, 0.0, 1.0]
    poses = spark.createDataFrame([(0, eye(0.5, 1.0, 0.5)), (1, eye(5.0, 1.0, 5.0)), (2, eye(0.5, 2.7, 0.5))], "frame_index int, pose array<double>")
    floors = spark.createDataFrame([("0", 0.0, 2.5), ("1", 2.5, 5.0)], "floor_id string, low double, high double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rooms = spark.createDataFrame([("0", "0_0", square), ("0", "0_1", [(x + 2, z) for x, z in square]), ("1", "1_0", square)], "floor_id string, room_id string, polygon array<struct<x:double,z:double>>")
    got = {r.frame_index: r.room_id for r in R.poses_in_rooms(poses, floors, rooms).collect()}
    # 2.7 lies within the first floor's margin, so the second is not asked
    assert got == {0: "0_0", 2: "0_0"}


def test_rooms_of_two_boxes(spark):
    rows = []
    for i in range(0, 81):
        for j in range(0, 41):
            x, z = i / 10, j / 10
            rows.append((x, 0.1, z))
            if i in (0, 1, 40, 80, 79) or j in (0, 1, 39, 40):
                rows += [(x, y, z) for y in (1.6, 1.8, 2.0)]
    points = spark.createDataFrame(rows, "x double, y double, z double")
    floors = spark.createDataFrame([("0", 0.0, 2.6)], "floor_id string, low double, high double")
    got = R.rooms(points, floors, 0.1)
    assert got.count() == 2
    inside = R.points_in_rooms(spark.createDataFrame([(2.0, 0.5, 2.0), (6.0, 0.5, 2.0), (20.0, 0.5, 2.0)], "x double, y double, z double"), got)
    assert inside.select("room_id").distinct().count() == 2 and inside.count() == 2


def test_distances_and_flood():
    mask = np.ones((7, 9), bool)
    mask[3, 4] = False
    want = np.array([[math.hypot(y - 3, x - 4) for x in range(9)] for y in range(7)])
    assert R.distances(mask) == pytest.approx(want)
    seeds = np.zeros((1, 7), np.int64)
    seeds[0, 0], seeds[0, 6] = 1, 2
    got = R.flooded(np.array([[0, 1, 2, 5, 2, 1, 0]]), seeds, np.ones((1, 7), bool))
    assert got[0, :3].tolist() == [1, 1, 1] and got[0, 4:].tolist() == [2, 2, 2]


def test_keyframes_of_objects(spark):
    k = spark.createDataFrame([("r1", 0, 7, ["a"], "p7", None, "d"), ("r2", 1, 7, ["b"], "q7", "l7", "d"), ("r2", 1, 8, [], "q8", None, "d")], "room_id string, room_pos int, frame_index int, object_ids array<string>, path string, labeled_path string, description string")
    seen = spark.createDataFrame([("a", 8), ("b", 7)], "object_id string, frame_index int")
    got = sorted((r.object_id, r.frame_index, r.room_id, r.path) for r in O.keyframes_of(seen, k).collect())
    assert got == [("a", 7, "r1", "p7"), ("a", 8, "r2", "q8"), ("b", 7, "r1", "p7")]


def test_chunks_of_a_scene(spark):
    floors = spark.createDataFrame([("0", "ground")], "floor_id string, caption string")
    rooms = spark.createDataFrame([("0_0", "0", 0, "a kitchen"), ("0_1", "0", 1, None)], "room_id string, floor_id string, room_pos int, summary string")
    frames = spark.createDataFrame([("0_0", 0, 5, "a view", ["cup"]), ("0_0", 1, None, "lost", [])], "room_id string, frame_pos int, frame_index int, description string, tags array<string>")
    objects = spark.createDataFrame([("0_0", 0, 0, "", "cup", ["red"], "", [], "", None, []), ("0_0", 0, 1, "cup", "cup two", [], "", [], "", None, []), ("0_1", 0, 0, "cup", "cup", [], "", [], "", None, [])], "room_id string, frame_pos int, object_pos int, object_id string, name string, attributes array<string>, description string, affordances array<string>, state string, location_description string, spatial_relations array<string>")
    got = [(r.id, r.doc_type, r.content) for r in C.built(floors, rooms, frames, objects).orderBy("ord", "id").collect()]
    assert [g[0] for g in got] == ["floor_0", "room_0_0", "frame_0_0_5", "cup", "room_0_1", "cup"]
    assert got[3][2] == "Object: cup. Attributes: red. Affordances: (no affordances listed). State: unknown state. Located at an unspecified location."


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "label string, n_points int, n_masks int, n_functional int, n_detections int")
    r = O.statistics(df).first()
    assert (r.total, r.average_points, r.labels) == (0, 0.0, [])
    assert json.dumps(r.asDict(recursive=True))


def test_merge_of_a_full_room_ends(spark):
    """2000 objects crowd in one room: each meets the boxes side by side, and a cloud's voxels are touched where points join."""
    rng = np.random.default_rng(23)
    steps = np.array([(a, b, c) for a in (0, 0.03, 0.06) for b in (0, 0.03, 0.06) for c in (0, 0.03, 0.06)])
    rows = [("r", k, f"o{k}", f"thing {k % 4}", (x + steps).tolist(), [k]) for k, x in enumerate(rng.normal(0, 0.125, (2000, 3)))]
    df = spark.createDataFrame(rows, "room_id string, pos long, object_id string, label string, xyz array<array<double>>, frame_indices array<int>")
    began = time.monotonic()
    got = O.merge(df, radius=0.05).collect()
    assert time.monotonic() - began < 60
    assert sorted(x for r in got for x in r.merged_from) == sorted(f"o{k}" for k in range(2000)) and len(got) < 500


def test_clouds_join_as_if_thinned_whole():
    rng = np.random.default_rng(29)
    x = rng.normal(0, 0.05, (40, 3))
    cloud = O._Cloud(x)
    for _ in range(200):
        more = rng.normal(0, 0.05, (rng.integers(0, 30), 3))
        x = np.concatenate([x, more])
        _, of = np.unique(np.floor((x - (x.min(0) - 0.01 / 2)) / 0.01).astype(np.int64), axis=0, return_inverse=True)
        x = np.stack([np.bincount(of.ravel(), weights=x[:, k]) / np.bincount(of.ravel()) for k in range(3)], axis=1)
        cloud.join(more.T, 0.01)
        assert (cloud.x.T == x).all()
    assert cloud.keys is not None


def test_keyframes_of_a_full_room_need_no_matrix():
    """12000 poses of one room: their distances would be 1152 MB."""
    import tracemalloc

    rng = np.random.default_rng(31)
    poses = np.c_[rng.normal(0, 0.125, (12_000, 3)), np.zeros((12_000, 3)), np.ones(12_000)]
    tracemalloc.start()
    keep = K.representative(poses, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and 100 < len(keep) < 12_000


def test_clusters_do_not_depend_on_how_distances_come():
    rng = np.random.default_rng(37)
    x = rng.normal(size=(400, 3))
    x[100:140] = x[100]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = K.condensed_clusters(d, 5)
    asked = []

    def some(i, j):
        asked.append(j - i)
        return d[i:j]

    assert (K.clusters_by(some, 400, 5) == want).all() and want.max() > 0 and len(asked) >= 400

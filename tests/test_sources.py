"""Scenes on disk, exports, the build, providers and streams on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.config import Config
from scenelake.plans.build import Build
from scenelake.providers import Provider, calls, make, register
from scenelake.sources import annotations, datasets, images, sinks
from scenelake.streaming import sessions


@pytest.mark.parametrize("shape", [(5, 7), (4, 3, 3)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(shape, kind):
    x = np.random.default_rng(0).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (images.read_png(images.write_png(x)) == x).all()
    with pytest.raises(ValueError):
        images.decode(b"GIF89a")


def scene(root, n=12):
    for d in ("color", "depth", "pose", "intrinsic"):
        (root / d).mkdir(parents=True)
    rng = np.random.default_rng(1)
    for k in range(n):
        (root / "color" / f"{k}.png").write_bytes(images.write_png(rng.integers(0, 255, (6, 8, 3)).astype(np.uint8)))
        (root / "depth" / f"{k}.png").write_bytes(images.write_png(np.full((6, 8), 1500 + k, np.uint16)))
        pose = np.eye(4)
        pose[0, 3] = k / 10
        (root / "pose" / f"{k}.txt").write_text("\n".join(" ".join(map(str, r)) for r in pose))
    (root / "intrinsic" / "intrinsic_depth.txt").write_text("8 0 4 0\n0 8 3 0\n0 0 1 0\n0 0 0 1")
    return f"file://{root}"


def test_frames_are_in_numeric_order(spark, tmp_path):
    root = scene(tmp_path / "s")
    got = {r.frame_index: r for r in datasets.frames(spark, " ScanNet ", root).collect()}
    assert sorted(got) == list(range(12))
    for k, r in got.items():
        assert r.pose[3] == pytest.approx(k / 10) and images.decode(r.depth)[0, 0] == 1500 + k and len(r.k) == 9
    (tmp_path / "s" / "pose" / "11.txt").unlink()
    with pytest.raises(Exception, match="differ in number"):
        datasets.frames(spark, "scannet", root).collect()
    with pytest.raises(ValueError):
        datasets.kind_of("kitti")


def test_single_room_build(spark, tmp_path):
    config = Config.of("dataset=scannet", f"root={scene(tmp_path / 's')}", f"output=file://{tmp_path}/out", "mode=single", "fuse_every=1", "max_depth=4")
    graph = Build(spark, config).graph()
    assert [r.floor_id for r in graph.floors.collect()] == ["0"]
    assert graph.keyframes.count() == 12 and graph.objects.count() == 0
    asked = spark.createDataFrame([("q", "a view")], "query_id string, text string")
    assert graph.search_frames(asked, 3).count() == 3
    assert graph.ground(asked).first().reason == "No candidates found"
    again = Build(spark, config).graph()
    assert again.chunks.count() == graph.chunks.count()
    with pytest.raises(ValueError):
        Config.of("no_such=1")


def test_instances(spark, tmp_path):
    groups = [{"id": 1, "label": "a", "segments": [0, 1], "obb": {"centroid": [1.0, 2.0, 3.0]}}, {"id": 2, "label": "b", "segments": [1], "loc": [4.0, 5.0, 6.0]}, {"id": 3, "label": "c", "segments": []}]
    (tmp_path / "g.json").write_text(json.dumps({"segGroups": groups}))
    truth = annotations.ground_truth(spark, f"file://{tmp_path}/g.json")
    assert {r.id: (r.x, r.y, r.z) for r in truth.collect()} == {1: (1, 2, 3), 2: (4, 5, 6), 3: (0, 0, 0)}
    v = spark.createDataFrame([(k, 0.0, 0.0, 0.0) for k in range(3)], "pid long, x double, y double, z double")
    s = spark.createDataFrame([(0, 0), (1, 1), (2, 9)], "pid long, segment int")
    inst = annotations.instance_points(v, s, truth)
    assert {r.pid: r.inst for r in inst.collect()} == {0: 1, 1: 2, 2: -1}
    assert {r.id: r.n for r in annotations.points_by_object(inst, truth).collect()} == {1: 1, 2: 1, 3: 0}
    meshes = spark.createDataFrame([(0, "a.ply", 2), (1, "b.ply", 3), (2, "c.ply", 3)], "pref int, path string, n_vertices long")
    assert annotations.mesh_matching(meshes, 3).first().path == "b.ply"
    with pytest.raises(Exception, match="no mesh has 7"):
        annotations.mesh_matching(meshes, 7).collect()
    assert annotations.resolved("x/a.json", ["/r/s"])[:2] == ["/r/s/x/a.json", "/r/x/a.json"]


def test_descriptions_skip_broken_files(spark, tmp_path):
    (tmp_path / "a_vlm.json").write_text(json.dumps({"id": "0_0", "summary": {"room_summary": "a hall"}, "frames": [{"index": 3, "node_tags": ["x"]}]}))
    (tmp_path / "b_vlm.json").write_text("{broken")
    rows = annotations.frame_database(annotations.room_descriptions(spark, f"file://{tmp_path}")).collect()
    assert [(r.room_id, r.room_summary, r.total_frames, r.frame_index, r.path) for r in rows] == [("0_0", "a hall", 1, 3, "frame_3.jpg")]


def test_partitions_are_overwritten_alone(spark, tmp_path):
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame([("0", "a"), ("1", "b")], "room_id string, v string")
    sinks.save(df, folder, "e", ("room_id",))
    sinks.save(df.filter("room_id = '1'").withColumn("v", F.lit("c")), folder, "e", ("room_id",))
    assert sorted(tuple(r) for r in sinks.load(spark, folder, "e").select(F.col("room_id").cast("string"), "v").collect()) == [("0", "a"), ("1", "c")]
    lines = sinks.ply_lines(spark.createDataFrame([(1, 0.0, 1.0, 2.0, 1.0, 0.5, 0.0), (0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0)], "pid long, x double, y double, z double, r double, g double, b double")).orderBy("ord").collect()
    assert "element vertex 2" in lines[0].value and lines[1].value == "0.500000 0.000000 0.000000 0 0 0"
    o = spark.createDataFrame([("a", None, [1])], "object_id string, label string, frames array<int>")
    assert sinks.object_of_json(sinks.object_json(o), "object_id string, label string, frames array<int>").collect() == o.collect()


def test_a_failing_row_keeps_the_others(spark):
    class Failing(Provider):
        def analyze(self, queries):
            if any("bad" in q for q in queries):
                raise RuntimeError("no")
            return [{"target_object": q} for q in queries]

    register("failing", Failing)
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(["a", "bad", "c"])], "query_id string, text string").coalesce(1)
    got = {r.query_id: (r.plan.target_object, r.plan_error) for r in calls.called(df, "analyze", ["text"], "plan", calls.PLAN, "failing").collect()}
    assert got == {"0": ("a", None), "1": (None, "RuntimeError: no"), "2": ("c", None)}
    with pytest.raises(ValueError):
        make("nobody")
    plan = make().analyze(["the lamp near the bed"])[0]
    assert (plan["target_object"], plan["anchor_objects"], plan["relation_polarity"]) == ("lamp", ["bed"], "near")


def test_stream_of_detections(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "cup", 0.0, 0.0, 0.0), ("r", "2024-01-01 00:00:01", "cup", 0.2, 0.0, 0.0), ("r", "2024-01-01 00:00:02", "cup", 5.0, 0.0, 0.0)]
    ddl = "room_id string, ts timestamp, label string, x double, y double, z double"
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "room_id string, ts string, label string, x double, y double, z double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(ddl).parquet(source)
    q = sessions.running_objects(stream).writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.object, r.n, round(r.x, 3)) for r in spark.table("running").collect())
    assert got == [(0, 2, 0.1), (1, 1, 5.0)]
    s = sessions.sessions(stream.withColumnRenamed("label", "kind"), "kind", "ts").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", f"file://{tmp_path}/d").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert sessions.sessions(spark.read.parquet(source), "label", "ts").first().n == 3

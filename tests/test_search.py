"""Searches by room and calls of providers: nothing is cut off, and each query is analysed once."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import retrieval as S
from scenelake.plans import catalogue
from scenelake.plans.graph import SceneGraph

DATA = Path("/root/testdata/sf0.001")


def test_objects_of_the_room_are_all_in_reach(spark):
    """The room's objects score below thousands of others."""
    n = 3000
    near = spark.range(n).select(F.col("id").alias("pos"), F.lit("object").alias("doc_type"), F.lit("0").alias("floor_id"), F.lit("far").alias("room_id"), F.concat(F.lit("o"), "id").alias("name"), F.lit("a lamp").alias("content"))
    few = [(n + 1, "object", "0", "kitchen", "mug", "mug"), (n + 2, "object", "0", "kitchen", "pan", "pan"), (n + 3, "room", "0", "kitchen", "kitchen", "the kitchen"), (n + 4, "room", "0", "far", "far", "the hall"), (n + 5, "floor", "0", None, "floor", "ground"), (n + 6, "floor", "1", None, "floor", "upper")]
    chunks = near.unionByName(spark.createDataFrame(few, "pos long, doc_type string, floor_id string, room_id string, name string, content string"))
    at = {n + 1: [0.1, 0.0], n + 2: [0.2, 0.0]}
    vectors = chunks.select("pos", F.lit("text").alias("modality"), F.coalesce(*(F.when(F.col("pos") == k, F.array(*map(F.lit, v))) for k, v in at.items()), F.array(F.lit(1.0), F.lit(0.5))).cast("array<float>").alias("vec"))
    parsed = spark.createDataFrame([("q", "a mug", "kitchen", "0")], "query_id string, object string, room string, floor string")
    asked = spark.createDataFrame([("q", k, [1.0, 0.0]) for k in ("floor", "room", "object")], "query_id string, kind string, qvec array<float>")
    got = S.locate(chunks, vectors, asked, parsed).collect()
    assert [(r.floor_id, r.room_id, r.object_pos, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("0", "kitchen", n + 2, 1), ("0", "kitchen", n + 1, 2)]


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
def test_locate_in_a_graph(spark):
    graph = catalogue._graph(spark, str(DATA))
    asked = spark.createDataFrame([("q", "the steel box in FRANCE on floor 3")], "query_id string, text string")
    got = graph.locate(asked).collect()
    rooms = {r.room_id for r in got}
    assert len(rooms) == 1 and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(got) + 1))


def test_each_query_is_analysed_once(spark, tmp_path, monkeypatch):
    """Calls are counted in a file, as they run on workers."""
    from scenelake.providers import calls

    log, called = f"{tmp_path}/calls", calls.called

    def counted(df, name, inputs, *rest, **more):
        if name != "analyze":
            return called(df, name, inputs, *rest, **more)
        note = F.udf(lambda x, log=log: (open(log, "a").write(f"{x}\n"), x)[1])
        return called(df.withColumn("text", note("text")), name, inputs, *rest, **more)

    monkeypatch.setattr(calls, "called", counted)
    objects = spark.createDataFrame([("r", f"o{k}", "box", float(k), 0.0, 0.0, 1.0) for k in range(4)], "room_id string, object_id string, label string, x double, y double, z double, h double")
    chunks = spark.createDataFrame([(k, f"o{k}", "object", None, "r", f"steel box {k}") for k in range(4)], "pos long, id string, doc_type string, floor_id string, room_id string, content string")
    keyframes = spark.createDataFrame([], "room_id string, room_pos int, frame_index int, object_ids array<string>, path string, labeled_path string, description string")
    graph = SceneGraph(spark.createDataFrame([("0",)], "floor_id string"), spark.createDataFrame([("0", "r")], "floor_id string, room_id string"), keyframes, objects, chunks)
    asked = spark.createDataFrame([("a", "the steel box near the tin case"), ("b", "large box")], "query_id string, text string").repartition(1)
    assert graph.ground(asked).count() == 2
    with open(log) as f:
        assert sorted(f.read().split("\n"))[1:] == ["large box", "the steel box near the tin case"]


def test_every_score_is_the_product(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(7, 4)).astype(np.float32), rng.normal(size=(3, 4)).astype(np.float32)
    vectors = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "pos long, vec array<float>")
    queries = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(q)], "query_id long, qvec array<float>")
    got = {(r.query_id, r.pos): r.score for r in S.every_score(vectors, queries).collect()}
    assert got == pytest.approx({(a, b): float(q[a].astype(float) @ v[b].astype(float)) for a in range(3) for b in range(7)})

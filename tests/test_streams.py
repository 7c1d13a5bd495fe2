"""Streams over files: late rows, restarts from the checkpoint, state that goes; and kernels as SQL table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import clustering, rooms, table_functions
from scenelake.streaming import sessions

EVENTS = "user string, ts timestamp, value int"
FIRST = [("a", "10:00:00", 1), ("a", "10:20:00", 2), ("a", "11:30:00", 3), ("b", "10:05:00", 4), ("b", "12:00:00", 5)]
# 09:00 is behind the watermark of the first run (11:00), 11:50 is late but within it and joins a's open session
SECOND = [("b", "09:00:00", 6), ("a", "11:50:00", 7), ("c", "15:00:00", 8), ("b", "12:00:00", 5)]


def rows_of(spark, rows, ddl=EVENTS):
    text = ", ".join(c.replace("ts timestamp", "ts string") for c in ddl.split(", "))
    return spark.createDataFrame([tuple(f"2024-01-01 {v}" if k == 1 else v for k, v in enumerate(r)) for r in rows], text).withColumn("ts", F.to_timestamp("ts"))


@pytest.fixture
def feed(spark, tmp_path):
    """A folder that files arrive in, and the stream over it."""

    def arrive(rows, ddl=EVENTS):
        rows_of(spark, rows, ddl).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    return arrive, lambda ddl=EVENTS: spark.readStream.schema(ddl).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/work"


def state(spark, folder):
    return spark.read.format("statestore").load(f"{folder}/state")


def plain(rows):
    return sorted(tuple(str(v)[-8:] if k in ("start", "end") else v for k, v in r.asDict().items()) for r in rows.collect())


def test_sessions_over_a_restart(spark, feed):
    arrive, stream, folder = feed
    arrive(FIRST)
    got = plain(sessions.landed(sessions.sessions(stream(), "user", "ts"), folder))
    assert got == [("a", "10:00:00", "10:50:00", 2), ("b", "10:05:00", "10:35:00", 1)]
    assert state(spark, folder).count() == 2
    arrive(SECOND)
    got = plain(sessions.landed(sessions.sessions(stream(), "user", "ts"), folder))
    kept = rows_of(spark, [r for r in FIRST + SECOND if r[1] != "09:00:00"])
    assert got == plain(sessions.sessions(kept, "user", "ts").filter("end <= timestamp'2024-01-01 14:00:00'"))
    assert ("a", "11:30:00", "12:20:00", 2) in got and ("b", "12:00:00", "12:30:00", 2) in got
    assert state(spark, folder).count() == 1  # c's session is open, all others are gone
    assert plain(sessions.landed(sessions.sessions(stream(), "user", "ts"), folder)) == got  # nothing is read twice


def test_windows_over_a_restart(spark, feed):
    arrive, stream, folder = feed
    for rows in (FIRST, SECOND):
        arrive(rows)
        got = plain(sessions.landed(sessions.counts(stream(), "ts", "1 hour", by=("user",)), folder))
    kept = rows_of(spark, [r for r in FIRST + SECOND if r[1] != "09:00:00"])
    assert got == plain(sessions.counts(kept, "ts", "1 hour", by=("user",)).filter("end <= timestamp'2024-01-01 14:00:00'"))
    assert len(got) == 4 and state(spark, folder).count() == 1


def test_first_seen_over_a_restart(spark, feed):
    arrive, stream, folder = feed
    run = lambda: sorted((r.user, r.value) for r in sessions.landed(sessions.distinct(stream(), ["user", "value"], "ts"), folder).collect())
    arrive(FIRST + FIRST)
    assert run() == sorted((u, v) for u, _, v in FIRST)
    arrive(SECOND)  # b's 5 is known, 6 comes too late
    assert run() == sorted([(u, v) for u, _, v in FIRST] + [("a", 7), ("c", 8)])
    assert [r["key"]["value"] for r in state(spark, folder).collect()] == [8]
    arrive([("a", "16:00:00", 1)])  # a's 1 was forgotten
    assert run().count(("a", 1)) == 2


def test_running_objects_over_a_restart(spark, feed):
    arrive, stream, folder = feed
    ddl = "room_id string, ts timestamp, label string, x double, y double, z double"
    one = [("r", "10:00:00", "cup", 0.0, 0.0, 0.0), ("r", "10:00:01", "cup", 0.2, 0.0, 0.0), ("s", "10:00:00", "bed", 1.0, 1.0, 1.0)]
    two = [("r", "10:30:00", "cup", 0.4, 0.0, 0.0), ("r", "10:30:01", "cup", 9.0, 0.0, 0.0), ("r", "08:00:00", "cup", 0.1, 0.0, 0.0)]

    def latest():
        got = sessions.updates(sessions.running_objects(stream(ddl)), folder)
        last = got.groupBy("room_id", "object").agg(F.max_by(F.struct("label", "n", F.round("x", 6).alias("x")), "batch").alias("o"))
        return sorted((r.room_id, r.object, *r.o) for r in last.collect())

    arrive(one, ddl)
    assert latest() == [("r", 0, "cup", 2, 0.1), ("s", 0, "bed", 1, 1.0)]
    arrive(two, ddl)
    assert latest() == [("r", 0, "cup", 3, 0.2), ("r", 1, "cup", 1, 9.0), ("s", 0, "bed", 1, 1.0)]
    arrive([("t", "18:00:00", "cup", 0.0, 0.0, 0.0)], ddl)
    assert latest()[-1] == ("t", 0, "cup", 1, 0.0)
    arrive([("r", "18:30:00", "cup", 0.0, 0.0, 0.0)], ddl)  # r's state went, so its objects begin anew
    assert latest()[0] == ("r", 0, "cup", 1, 0.0)


def test_keyframes_in_sql(spark):
    rng = np.random.default_rng(3)
    rows = []
    for room in ("a", "b", "empty"):
        for k in range(0 if room == "empty" else 40):
            pose = np.eye(4)
            pose[:3, 3] = rng.normal(k // 20 * 8, 0.1, 3)
            rows.append((room, k, pose.ravel().tolist()))
    poses = spark.createDataFrame(rows, "room_id string, frame_index long, pose array<double>").repartition(3)
    table_functions.register(spark)
    poses.select("room_id", "frame_index", clustering.pose_features(F.col("pose")).alias("f")).createOrReplaceTempView("pose_rows")
    got = spark.sql("SELECT * FROM keyframes(TABLE(pose_rows) PARTITION BY room_id ORDER BY frame_index)")
    want = sorted(tuple(r) for r in clustering.keyframes(poses).collect())
    assert sorted(tuple(r) for r in got.collect()) == want and 2 <= len(want) < 80
    assert spark.sql("SELECT * FROM keyframes(TABLE(SELECT * FROM pose_rows WHERE false) PARTITION BY room_id)").count() == 0
    odd = "SELECT 'n' AS room_id, cast(null AS bigint) AS frame_index, array(1.0D, 0, 0, 0, 0, 0, 1) AS f UNION ALL SELECT 'n', 7, array(1.0D, 0, 0, 0, 0, 0, 1) UNION ALL SELECT 'n', 8, null"
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM keyframes(TABLE({odd}) PARTITION BY room_id)").collect()] == [("n", 7)]


def test_outlines_in_sql(spark):
    cells = {1: {(0, 0), (0, 1), (1, 0)}, 2: {(5, 5)}, 3: {(-2, 3), (-2, 4)}}
    df = spark.createDataFrame([(i, y, x) for i, c in cells.items() for y, x in c] + [(2, None, 1)], "region_id long, y long, x long")
    df.union(df).createOrReplaceTempView("cells")
    table_functions.register(spark)
    got = {}
    for r in spark.sql("SELECT * FROM outlines(TABLE(cells) PARTITION BY region_id) ORDER BY region_id, pos").collect():
        got.setdefault(r.region_id, []).append((r.y, r.x))
    for i, c in cells.items():
        mask = np.zeros((12, 12), bool)
        for y, x in c:
            mask[y + 3, x + 3] = True
        assert got[i] == [(y - 3, x - 3) for y, x in rooms.outline(mask)]

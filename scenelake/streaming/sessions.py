"""Detections as streams: sessions, late data and first-wins dedup within a watermark.

landed() and updates() run a stream over what its source holds now and return
what it has emitted so far. Called again with the same folder they go on from
the checkpoint: files that were read are not read again, open sessions and
windows go on, rows behind the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream with its watermark; times without a zone, which watermarks don't take, are read in the session's. Tables stay as they are."""
    if not events.isStreaming or not late:
        return events
    if isinstance(events.schema[time].dataType, T.TimestampNTZType):
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late)


def sessions(events: DataFrame, by: str, time: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """by, start, end, n of runs of events not more than gap apart; works on streams and on tables."""
    rows = watermarked(events, time, late)
    out = rows.groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def counts(events: DataFrame, time: str, width: str, slide: str | None = None, by: tuple[str, ...] = (), late: str | None = "1 hour") -> DataFrame:
    """Events in tumbling or sliding windows."""
    rows = watermarked(events, time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def distinct(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """One event for each key; on streams, state goes when the watermark passes."""
    if events.isStreaming:
        return watermarked(events, time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def landed(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that an append-mode stream has emitted into the folder: sessions and windows that the watermark has closed."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def updates(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that an update-mode stream has emitted into the folder, with the number of their batch. A repeated batch replaces its own rows."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


def running_objects(detections: DataFrame, radius: float = 0.5, late: str = "1 hour") -> DataFrame:
    """Objects of each room as detections (room_id, ts, label, x, y, z) arrive: object, n and centre after each batch.

    A detection joins the nearest object of its label within the radius, the
    first of equals, or begins one. State is a room's objects; it goes when the
    watermark passes a room.
    """
    import pandas as pd

    def update(key, batches, state):
        items = list(state.get[0]) if state.exists else []
        items = [list(i) for i in items]
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            for r in pdf.sort_values(["ts", "label", "x", "y", "z"]).itertuples():
                near = [((i[1] - r.x) ** 2 + (i[2] - r.y) ** 2 + (i[3] - r.z) ** 2, k) for k, i in enumerate(items) if i[0] == r.label]
                d, k = min(near, default=(float("inf"), -1))
                if d <= radius * radius:
                    i = items[k]
                    n = i[4] + 1
                    items[k] = [i[0], i[1] + (r.x - i[1]) / n, i[2] + (r.y - i[2]) / n, i[3] + (r.z - i[3]) / n, n]
                else:
                    items.append([r.label, r.x, r.y, r.z, 1])
        state.update(([tuple(i) for i in items],))
        if state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)
        yield pd.DataFrame([(key[0], k, *i) for k, i in enumerate(items)], columns=["room_id", "object", "label", "x", "y", "z", "n"])

    return watermarked(detections, "ts", late).groupBy("room_id").applyInPandasWithState(update, "room_id string, object int, label string, x double, y double, z double, n long", "items array<struct<label:string,x:double,y:double,z:double,n:bigint>>", "update", "EventTimeTimeout")

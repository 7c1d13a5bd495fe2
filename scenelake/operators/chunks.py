"""Retrieval chunks: building, first-wins dedup, replacement in place, content hashes and cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).filter("_r = 1").drop("_r")


def replaced(base: DataFrame, newer: DataFrame, key: str = "id") -> DataFrame:
    """Rows of base (pos, id, content) with the newer content where there is one, at their place; other newer rows after the last.

    New positions come from a running count over partitions that are counted
    first, so no single task orders all rows.
    """
    n = newer.select(F.col(key), F.col("content").alias("_new"), F.col("pos").alias("_at"))
    kept = base.join(n, key, "left").select("pos", key, F.coalesce("_new", "content").alias("content"))
    added = n.join(base.select(key), key, "left_anti")
    top = base.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("top"))
    bucket = F.floor(F.col("_at") / 100_000)
    counts = added.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    placed = added.withColumn("_b", bucket).join(before, "_b").crossJoin(F.broadcast(top))
    placed = placed.withColumn("pos", F.col("top") + F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy("_b").orderBy("_at", key)))
    return kept.unionByName(placed.select("pos", key, F.col("_new").alias("content")))


def cache_misses(chunks: DataFrame, cached: DataFrame, model: str) -> DataFrame:
    """Rows to embed: those whose content hash the cache doesn't hold for the model."""
    return chunks.join(cached.filter(F.col("model") == model).select("content_hash").distinct(), "content_hash", "left_anti")


def built(floors: DataFrame, rooms: DataFrame, frames: DataFrame, objects: DataFrame) -> DataFrame:
    """Chunks of a described scene, in the order of (ord, id): floors, then by room the room, its frames, each followed by its objects.

    floors: floor_id, caption. rooms: room_id, floor_id, room_pos, summary.
    frames: room_id, frame_pos, frame_index, description, tags. objects:
    room_id, frame_pos, object_pos, object_id, name, attributes, description,
    affordances, state, location_description, spatial_relations. Frames without
    an index give none; of objects with one id in a room, the first stays.
    """
    none = F.lit(None).cast("string")
    at = lambda *x: F.struct(*(F.coalesce(F.lit(v) if isinstance(v, int) else F.col(v).cast("long"), F.lit(-1)).cast("long").alias(f"o{i}") for i, v in enumerate(x)))
    row = lambda df, order, i, kind, floor, room, content: df.select(order.alias("ord"), i.alias("id"), F.lit(kind).alias("doc_type"), floor.alias("floor_id"), room.alias("room_id"), content.alias("content"))
    f = row(floors, at(0, -1, -1, -1), F.concat(F.lit("floor_"), "floor_id"), "floor", F.col("floor_id"), none, F.coalesce("caption", F.lit("")))
    r = row(rooms, at(1, "room_pos", -1, -1), F.concat(F.lit("room_"), "room_id"), "room", F.col("floor_id"), F.col("room_id"), F.coalesce("summary", F.lit("")))
    placed = rooms.select("room_id", "floor_id", "room_pos")
    some = frames.filter("frame_index is not null").join(placed, "room_id")
    k = row(some, at(1, "room_pos", "frame_pos", -1), F.concat_ws("_", F.lit("frame"), "room_id", "frame_index"), "frame", F.col("floor_id"), F.col("room_id"), T.ensure_text(F.col("description"), T.joined(F.col("tags"))))
    named = objects.withColumn("object_id", F.coalesce(T.given(F.col("object_id")), T.given(F.col("name")))).filter("object_id is not null")
    named = first_wins(named, ["room_id", "object_id"], ["frame_pos", "object_pos"]).join(placed, "room_id")
    body = T.object_text(*(F.col(c) for c in ("name", "object_id", "attributes", "description", "affordances", "state", "location_description", "spatial_relations")))
    o = row(named, at(1, "room_pos", "frame_pos", "object_pos"), F.col("object_id"), "object", F.col("floor_id"), F.col("room_id"), body)
    out = f.unionByName(r).unionByName(k).unionByName(o)
    return out.withColumn("content_hash", T.content_hash(F.col("id"), F.col("doc_type"), F.col("content"), F.col("floor_id"), F.col("room_id")))

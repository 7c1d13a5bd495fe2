"""Entities on disk: partitioned Parquet, and JSON and PLY exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, folder: str, entity: str, by: tuple[str, ...] = ()) -> None:
    """Overwrites what the rows' partitions hold; others stay."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{folder}/{entity}")


def load(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{entity}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize_or_load(spark: SparkSession, folder: str, entity: str, make, load_it: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The entity as written; it is made where it isn't there or must not be loaded. Cuts the lineage either way."""
    if not (load_it and exists(spark, f"{folder}/{entity}/_SUCCESS")):
        save(make(), folder, entity, by)
    return load(spark, folder, entity)


def poses_json(poses: DataFrame) -> DataFrame:
    """One row a room: its frames' 4x4 poses as JSON."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("pose", r * 4 + 1, 4))
    return poses.groupBy("room_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame_index").cast("string").alias("key"), rows.alias("value")))))).alias("value"))


def graph_json(floors: DataFrame, rooms: DataFrame, objects: DataFrame, keyframes: DataFrame) -> DataFrame:
    """One row a floor: its rooms with their objects' and keyframes' ids, as JSON."""
    ids = lambda df, c, n: df.groupBy("room_id").agg(F.array_sort(F.collect_set(c)).alias(n))
    r = rooms.select("floor_id", "room_id").join(ids(objects, "object_id", "objects"), "room_id", "left").join(ids(keyframes, "frame_index", "keyframes"), "room_id", "left")
    r = r.groupBy("floor_id").agg(F.array_sort(F.collect_list(F.struct("room_id", "objects", "keyframes"))).alias("rooms"))
    return floors.select("floor_id").join(r, "floor_id", "left").select("floor_id", F.to_json(F.struct("floor_id", "rooms")).alias("value"))


def ply_lines(points: DataFrame, parts: int = 16) -> DataFrame:
    """ord and value: an ASCII PLY of x, y, z, r, g, b. The header counts the points; lines keep pid's order."""
    names = ["x", "y", "z", "red", "green", "blue"]
    head = points.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("ord"), F.concat_ws("\n", F.lit("ply\nformat ascii 1.0"), F.concat(F.lit("element vertex "), F.col("n").cast("string")), *(F.lit(f"property {'float' if k < 3 else 'uchar'} {n}") for k, n in enumerate(names)), F.lit("end_header")).alias("value"))
    colour = lambda c: F.round(F.col(c) * 255).cast("int").cast("string")
    body = points.select(F.col("pid").alias("ord"), F.concat_ws(" ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in "xyz"), *(colour(c) for c in "rgb")).alias("value"))
    return head.unionByName(body).repartitionByRange(parts, "ord").sortWithinPartitions("ord")


def detections_json(detections: DataFrame, runs: DataFrame) -> DataFrame:
    """One row an image: boxes, scores, labels and run lengths of its masks, as JSON."""
    item = F.struct("pos", "label", "score", F.array("x1", "y1", "x2", "y2").alias("box"), "counts")
    return detections.join(runs, "mask_id", "left").groupBy("image_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("annotations"))).alias("value"))


def metric_lines(hits: DataFrame) -> DataFrame:
    """A line of text for each bucket and threshold."""
    return hits.select(F.format_string("%s=%s @%.3f: %d/%d = %.4f", "split", "value", "threshold", "hits", "total", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("total")), F.lit(0.0))).alias("value"))


def object_json(objects: DataFrame) -> DataFrame:
    return objects.select("object_id", F.to_json(F.struct(*objects.columns), {"ignoreNullFields": "false"}).alias("value"))


def object_of_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("o")).select("o.*")

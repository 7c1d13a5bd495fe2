"""Posed RGB-D scenes as frames, and their pixels.

A scene kind is a folder layout: colour, depth and pose files in the same
numeric order. Folders of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import images

#: Names of the scene kinds.
KINDS = {"hm3d": "hm3d", "hmp3d": "hm3d", "hm3dsem": "hm3d", "replica": "replica", "scannet": "scannet", "scanet": "scannet"}


def kind_of(name: str) -> str:
    if (key := name.strip().lower()) not in KINDS:
        raise ValueError(f"no scene kind {name}; there are {', '.join(sorted(KINDS))}")
    return KINDS[key]


def numbered(files: DataFrame) -> DataFrame:
    """frame_index: rank of a file by the numbers in its name, then the name. The list of one scene's files is its group."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    number = F.coalesce(F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*$', 1) as bigint)"), F.lit(-1))
    return files.withColumn("frame_index", (F.row_number().over(Window.partitionBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).orderBy(number, name)) - 1).cast("int"))


def _files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """frame_index and path of files, without their content."""
    return numbered(spark.read.format("binaryFile").load(path).select("path")).withColumnRenamed("path", name)


def _with_content(spark: SparkSession, listed: DataFrame, path: str, name: str) -> DataFrame:
    got = spark.read.format("binaryFile").load(path).select(F.col("path").alias(f"{name}_path"), F.col("content").alias(name))
    return listed.join(got, f"{name}_path")


def _same_length(listed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that lack a file of one kind are an error."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return listed.withColumn("frame_index", F.when(whole, F.col("frame_index")).otherwise(F.raise_error("colour, depth and pose files differ in number").cast("int")))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def scannet(spark: SparkSession, root: str) -> DataFrame:
    """color/*, depth/*, pose/*.txt, intrinsic/intrinsic_depth.txt."""
    listed = _files(spark, f"{root}/color/*", "rgb_path").join(_files(spark, f"{root}/depth/*", "depth_path"), "frame_index", "full")
    poses = numbered(_texts(spark, f"{root}/pose/*.txt")).select("frame_index", G.matrix_of(F.col("value")).alias("pose"))
    k = _texts(spark, f"{root}/intrinsic/intrinsic_depth.txt").select(G.camera_of(G.matrix_of(F.col("value"))).alias("k")).limit(1)
    return _frames(spark, _same_length(listed.join(poses, "frame_index", "full"), ["rgb_path", "depth_path", "pose"]), root, ("color/*", "depth/*")).crossJoin(F.broadcast(k)).withColumn("depth_scale", F.lit(1000.0))


def hm3d(spark: SparkSession, root: str) -> DataFrame:
    """rgb/*, depth/*, pose/*: one line of 16 numbers; the camera looks along -z and spans 90 degrees."""
    listed = _files(spark, f"{root}/rgb/*", "rgb_path").join(_files(spark, f"{root}/depth/*", "depth_path"), "frame_index", "full")
    poses = numbered(_texts(spark, f"{root}/pose/*")).select("frame_index", G.flipped_camera(G.matrix_of(F.col("value"))).alias("pose"))
    frames = _frames(spark, _same_length(listed.join(poses, "frame_index", "full"), ["rgb_path", "depth_path", "pose"]), root, ("rgb/*", "depth/*"))
    return frames.withColumn("k", F.lit(None).cast("array<double>")).withColumn("depth_scale", F.lit(1000.0))


def replica(spark: SparkSession, root: str) -> DataFrame:
    """results/frame*, results/depth*, traj.txt with a pose a line, ../cam_params.json with the camera and the depth scale."""
    listed = _files(spark, f"{root}/results/frame*", "rgb_path").join(_files(spark, f"{root}/results/depth*", "depth_path"), "frame_index", "full")
    lines = _texts(spark, f"{root}/traj.txt").select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("frame_index", "line"))
    poses = lines.select("frame_index", G.matrix_of(F.col("line")).alias("pose"))
    parent = root.rstrip("/").rpartition("/")[0]
    c = F.col("camera")
    zero, one = F.lit(0.0), F.lit(1.0)
    camera = spark.read.schema("camera struct<fx:double,fy:double,cx:double,cy:double,scale:double>").json(f"{parent}/cam_params.json", multiLine=True)
    camera = camera.select(F.array(c.fx, zero, c.cx, zero, c.fy, c.cy, zero, zero, one).alias("k"), c.scale.alias("depth_scale")).limit(1)
    # a frame beyond the trajectory has no pose
    return _frames(spark, _same_length(listed, ["rgb_path", "depth_path"]).join(poses, "frame_index", "left"), root, ("results/frame*", "results/depth*")).crossJoin(F.broadcast(camera))


def _frames(spark: SparkSession, listed: DataFrame, root: str, where: tuple[str, str]) -> DataFrame:
    return _with_content(spark, _with_content(spark, listed, f"{root}/{where[0]}", "rgb"), f"{root}/{where[1]}", "depth").select("frame_index", "rgb", "depth", "pose")


def frames(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """frame_index, rgb, depth, pose, k, depth_scale of a scene. k is null where the image's size gives it."""
    return {"scannet": scannet, "hm3d": hm3d, "replica": replica}[kind_of(kind)](spark, root)


def pixels(frame_table: DataFrame) -> DataFrame:
    """frame_index, u, v, h, w, depth, r, g, b of every pixel with a depth; colours at the nearest pixel where sizes differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            depth, rgb = images.decode(row["depth"]), images.decode(row["rgb"])
            h, w = depth.shape[:2]
            v, u = np.nonzero(depth)
            ry, rx = v * rgb.shape[0] // h, u * rgb.shape[1] // w
            colour = rgb[ry, rx] if rgb.ndim == 3 else np.repeat(rgb[ry, rx][:, None], 3, 1)
            n = len(u)
            columns = [np.full(n, row["frame_index"], np.int32), u.astype(np.int32), v.astype(np.int32), np.full(n, h, np.int32), np.full(n, w, np.int32), depth[v, u].astype(np.float64), *(colour[:, c].astype(np.int32) for c in range(3))]
            for k in range(0, n, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], ["frame_index", "u", "v", "h", "w", "depth", "r", "g", "b"])

    return frame_table.select("frame_index", "rgb", "depth").mapInArrow(run, "frame_index int, u int, v int, h int, w int, depth double, r int, g int, b int")


def camera(frame_table: DataFrame, pixel_table: DataFrame) -> DataFrame:
    """The frames with k where it follows from the image's size."""
    size = pixel_table.groupBy("frame_index").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    own: Column = F.coalesce("k", G.field_of_view_camera(F.col("h"), F.col("w")))
    return frame_table.select("frame_index", "pose", "k", "depth_scale").join(size, "frame_index").withColumn("k", own)

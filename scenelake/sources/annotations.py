"""Ground truth, annotations, scene descriptions and frame databases from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import points as P

AGGREGATION = "segGroups array<struct<id:int,label:string,segments:array<int>,obb:struct<centroid:array<double>>,loc:array<double>>>"
ROOM = "id string, summary string, frames array<struct<index:int,path:string,node_tags:array<string>,description:string>>"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """id, label, x, y, z of annotated objects: the box's centroid, else the place given, else 0."""
    rows = spark.read.schema(AGGREGATION).json(path, multiLine=True).select(F.posexplode("segGroups").alias("pos", "g"))
    at = F.coalesce("g.obb.centroid", "g.loc", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return rows.select("pos", "g.id", "g.label", "g.segments", *(F.coalesce(F.get(at, F.lit(k)), F.lit(0.0)).alias(c) for k, c in enumerate("xyz")))


def instance_points(vertices: DataFrame, segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Vertices (pid, x, y, z) with inst: the last group that holds their segment (pid, segment), -1 without one."""
    exploded = groups.select("pos", "id", F.explode("segments").alias("segment"))
    last = exploded.groupBy("segment").agg(F.max_by("id", "pos").alias("inst"))
    return vertices.join(segments, "pid", "left").join(last, "segment", "left").withColumn("inst", F.coalesce("inst", F.lit(-1))).drop("segment")


def points_by_object(instances: DataFrame, groups: DataFrame) -> DataFrame:
    """id, n, points of every annotated object, also of those without points."""
    own = instances.groupBy(F.col("inst").alias("id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pid", "x", "y", "z"))).alias("points"))
    return groups.select("id").distinct().join(own, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mesh_matching(candidates: DataFrame, n_segments: int) -> DataFrame:
    """The first candidate (pref, path, n_vertices) with as many vertices as segments; an error that names the counts without one."""
    best = candidates.filter(F.col("n_vertices") == n_segments).agg(F.min_by("path", "pref").alias("path"))
    counts = candidates.agg(F.array_join(F.array_sort(F.collect_list(F.col("n_vertices").cast("string"))), ", ").alias("c"))
    none = F.raise_error(F.concat(F.lit(f"no mesh has {n_segments} vertices; there are "), "c")).cast("string")
    return best.crossJoin(F.broadcast(counts)).select(F.when(F.col("path").isNotNull(), F.col("path")).otherwise(none).alias("path"))


def nr3d(spark: SparkSession, path: str) -> DataFrame:
    """Annotations, of a file or of all files below a folder; those of one ann_id are last-wins by file and place."""
    from ..schema import DDL

    reader = spark.read.schema(DDL["annotations"]).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    rows = reader.json(path, multiLine=True).withColumn("_f", F.col("_metadata.file_path")).withColumn("_p", F.monotonically_increasing_id())
    best = F.max_by(F.struct(*(c for c in rows.columns if c[0] != "_")), F.struct("_f", "_p"))
    return rows.groupBy(F.col("ann_id").alias("_k")).agg(best.alias("m")).select("m.*")


def room_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Rooms of description files below a folder; broken files are skipped."""
    rows = spark.read.schema(ROOM + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_vlm.json").json(path, multiLine=True)
    return rows.filter("id is not null").select("id", "summary", "frames")


def frame_database(rooms: DataFrame) -> DataFrame:
    """One row for each room and frame, with the room's summary and number of frames."""
    rows = rooms.select(F.col("id").alias("room_id"), F.coalesce(F.get_json_object("summary", "$.room_summary"), "summary", F.lit("")).alias("room_summary"), F.size("frames").alias("total_frames"), F.posexplode("frames").alias("frame_pos", "f"))
    return rows.select("room_id", "room_summary", "total_frames", "frame_pos", F.col("f.index").alias("frame_index"), F.coalesce("f.path", F.concat(F.lit("frame_"), F.col("f.index").cast("string"), F.lit(".jpg"))).alias("path"), F.col("f.node_tags").alias("tags"), F.col("f.description").alias("description"))


def floors_of(summaries: DataFrame, folders: DataFrame) -> DataFrame:
    """floor_id and caption of floors that have a summary or a folder."""
    return summaries.join(folders.select("floor_id").distinct(), "floor_id", "full").select("floor_id", F.coalesce("caption", F.lit("")).alias("caption"))


def nodes_with_parts(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """Objects and their functional elements as rows of one table; parent_id and is_functional tell them apart."""
    own = objects.select("room_id", "object_id", "label", F.lit(None).cast("string").alias("parent_id"), F.lit(False).alias("is_functional"))
    return own.unionByName(parts.select("room_id", "object_id", "label", "parent_id", F.lit(True).alias("is_functional")))


def rooms_described(rooms: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Every room with its summary and frames, null without a description."""
    return rooms.join(descriptions.select(F.col("id").alias("room_id"), "summary", "frames"), "room_id", "left")


def floors_measured(floors: DataFrame, points: DataFrame) -> DataFrame:
    """Every floor with how many points lie in its height, 0 without any. Points are counted by floor before they meet."""
    n = P.in_bands(points, floors.select("floor_id", "low", "high"), "y", "floor_id").groupBy("floor_id").agg(F.count("*").alias("n_points"))
    return floors.join(n, "floor_id", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def resolved(path: str, roots: list[str]) -> list[str]:
    """Places to look for a relative path, in order: below each root and its ten parents, then what follows '/segmentation/' below each root."""
    if "://" in path or path.startswith("/"):
        return [path]
    out = []
    for root in roots:
        at = root.rstrip("/")
        for _ in range(11):
            out.append(f"{at}/{path}")
            if "/" not in at.removeprefix("file://").lstrip("/"):
                break
            at = at.rpartition("/")[0]
    tail = path.rpartition("/segmentation/")[2] if "/segmentation/" in path else None
    return out + [f"{r.rstrip('/')}/segmentation/{tail}" for r in roots if tail]

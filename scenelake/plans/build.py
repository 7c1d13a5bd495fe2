"""The build of a scene graph from posed frames, stage by stage.

Each stage is made or read; what it wrote cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as G
from ..functions import text as T
from ..operators import chunks as C
from ..operators import clustering as K
from ..operators import masks as M
from ..operators import objects as O
from ..operators import points as P
from ..operators import rooms as R
from ..providers import maker
from ..sources import datasets, sinks
from .graph import SceneGraph


class Build:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.load = set(filter(None, config.load.split(",")))
        self._inclusive = datasets.kind_of(config.dataset) == "scannet"  # that kind's range holds its bounds

    def _kept(self, entity: str, make, stage: str, by: tuple[str, ...] = ()) -> DataFrame:
        return sinks.materialize_or_load(self.spark, self.config.folder, entity, make, stage in self.load, by)

    def segmentation(self, frames: DataFrame) -> dict[str, DataFrame]:
        """points, floors, rooms, poses (with their room), keyframes."""
        c = self.config
        pixels = datasets.pixels(P.every_kth(frames, c.fuse_every))
        cameras = datasets.camera(frames, pixels)
        cloud = lambda: P.voxel_means(P.from_depth(pixels, cameras, c.min_depth, c.max_depth, self._inclusive, None), c.voxel, values=("x", "y", "z", "r", "g", "b"))
        points = self._kept("points", cloud, "segmentation")
        if c.mode == "single":
            one, room = R.single_floor_room(points)
            floors = self._kept("floors", lambda: one, "segmentation")
            rooms = self._kept("rooms", lambda: room.withColumn("polygon", F.lit(None).cast("array<struct<x:double,z:double>>")), "segmentation")
        else:
            floors = self._kept("floors", lambda: K.floors(points), "segmentation")
            rooms = self._kept("rooms", lambda: R.rooms(points, floors), "segmentation")
        poses = self._kept("poses", lambda: R.poses_in_rooms(frames.select("frame_index", "pose"), floors, rooms).join(frames.select("frame_index", "pose"), "frame_index"), "segmentation")
        keyframes = self._kept("keyframes", lambda: K.keyframes(poses, c.min_cluster_size, c.rotation_weight), "segmentation")
        return {"points": points, "floors": floors, "rooms": rooms, "poses": poses, "keyframes": keyframes}

    def objects(self, frames: DataFrame, scene: dict[str, DataFrame]) -> DataFrame:
        """Merged objects of each room from detections in keyframes."""
        c = self.config
        use = scene["keyframes"].join(scene["poses"], ["room_id", "frame_index"])
        if c.max_frames > 0:
            use = use.withColumn("_r", F.row_number().over(Window.partitionBy("room_id").orderBy("frame_index"))).filter(F.col("_r") <= c.max_frames).drop("_r")
        chosen = frames.join(use.select("room_id", "frame_index"), "frame_index")
        found = self._kept("detections", lambda: detections(chosen, c.provider), "objects")
        pixels = datasets.pixels(chosen)
        size = pixels.groupBy("frame_index").agg(F.max("h").alias("h"), F.max("w").alias("w"))
        boxes = M.not_full_image(found.join(size, "frame_index")).select("room_id", "frame_index", "det", "label", "x1", "y1", "x2", "y2")
        # points keep the pixels that they come from
        seen = P.from_depth(pixels, datasets.camera(chosen, pixels), c.min_depth, c.max_depth, self._inclusive, None, keep=("u", "v"))
        own = seen.join(boxes, "frame_index").filter("u between x1 and x2 and v between y1 and y2")
        thin = P.voxel_means(own.select("room_id", "frame_index", "det", "label", "x", "y", "z"), 0.01, ["room_id", "frame_index", "det", "label"])
        rows = thin.groupBy("room_id", "frame_index", "det", "label").agg(F.collect_list(F.array("x", "y", "z")).alias("xyz"))
        rows = rows.select("room_id", (F.col("frame_index").cast("long") * 100_000 + F.col("det")).alias("pos"), F.concat_ws("_", F.lit("obj"), "frame_index", "det").alias("object_id"), "label", "xyz", F.array(F.col("frame_index").cast("int")).alias("frame_indices"))
        merged = lambda: O.merge(rows, c.merge_threshold, again=c.merge_again_threshold)
        return self._kept("objects", merged, "objects")

    def descriptions(self, frames: DataFrame, scene: dict[str, DataFrame], objects: DataFrame) -> DataFrame:
        """Frame descriptions of keyframes, with the labels of objects seen in them."""
        seen = objects.select("room_id", F.explode("frame_indices").alias("frame_index"), "label").groupBy("room_id", "frame_index").agg(F.array_sort(F.collect_set("label")).alias("labels"))
        rows = scene["keyframes"].join(frames.select("frame_index", "rgb"), "frame_index").join(seen, ["room_id", "frame_index"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
        return self._kept("descriptions", lambda: described(rows, self.config.provider), "descriptions")

    def graph(self) -> SceneGraph:
        c = self.config
        frames = datasets.frames(self.spark, c.dataset, c.root)
        scene = self.segmentation(frames)
        objects = self.objects(frames, scene)
        said = self.descriptions(frames, scene, objects)
        text = said.select("room_id", "frame_index", T.frame_description(F.col("raw")).alias("d"), "labels")
        rooms = scene["rooms"].select("room_id", "floor_id", F.xxhash64("room_id").alias("room_pos"), F.lit("").alias("summary"))
        listed = objects.select("room_id", F.lit(0).alias("frame_pos"), F.lit(0).alias("object_pos"), "object_id", F.col("label").alias("name"), *(F.array().cast("array<string>").alias(a) for a in ("attributes", "affordances", "spatial_relations")), *(F.lit(None).cast("string").alias(a) for a in ("description", "state", "location_description")))
        described_frames = text.select("room_id", F.col("frame_index").alias("frame_pos"), "frame_index", F.col("d.description").alias("description"), F.col("labels").alias("tags"))
        made = lambda: C.built(scene["floors"].withColumn("caption", F.lit("")), rooms, described_frames, listed).withColumn("pos", F.abs(F.xxhash64("doc_type", "room_id", "id")))
        chunks = self._kept("chunks", made, "descriptions")
        centre = lambda k: F.aggregate("xyz", F.lit(0.0), lambda s, p: s + p[k]) / F.size("xyz")
        heights = F.transform("xyz", lambda p: p[1])
        placed = objects.select("room_id", "object_id", "label", *(centre(k).alias(c_) for k, c_ in enumerate("xyz")), (F.array_max(heights) - F.array_min(heights)).alias("h"))
        ids = objects.select("room_id", F.explode("frame_indices").alias("frame_index"), "object_id").groupBy("room_id", "frame_index").agg(F.collect_set("object_id").alias("object_ids"))
        keyframes = scene["keyframes"].join(ids, ["room_id", "frame_index"], "left").join(text.select("room_id", "frame_index", F.col("d.description").alias("description")), ["room_id", "frame_index"], "left").select("room_id", F.lit(0).alias("room_pos"), "frame_index", "object_ids", F.lit(None).cast("string").alias("labeled_path"), F.concat(F.lit("frame_"), F.col("frame_index").cast("string")).alias("path"), "description")
        return SceneGraph(scene["floors"], scene["rooms"], keyframes, placed, chunks, provider=c.provider)


def detections(frames: DataFrame, provider: str) -> DataFrame:
    """room_id, frame_index, det, label, score and box of what a provider finds in each frame; tags come from it too."""
    make = maker(provider)

    def run(batches):
        import pyarrow as pa

        client = make()
        schema = pa.schema([("room_id", pa.string()), ("frame_index", pa.int32()), ("det", pa.int32()), ("label", pa.string()), *((x, pa.float64()) for x in ("score", "x1", "y1", "x2", "y2"))])
        for b in batches:
            rows = b.to_pylist()
            tags = client.tag([r["rgb"] for r in rows])
            found = client.detect([r["rgb"] for r in rows], tags)
            out = [{"room_id": r["room_id"], "frame_index": r["frame_index"], "det": k, **d} for r, ds in zip(rows, found, strict=True) for k, d in enumerate(ds)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return frames.select("room_id", "frame_index", "rgb").mapInArrow(run, "room_id string, frame_index int, det int, label string, score double, x1 double, y1 double, x2 double, y2 double")


def described(rows: DataFrame, provider: str) -> DataFrame:
    make = maker(provider)

    def run(batches):
        import pyarrow as pa

        client = make()
        for b in batches:
            raw = client.describe(b.column("rgb").to_pylist(), b.column("labels").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("room_id"), b.column("frame_index"), b.column("labels"), pa.array(raw, pa.string())], ["room_id", "frame_index", "labels", "raw"])

    return rows.select("room_id", "frame_index", "labels", "rgb").mapInArrow(run, "room_id string, frame_index int, labels array<string>, raw string")


def evaluate(graph: SceneGraph, annotations: DataFrame, truth: DataFrame, thresholds=(0.001, 0.1, 0.25)) -> DataFrame:
    """Hits of all annotations' groundings, as one plan. truth: id, low, high (arrays of 3); graph.objects have low and high too."""
    from ..operators import evaluation as E

    asked = annotations.filter(F.trim("utterance") != "").select(F.col("ann_id").alias("query_id"), F.col("utterance").alias("text"))
    found = graph.ground(asked).select(F.col("query_id").alias("ann_id"), "object_id")
    boxes = graph.objects.select("object_id", F.col("low").alias("plow"), F.col("high").alias("phigh")).dropDuplicates(["object_id"])
    real = truth.select(F.col("id").cast("string").alias("target_id"), F.col("low").alias("glow"), F.col("high").alias("ghigh"))
    box = lambda p: ([F.col(f"{p}low")[k] for k in range(3)], [F.col(f"{p}high")[k] for k in range(3)])
    rows = annotations.join(found, "ann_id").join(boxes, "object_id", "left").join(real, "target_id", "left").withColumn("iou", F.coalesce(G.iou(box("p"), box("g")), F.lit(0.0)))
    return E.hits(rows, thresholds)

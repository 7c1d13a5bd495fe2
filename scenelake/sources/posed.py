"""`posed_frames`: scenes of all kinds as a Spark data source whose partitions are ranges of frames.

    spark.dataSource.register(PosedFrames)
    spark.read.format("posed_frames").option("kind", "scannet").option("last", 99).load(root)

Only names are listed when the query is planned. The options first, last and
every choose the frames before any file is opened, and each task opens the
files of its own frames. Conditions are not pushed into the source: with Spark
4.1.2, a query on a loaded DataFrame that pushed nothing got the partitions of
an earlier query on it that had pushed a condition, and so missed frames.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .datasets import kind_of

#: Folders (and first letters of names) of colour, depth and pose files by scene kind. Fixed values of the layouts.
LAYOUT = {
    "scannet": (("color", ""), ("depth", ""), ("pose", "")),
    "hm3d": (("rgb", ""), ("depth", ""), ("pose", "")),
    "replica": (("results", "frame"), ("results", "depth"), None),
}
_SCHEMA = "frame_index int, rgb binary, depth binary, pose array<double>, k array<double>, depth_scale double"
_ARROW = pa.schema([("frame_index", pa.int32()), ("rgb", pa.binary()), ("depth", pa.binary()), ("pose", pa.list_(pa.float64())), ("k", pa.list_(pa.float64())), ("depth_scale", pa.float64())])


@dataclass
class FrameRange(InputPartition):
    """Frames of one task: index, paths of colour, depth and pose; a pose's text where all are in one file."""

    frames: list[tuple[int, str, str, str | None, str | None]]
    k: list[float] | None
    depth_scale: float


def _order(name: str) -> tuple[int, str]:
    """Files are in the order of the last number in their names, then of the names."""
    digits = re.search(r"([0-9]+)[^0-9]*$", name)
    return (int(digits[1]) if digits else -1, name)


def _numbers(text: str) -> list[float]:
    return [float(x) for x in text.split()]


def _square(numbers: list[float], what: str) -> list[float]:
    """3x3 of a 3x3 or 4x4 matrix."""
    if len(numbers) not in (9, 16):
        raise ValueError(f"{what} has {len(numbers)} numbers")
    return numbers if len(numbers) == 9 else [numbers[4 * r + c] for r in range(3) for c in range(3)]


class _Scene:
    """A scene's files, from the driver or a task. Local, HDFS, S3 and GCS folders."""

    def __init__(self, root: str, kind: str):
        self.files, self.root = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        self.kind = kind_of(kind)

    def read(self, path: str) -> bytes:
        with self.files.open_input_stream(path) as f:
            return f.read()

    def names(self, folder: str, first: str = "") -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(posixpath.join(self.root, folder)))
        return [x.path for x in sorted((x for x in found if x.is_file and x.base_name.startswith(first) and x.base_name[0] not in "._"), key=lambda x: _order(x.base_name))]

    def listed(self) -> list[tuple[int, str, str, str | None, str | None]]:
        rgb, depth, pose = ([] if x is None else self.names(*x) for x in LAYOUT[self.kind])
        if self.kind == "replica":  # a frame beyond the trajectory has no pose
            lines = [x for x in self.read(posixpath.join(self.root, "traj.txt")).decode().split("\n") if x.strip()]
            texts, pose = [lines[k] if k < len(lines) else None for k in range(len(rgb))], [None] * len(rgb)
        else:
            texts = [None] * len(rgb)
        if not len(rgb) == len(depth) == len(pose):
            raise ValueError(f"colour, depth and pose files differ in number: {len(rgb)}, {len(depth)}, {len(pose)}")
        return list(zip(range(len(rgb)), rgb, depth, pose, texts, strict=True))

    def camera(self) -> tuple[list[float] | None, float]:
        """The depth images' matrix, null where the image's size gives it, and how many units a metre has."""
        if self.kind == "hm3d":
            return None, 1000.0
        if self.kind == "scannet":
            name = posixpath.join(self.root, "intrinsic/intrinsic_depth.txt")
            return _square(_numbers(self.read(name).decode()), name), 1000.0
        c = json.loads(self.read(posixpath.join(posixpath.dirname(self.root.rstrip("/")), "cam_params.json")))["camera"]
        return [float(x) for x in (c["fx"], 0, c["cx"], 0, c["fy"], c["cy"], 0, 0, 1)], float(c["scale"])

    def pose(self, path: str | None, text: str | None) -> list[float] | None:
        if path is None and text is None:
            return None
        m = _numbers(text if path is None else self.read(path).decode())
        if len(m) != 16:
            raise ValueError(f"a pose has {len(m)} numbers, not 16: {path or text}")
        return [x * (-1.0 if self.kind == "hm3d" and k % 4 in (1, 2) else 1.0) for k, x in enumerate(m)]  # an hm3d camera looks along -z


class PosedFramesReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options or "kind" not in options:
            raise ValueError("posed_frames asks for a path and the option kind")
        self.root, self.kind = options["path"], kind_of(options["kind"])
        self.each, self.every = int(options.get("framesperpartition", 16)), int(options.get("every", 1))
        if self.each < 1 or self.every < 1:
            raise ValueError("framesPerPartition and every are at least 1")
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def partitions(self) -> list[FrameRange]:
        scene = _Scene(self.root, self.kind)
        k, scale = scene.camera()
        kept = [f for f in scene.listed() if f[0] >= self.first and (self.last is None or f[0] <= self.last) and f[0] % self.every == 0]
        return [FrameRange(kept[i : i + self.each], k, scale) for i in range(0, len(kept), self.each)] or [FrameRange([], k, scale)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        scene = _Scene(self.root, self.kind)
        for index, rgb, depth, pose, text in partition.frames:  # one frame at a time is in memory
            row = {"frame_index": index, "rgb": scene.read(rgb), "depth": scene.read(depth), "pose": scene.pose(pose, text), "k": partition.k, "depth_scale": partition.depth_scale}
            yield pa.RecordBatch.from_pylist([row], _ARROW)


class PosedFrames(DataSource):
    """frame_index, rgb, depth, pose, k and depth_scale of a scene, as datasets.frames has them.

    Options: kind; framesPerPartition (16); first and last frame (all); every, to keep those that it divides (1).
    """

    @classmethod
    def name(cls) -> str:
        return "posed_frames"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> PosedFramesReader:
        return PosedFramesReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session."""
    from ..shipping import ship

    ship(spark).dataSource.register(PosedFrames)
    return spark

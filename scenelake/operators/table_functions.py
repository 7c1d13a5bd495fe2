"""Kernels as table functions of SQL: a group of rows in, rows out.

After register(spark):
    SELECT * FROM keyframes(TABLE(pose_rows) PARTITION BY room_id ORDER BY frame_index)
    SELECT * FROM outlines(TABLE(cells) PARTITION BY region_id)
A partition is one group in one task, as in the DataFrame calls: a room's
frames, a region's cells. Rows with nulls in the columns that are read are left
out; a partition without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from .clustering import representative
from .rooms import outline


@F.udtf(returnType="room_id string, frame_index long")
class Keyframes:
    """room_id and frame_index of a room's keyframes; rows: room_id, frame_index, f (pose_features of the pose)."""

    def __init__(self):
        self.room, self.rows = None, []

    def eval(self, row: Row) -> None:
        self.room = row["room_id"]
        if row["frame_index"] is not None and row["f"] is not None:
            self.rows.append((row["frame_index"], row["f"]))

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            self.rows.sort(key=lambda r: r[0])
            for k in representative(np.array([f for _, f in self.rows], np.float64)):
                yield self.room, self.rows[k][0]


@F.udtf(returnType="region_id long, pos int, y long, x long")
class Outlines:
    """Corners of a region's outer border, in order; rows: region_id, y, x of its cells."""

    def __init__(self):
        self.region, self.cells = None, set()

    def eval(self, row: Row) -> None:
        self.region = row["region_id"]
        if row["y"] is not None and row["x"] is not None:
            self.cells.add((row["y"], row["x"]))

    def terminate(self) -> Iterator[tuple]:
        if self.cells:
            at = np.array(sorted(self.cells))
            low = at.min(axis=0)
            region = np.zeros(at.max(axis=0) - low + 1, bool)
            region[tuple((at - low).T)] = True
            for k, (y, x) in enumerate(outline(region)):
                yield self.region, k, int(y + low[0]), int(x + low[1])


def register(spark: SparkSession) -> None:
    spark.udtf.register("keyframes", Keyframes)
    spark.udtf.register("outlines", Outlines)

"""The shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of our own in local mode and an error on a cluster, whose executors would not see it."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/scene-work"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows in the shared folder, read again."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> str:
    """Where the rows are in the shared folder, for tasks that go through all of them in turn."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def batches(path: str, columns: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """On a worker: the rows that stored() wrote, about so many at a time."""
    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    kept, n = [], 0
    for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")):
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(rows, columns=list(columns)):
                if kept and n + len(batch) > rows:
                    yield pa.Table.from_batches(kept)
                    kept, n = [], 0
                kept, n = [*kept, batch], n + len(batch)
    if n:
        yield pa.Table.from_batches(kept)


def gathered(parts: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's rows, so many at a time."""
    kept, n = [], 0
    for part in parts:
        while part.num_rows:
            kept.append(part.slice(0, rows - n))
            n, part = n + kept[-1].num_rows, part.slice(rows - n)
            if n == rows:
                yield pa.Table.from_batches(kept)
                kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept)


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    if digits is None:
        return x
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def in_order(parts: Iterable[Sequence[np.ndarray]], digits: int | None, rows: int) -> Iterator[list[np.ndarray]]:
    """The same rows, given as columns of which the last is a number rounded to so many digits.

    About so many rows are held at once and leave from their least number on,
    so equal numbers are written as one stretch and take less room in a file
    than in any order of the keys. Without digits rows stay as they are.
    """
    if digits is None:
        yield from (list(part) for part in parts)
        return
    held, n = None, 0
    for part in parts:
        held, done = held or [np.empty(rows, x.dtype) for x in part], 0
        while done < len(part[-1]):
            taken = min(rows - n, len(part[-1]) - done)
            for column, x in zip(held, part, strict=True):
                column[n : n + taken] = x[done : done + taken]
            n, done = n + taken, done + taken
            if n == rows:
                yield from _by_last(held, digits)
                n = 0
    if n:
        yield from _by_last([column[:n] for column in held], digits)


def _by_last(columns: list[np.ndarray], digits: int, rows: int = 131_072) -> Iterator[list[np.ndarray]]:
    x, bits = columns[-1], len(columns[-1]).bit_length()
    most = 2.0 ** (62 - bits) / 10.0**digits
    if x.max() < most and x.min() > -most:  # number and place in one key
        order = np.arange(len(x))
        for n in range(0, len(x), rows):
            order[n : n + rows] |= np.rint(x[n : n + rows] * 10.0**digits).astype(np.int64) << bits
        order.sort()
        order &= (1 << bits) - 1
    else:
        order = np.argsort(x, kind="stable")
    for n in range(0, len(x), rows):
        yield [c[order[n : n + rows]] for c in columns]

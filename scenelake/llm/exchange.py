"""Blocks of documents and the packed messages that they exchange with buckets of keys.

Documents are cut into blocks of bounded bytes. A block sends each bucket the
distinct keys (words, shingles, windows) that it holds, packed into one binary
value; a bucket merges what all blocks have sent and answers each message. So a
key costs one entry a block however often it occurs, no group of rows is ever
dealt by a hot key, and shuffles carry compressed arrays instead of rows. What a
block keeps between the steps is a file in the shared folder; only messages and
answers are shuffled. The number of buckets follows the bytes of the input.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_files

#: Bytes of text in a block, at least one document; and of text for each bucket of keys.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


def released() -> None:
    """Gives memory that a block has used back to the system, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives memory back after each of its own."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            released()
        released()

    return out


def workdir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names. Without one, a folder of our own in local mode; an error on a cluster, whose executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/corpus-work"
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes folders whose tables nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: the lineage ends here."""
    df.write.option("compression", "none").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.select(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def input_bytes(docs: DataFrame) -> int:
    """Bytes of what the rows are read from, as files say, without a scan; of the text where the plan doesn't know."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return known if known < 1 << 58 else text_bytes(docs)


def deal(spark: SparkSession, n_bytes: int, each: int = BUCKET_BYTES) -> int:
    """Number of buckets: as bytes ask for, and a few for each core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // each))


def spread_join(rows: DataFrame, keyed: DataFrame, on: str | list[str], weight: str, total: int, least: int = 1000, how: str = "inner") -> DataFrame:
    """Join (inner or left) with a table of unique keys that knows, as weight, how many rows each key has; total: of all rows.

    Keys of more than `least` rows and of more than one in 100000 of all are at
    most 100000, so they are broadcast; their rows stay where they are. Others
    are shuffled. So no task gets the rows of a hot key.
    """
    on = [on] if isinstance(on, str) else on
    limit = max(least, total // 100_000)
    rest = [c for c in keyed.columns if c != weight]
    hot = F.broadcast(keyed.filter(F.col(weight) > limit).select(*rest))
    names = F.broadcast(keyed.filter(F.col(weight) > limit).select(*on))
    cold = rows.join(names, on, "left_anti").join(keyed.filter(F.col(weight) <= limit).select(*rest), on, how)
    return rows.join(hot, on).unionByName(cold)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; integers by planes of bytes."""
    head, parts = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append((a.dtype.str, len(a)))
        parts.append((a.view(np.uint8).reshape(-1, a.dtype.itemsize).T if a.dtype.itemsize > 1 else a).tobytes())
    meta = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level).compress(struct.pack("<I", len(meta)) + meta + b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (size,) = struct.unpack_from("<I", data)
    at, out = 4 + size, []
    for kind, n in json.loads(data[4:at]):
        t = np.dtype(kind)
        raw = np.frombuffer(data, np.uint8, n * t.itemsize, at)
        at += n * t.itemsize
        out.append(np.ascontiguousarray(raw.reshape(t.itemsize, n).T).view(t).ravel() if t.itemsize > 1 else raw)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed values: the constants of splitmix64)."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1 << 12, np.uint64)
np.multiply.accumulate(np.full((1 << 12) - 1, 0x9E3779B97F4A7C15, np.uint64), out=_POWERS[1:])


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; very long ones are hashed in stretches."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    if not len(data):
        return mix(size.astype(np.uint64) + np.uint64(77))
    at = np.arange(len(data)) - np.repeat(bounds[:-1], size)
    value = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095]
    if len(long := np.flatnonzero(at >= 4096)):
        value[long] = mix(value[long] + (at[long] >> 12).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64))


def pack_words(words: pa.Array) -> bytes:
    bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(words) else np.zeros(0, np.uint8)
    return pack(narrow(np.diff(bounds)), data)


def unpack_words(blob: bytes) -> pa.Array:
    size, data = unpack(blob)
    return binaries(size, data)


def binaries(size: np.ndarray, data: np.ndarray) -> pa.Array:
    bounds = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=bounds[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def lists_at(bounds: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated lists values[bounds[i]:bounds[i + 1]] for i in which, and their n + 1 bounds."""
    size = (bounds[1:] - bounds[:-1])[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    at = np.arange(ends[-1]) + np.repeat(bounds[which] - ends[:-1], size)
    return values[at], ends


def split_buckets(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each bucket, in ascending order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    held, first = np.unique(bucket[order], return_index=True)
    for b, at in zip(held.tolist(), np.split(order, first[1:]), strict=True):
        yield b, at


def blocks(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """(id, rows) of blocks with at most so many bytes of text, or one document. The id is unique within the job and fixed by what is written."""
    limit = limit or BLOCK_BYTES
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    held, size, k = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        first, total = 0, np.cumsum(lengths)
        while first < batch.num_rows:
            before = total[first - 1] if first else 0
            end = max(int(np.searchsorted(total, before + limit - size, "right")), first)
            if end == first and not held:
                end = first + 1
            if end > first:
                held.append(batch.slice(first, end - first))
                size += int(total[end - 1] - before)
            if end < batch.num_rows or size >= limit:
                yield base + k, pa.Table.from_batches(held)
                held, size, k = [], 0, k + 1
                released()
            first = end
    if held:
        yield base + k, pa.Table.from_batches(held)
    del held
    released()


def answered(messages: DataFrame, answer: Callable[[pa.Table], Iterator[pa.Table] | pa.Table], schema: str) -> DataFrame:
    """answer() of each bucket's messages; messages: block, bucket, blob."""

    def run(table: pa.Table) -> pa.Table:
        out = answer(table)
        del table
        released()
        return out

    return messages.groupBy("bucket").applyInArrow(run, schema)


MESSAGE = "block long, bucket int, blob binary"
_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


def messages(block: int, blobs: Iterable[tuple[int, bytes]], named: bool = False) -> pa.RecordBatch:
    """A block's messages to buckets; with bucket -1 that names the block, so that it is known also if it sends none."""
    rows = [{"block": block, "bucket": -1, "blob": None}] if named else []
    return pa.RecordBatch.from_pylist(rows + [{"block": block, "bucket": b, "blob": x} for b, x in blobs], _MESSAGE)


def put(folder: str, name: str, blobs: dict[str, bytes]) -> None:
    """What a block keeps, as one file in the shared folder. A repeated task writes the same again."""
    head = json.dumps({k: len(x) for k, x in blobs.items()}).encode()
    with shared_files.written(f"{folder}/{name}") as out:
        out.write(struct.pack("<Q", len(head)) + head)
        for x in blobs.values():
            out.write(x)


def got(folder: str, name: str) -> dict[str, bytes]:
    system, path = shared_files.opened(f"{folder}/{name}")
    with system.open_input_file(path) as f:
        (n,) = struct.unpack("<Q", f.read(8))
        return {k: f.read(size) for k, size in json.loads(f.read(n)).items()}


def exchanged(docs: DataFrame, hold: Callable, folder: str) -> DataFrame:
    """The messages of blocks; hold() puts what the blocks keep into files of the folder."""
    return saved(docs.mapInArrow(tidy(hold), MESSAGE), folder, "messages")


def by_block(sent: DataFrame, answers: DataFrame, n: int, run: Callable[[int, dict[int, bytes]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """run() of each block with the answers to it by bucket; what else a block needs is in its files, so it doesn't move.

    Blocks are dealt to n tasks, as most of their bytes are in files, of which
    the sizes of the answers, that would else decide, say nothing.
    """
    names = sent.filter("bucket = -1").select("block", F.lit(-1).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("blob"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, blobs = None, {}
        for batch in batches:
            block = batch.column("block")[0].as_py() if batch.num_rows else block
            blobs |= {b: x for b, x in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True) if b >= 0}
        for out in run(block, blobs):
            for k in range(0, max(out.num_rows, 1), 2000):
                yield out.slice(k, 2000)
        del blobs
        released()

    return answers.select("block", "bucket", "blob").unionByName(names).repartition(n, "block").groupBy("block").applyInArrow(whole, schema)

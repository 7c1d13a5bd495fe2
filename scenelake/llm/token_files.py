"""Shard files of token ids in ascending doc_id order.

A shard holds at most SHARD_IDS ids, or one document: ids become ranks by
frequency within the shard, ranks are coded in one to four bytes, and the
lengths stand apart in control bytes, four ranks in each. A control byte looks
up the places of its ranks' bytes, so decoding is one masked copy in numpy.

    magic | header length u32 | header JSON | ids by rank | document ids and
    null marks | ids per document | control bytes | data bytes

Ranks are per shard: each file can be read alone, and one pass over the corpus
writes them all. Documents without doc_id come first; equal ids are in the
order of a hash of their texts, then of the texts, so that the sort can split
them between tasks. Null and empty texts hold only the end id.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import shared_files, vocab
from . import splitting as S

MAGIC = b"RANKVB01"
#: Ids in a shard, text in a block that is encoded at once, and text for a partition of the sort.
SHARD_IDS, BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20, 64 << 20
MANIFEST = "path string, part int, shard int, first_doc_id long, n_docs long, n_ids long, n_bytes long"

#: For each control byte, which of the 16 bytes of four ranks are kept.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
_KEPT = (np.arange(4) <= _LENGTHS[:, :, None]).reshape(256, 16)


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = more
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    full = np.zeros(len(padded), "<u4")
    full[: len(ranks)] = ranks
    mask = _KEPT[control].ravel()
    mask[4 * len(ranks) :] = False
    return control, full.view(np.uint8)[mask]


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    mask = _KEPT[control].ravel()
    mask[4 * n :] = False
    out = np.zeros(len(control) * 16, np.uint8)
    out[mask] = data
    return out.view("<u4")[:n]


def shard_bytes(ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray) -> bytes:
    times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    by_rank = np.argsort(-times, kind="stable")[: np.count_nonzero(times)].astype("<u4")
    rank = np.zeros(len(times), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = encode_ranks(rank[ids])
    parts = [by_rank, doc_ids.astype("<i8"), null.astype(np.uint8), counts.astype("<i8"), control, data]
    header = json.dumps({"n_ids": len(ids), "n_docs": len(counts), "sizes": [x.nbytes for x in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(x.tobytes() for x in parts)])


def read_shard(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, document ids, null marks and ids per document of a shard."""
    system, path = shared_files.opened(uri)
    with system.open_input_file(path) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{uri} is no shard")
    (n,) = struct.unpack_from("<I", data, 8)
    header = json.loads(data[12 : 12 + n])
    at, parts = 12 + n, []
    for size, kind in zip(header["sizes"], ("<u4", "<i8", "u1", "<i8", "u1", "u1"), strict=True):
        parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    if at != len(data):
        raise ValueError(f"{uri} has {len(data)} bytes, not {at}")
    by_rank, doc_ids, null, counts, control, body = parts
    return by_rank[decode_ranks(control, body, header["n_ids"])] if header["n_ids"] else np.zeros(0, "<u4"), doc_ids, null, counts


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> DataFrame:
    """Writes the shards of all documents; returns the manifest, one row a shard, read from the folder."""
    spark = docs.sparkSession
    data = vocab.read(vocabulary)
    special = vocab.ByteBpe(data).special
    sent = spark.sparkContext.broadcast(data)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    parts = X.deal(spark, X.text_bytes(docs), PART_BYTES)
    shared_files.folder(f"{folder}/shards")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        bpe = vocab.byte_bpe(sent.value)
        for _, table in X.blocks(batches, BLOCK_BYTES):
            buf, offsets = S.joined(table.column("text"))
            starts = S.byte_level_starts(buf, offsets, special)
            found = S.views(buf, starts).dictionary_encode()
            lists = bpe.encode(found.dictionary.to_pylist())
            bounds = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=bounds[1:])
            flat = np.fromiter((i for x in lists for i in x), np.uint32, int(bounds[-1]))
            ids, ends = X.lists_at(bounds, flat, found.indices.to_numpy())
            ends = ends[np.searchsorted(starts, offsets)]
            doc_id = table.column("doc_id").combine_chunks()
            counts = np.diff(ends) + 1
            whole = np.full(len(ids) + len(counts), end_id, np.uint32)
            keep = np.ones(len(whole), bool)
            keep[np.cumsum(counts) - 1] = False
            whole[keep] = ids
            yield whole, doc_id.fill_null(0).to_numpy(), np.asarray(doc_id.is_null()), counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        def put() -> pa.RecordBatch:
            ids, doc_id, null, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{folder}/shards/part-{part:06d}-{shard:06d}.ids"
            with shared_files.written(path) as out:
                out.write(body := shard_bytes(ids, doc_id, null, counts))
            row = {"path": path, "part": part, "shard": shard, "first_doc_id": None if null[0] else int(doc_id[0]), "n_docs": len(counts), "n_ids": len(ids), "n_bytes": len(body)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for ids, doc_id, null, counts in encoded(batches):
            ends, k = np.append(0, np.cumsum(counts)), 0
            while k < len(counts):
                more = max(k + (not size), int(np.searchsorted(ends, ends[k] + SHARD_IDS - size, "right")) - 1)
                if more > k:
                    held.append((ids[ends[k] : ends[more]], doc_id[k:more], null[k:more], counts[k:more]))
                    size += int(ends[more] - ends[k])
                if more < len(counts) or size >= SHARD_IDS:
                    yield put()
                    held, size, shard = [], 0, shard + 1
                k = more
        if held:
            yield put()

    ids, mark = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").alias("mark")
    ordered = docs.select("doc_id", "text", mark).repartitionByRange(parts, ids, "mark").sortWithinPartitions(ids, "mark", "text").drop("mark")
    return X.saved(ordered.mapInArrow(run, MANIFEST), folder, "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of all documents in the shards.

    The driver sums the shards' id counts, one small row for each shard.
    """
    rows = sorted(manifest.select("part", "shard", "path", "n_ids").collect())
    starts = np.append(0, np.cumsum([r["n_ids"] for r in rows], dtype=np.int64)) if rows else [0]
    listed = spark.createDataFrame([(r["path"], int(s)) for r, s in zip(rows, starts, strict=False)], "path string, first long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, doc_id, null, counts = read_shard(row["path"])
                ends, k = np.append(0, np.cumsum(counts)), 0
                while k < len(counts):
                    more = max(k + 1, int(np.searchsorted(ends, ends[k] + (1 << 20), "right")) - 1)
                    blobs = X.binaries(4 * counts[k:more], ids[ends[k] : ends[more]].view(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id[k:more], mask=null[k:more].astype(bool)), pa.array(row["first"] + ends[k:more]), pa.array(counts[k:more]), blobs], ["doc_id", "start", "n_tokens", "ids"])
                    k = more

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

"""BPE encoding through a table of distinct words, and decoding through the piece table.

Documents are split in blocks; a block sends its distinct words to buckets; a
bucket encodes each distinct word once; each block joins the ids back by the
words' positions. Nulls and empty texts give no ids. A row gives a row, also
where ids repeat or are null; columns but doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import exchange as X
from . import splitting as S
from . import vocab

def doc_ids(table: pa.Table) -> bytes:
    """The ids of a block's rows, which may be null, as one value."""
    ids = table.column("doc_id").combine_chunks().cast(pa.int64())
    return X.pack(ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()).astype(np.uint8), level=3)


def doc_ids_of(blob: bytes) -> pa.Array:
    ids, null = X.unpack(blob)
    return pa.array(ids, pa.int64(), mask=null.astype(bool))


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, the commonest first, and the position of each word among them."""
    found = words.dictionary_encode()
    codes = found.indices.to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=len(found.dictionary)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), place[codes]


def to_buckets(words: pa.Array, n: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The bucket of each word, and a message of its words for each bucket, in ascending positions."""
    bucket = (X.hashes(words) % np.uint64(n)).astype(np.int64)
    return bucket, [(b, X.pack_words(words.take(pa.array(at)))) for b, at in X.split_buckets(bucket)]


def _hold(folder: str, n: int, special: bytes):
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in X.blocks(batches):
            buf, offsets = S.joined(table.column("text"))
            starts = S.byte_level_starts(buf, offsets, special)
            distinct, codes = coded(S.views(buf, starts))
            bucket, messages = to_buckets(distinct, n)
            counts = np.diff(np.searchsorted(starts, offsets))
            X.put(folder, f"blocks/{block}", {"doc_ids": doc_ids(table), "counts": X.pack(X.narrow(counts)), "codes": X.pack(X.narrow(codes), X.narrow(bucket))})
            yield X.messages(block, messages, True)

    return hold


def merged(table: pa.Table) -> tuple[list[pa.Array], pa.Array, np.ndarray]:
    """Each message's words, the distinct words of all, and the place of each word among them."""
    each = [X.unpack_words(b) for b in table.column("blob").to_pylist()]
    found = pa.chunked_array(each, pa.binary()).combine_chunks().dictionary_encode()
    return each, found.dictionary, found.indices.to_numpy()


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every text."""
    spark = docs.sparkSession
    data = vocab.read(vocabulary)
    special = vocab.ByteBpe(data).special
    sent = spark.sparkContext.broadcast(data)
    docs = docs.select("doc_id", "text")
    folder = X.workdir(spark)
    n = X.deal(spark, X.input_bytes(docs))
    sent_words = X.exchanged(docs, _hold(folder, n, special), folder)

    def answer(table: pa.Table) -> pa.Table:
        each, distinct, at = merged(table)
        ids = vocab.byte_bpe(sent.value).encode(distinct.to_pylist())
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=bounds[1:])
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(bounds[-1]))
        blobs, first = [], 0
        for words in each:
            which = at[first : first + len(words)]
            first += len(words)
            values, ends = X.lists_at(bounds, flat, which)
            blobs.append(X.pack(X.narrow(np.diff(ends)), X.narrow(values)))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})

    answers = X.answered(sent_words.filter("bucket >= 0"), answer, X.MESSAGE)

    def assemble(block: int, blobs: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        row = X.got(folder, f"blocks/{block}")
        codes, bucket = X.unpack(row["codes"])
        counts = X.unpack(row["counts"])[0].astype(np.int64)
        size = np.zeros(len(bucket), np.int64)
        parts = {}
        for b, at in X.split_buckets(bucket.astype(np.int64)):
            lengths, values = X.unpack(blobs.pop(b))
            size[at] = lengths
            parts[b] = at, values
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        flat = np.zeros(int(bounds[-1]), np.uint32)
        for at, values in parts.values():
            slots = np.arange(len(values)) + np.repeat(bounds[at] - np.append(0, np.cumsum(size[at])[:-1]), size[at])
            flat[slots] = values
        ends = np.append(0, np.cumsum(counts))
        ids = doc_ids_of(row["doc_ids"])
        k = 0
        while k < len(counts):  # a few documents at a time
            more = max(k + 1, int(np.searchsorted(ends, ends[k] + (1 << 20), "right")) - 1)
            out, at = X.lists_at(bounds, flat, codes[ends[k] : ends[more]])
            yield pa.RecordBatch.from_arrays([ids[k:more], X.binaries(4 * np.diff(at[ends[k : more + 1] - ends[k]]), out.view(np.uint8))], ["doc_id", "ids"])
            k = more

    return X.by_block(sent_words, answers, n, assemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of encode() with the text of their ids.

    The piece table is the vocabulary, whose size is bounded and checked; ids
    are joined to it on the map side, by position. Ids that make no valid
    UTF-8 give replacement characters, null ids a null text.
    """
    data = vocab.read(vocabulary)
    sent = encoded.sparkSession.sparkContext.broadcast(data)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = vocab.byte_bpe(sent.value).pieces()
        pieces = pa.array(listed, pa.large_binary())
        for batch in batches:
            k = 0
            blobs = batch.column("ids")
            total = np.cumsum(pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False)) if len(blobs) else np.zeros(0)
            while k < batch.num_rows:
                more = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + (4 << 20), "right")))
                part = blobs[k:more]
                flat = np.frombuffer(b"".join(x or b"" for x in part.to_pylist()), "<u4")
                got = pieces.take(pa.array(flat))
                bounds = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8)
                ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False) // 4))
                at = bounds[ends]
                raw = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.ascontiguousarray(at)), got.buffers()[2] or pa.py_buffer(b"")])
                try:
                    text = raw.cast(pa.large_string())
                    text.validate(full=True)
                except pa.ArrowInvalid:
                    text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
                text = pc.if_else(part.is_null(), pa.scalar(None, pa.large_string()), text)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[k:more], part, text.cast(pa.string())], ["doc_id", "ids", "text"])
                k = more

    return encoded.select("doc_id", "ids").mapInArrow(X.tidy(join), "doc_id long, ids binary, text string")

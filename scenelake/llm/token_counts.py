"""Token counts without tokens: each distinct stretch of text is counted once.

A block of documents holds, for each document, the frequencies of its distinct
stretches, and sends the distinct stretches to buckets. A bucket counts the
pieces of each once; documents sum frequency times count. No ids are made.
Null and empty texts have no tokens; every row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe, vocab
from . import exchange as X
from . import splitting as S

def _hold(folder: str, n: int):
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in X.blocks(batches):
            texts = table.column("text").combine_chunks().cast(pa.large_string()).fill_null("")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            spaced = pc.binary_join_element_wise(pc.if_else(pa.array(size > 0), " ", "").cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))
            buf, offsets = S.joined(spaced)
            starts = S.piece_starts(buf, offsets)
            distinct, codes = bpe.coded(S.views(buf, starts))
            doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
            pairs, times = np.unique((doc.astype(np.uint64) << np.uint64(32)) | codes.astype(np.uint64), return_counts=True)
            code = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            each = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(texts))
            gaps = np.diff(code, prepend=0)  # ascending within a document
            heads = np.append(0, np.cumsum(each)[:-1])[each > 0]
            gaps[heads] = code[heads]
            bucket, messages = bpe.to_buckets(distinct, n)
            row = {
                "doc_ids": bpe.doc_ids(table),
                "docs": X.pack(X.narrow(size), X.narrow(each)),
                "frequencies": X.pack(X.narrow(gaps), X.narrow(times), X.narrow(bucket)),
            }
            X.put(folder, f"blocks/{block}", row)
            yield X.messages(block, messages, True)

    return hold


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text under a sentencepiece BPE model."""
    spark = docs.sparkSession
    data = vocab.read(vocabulary)
    vocab.Pieces(data)
    sent = spark.sparkContext.broadcast(data)
    docs = docs.select("doc_id", "text")
    folder = X.workdir(spark)
    n = X.deal(spark, X.input_bytes(docs))
    stretches = X.exchanged(docs, _hold(folder, n), folder)

    def answer(table: pa.Table) -> pa.Table:
        each, distinct, at = bpe.merged(table)
        counts = vocab.pieces(sent.value).counts(distinct.to_pylist())[at]
        ends = np.cumsum([len(x) for x in each])
        blobs = [X.pack(X.narrow(x)) for x in np.split(counts, ends[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})

    def total(block: int, blobs: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        row = X.got(folder, f"blocks/{block}")
        size, each = (x.astype(np.int64) for x in X.unpack(row["docs"]))
        gaps, times, bucket = X.unpack(row["frequencies"])
        count = np.zeros(len(bucket), np.int64)
        for b, at in X.split_buckets(bucket.astype(np.int64)):
            count[at] = X.unpack(blobs[b])[0]
        run = np.cumsum(gaps, dtype=np.int64)
        heads = np.append(0, np.cumsum(each)[:-1]).astype(np.int64)
        before = np.where(heads > 0, run[np.maximum(heads, 1) - 1], 0) if len(run) else heads * 0
        code = run - np.repeat(before, each)
        sums = np.append(0, np.cumsum(count[code] * times))
        yield pa.RecordBatch.from_arrays([bpe.doc_ids_of(row["doc_ids"]), pa.array(size), pa.array(sums[heads + each] - sums[heads])], ["doc_id", "n_bytes", "n_tokens"])

    answers = X.answered(stretches.filter("bucket >= 0"), answer, X.MESSAGE)
    return X.by_block(stretches, answers, n, total, "doc_id long, n_bytes long, n_tokens long")

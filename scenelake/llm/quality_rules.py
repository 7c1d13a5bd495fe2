"""Quality rules, and a hashed n-gram log-likelihood ratio of target against corpus.

Bytes of every text are cut in overlapping GRAM-byte n-grams, hashed in BUCKETS
buckets. Two multinomials are counted over all rows, one over trusted documents
(those whose labels say so), one over the whole corpus; the target's is drawn to
the corpus's by PRIOR n-grams, so that it has no empty bucket. A document's score is the mean of log(target / corpus) over its
n-grams, so length doesn't count; documents at or above the threshold pass. A
text shorter than an n-gram scores 0.

Null texts have no words and score 0, as empty ones. Rows stand for themselves,
with repeated or null doc_ids too; a document is trusted if any label row of its
doc_id is. Columns but doc_id and text are not looked at. Each document's score
is a sum of its own, so equal texts have equal scores and verdicts, however rows
are dealt to blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import splitting as S

#: Bytes of an n-gram, hash buckets, bytes of text at once; label ids that are sent to all workers at most, beyond which rows are shuffled.
GRAM, BUCKETS, BLOCK_BYTES, MOST_SENT = 4, 1 << 16, 4 << 20, 1_000_000
#: N-grams of the corpus's distribution that are added to the target's.
PRIOR = 1000.0
#: Mean log-likelihood ratio that a document needs.
THRESHOLD = -0.05
#: Characters that count as symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def gram_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and which of them lie within one document."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x01000193) + buf[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return (h >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1), inside


def counted(docs: DataFrame) -> DataFrame:
    """slot, corpus, target: n-grams of all rows and of trusted rows. Each task adds up its own before rows move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for _, table in X.blocks(batches, BLOCK_BYTES):
            buf, offsets = S.joined(table.column("text"))
            slots, inside = gram_buckets(buf, offsets)
            corpus += np.bincount(slots[inside], minlength=BUCKETS)
            trusted = np.repeat(table.column("trusted").to_numpy(), np.diff(offsets))[: len(slots)]
            target += np.bincount(slots[inside & trusted], minlength=BUCKETS)
        at = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(corpus[at]), pa.array(target[at])], ["slot", "corpus", "target"])

    return docs.mapInArrow(run, "slot int, corpus long, target long").groupBy("slot").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target"))


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each bucket. docs: doc_id, text; trusted: doc_id of trusted documents."""
    trusted = trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    if trusted.count() <= MOST_SENT:
        trusted = F.broadcast(trusted)
    marked = docs.join(trusted, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    corpus, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted(marked).collect():  # as many rows as buckets
        corpus[row["slot"]], target[row["slot"]] = row["corpus"], row["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    share = corpus / corpus.sum()
    ratio = (target + PRIOR * share) / (target.sum() + PRIOR) / np.where(share > 0, share, 1)
    return np.log(np.where(share > 0, ratio, 1))


def document_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each document, by itself: equal texts have equal sums wherever they stand."""
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some])
    return out


def base(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counts of the rules of each row; the joined texts and their offsets."""
    buf, offsets = S.joined(table.column("text"))
    docs = len(offsets) - 1
    starts, ends = S.words(buf, offsets)
    n_words = np.diff(np.searchsorted(starts, offsets))
    inside = S._in_words("white")[buf]
    per = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    chars, symbols = per(inside & ((buf & 0xC0) != 0x80)), per(_SYMBOL[buf])
    # lines: of each document's bytes between line ends
    heads = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(buf == 10) + 1]))
    heads = heads[heads < len(buf)]
    tails = np.append(heads[1:], len(buf))[: len(heads)]
    tails = np.where((tails > heads) & (buf[np.maximum(tails - 1, 0)] == 10), tails - 1, tails) if len(heads) else tails
    total = np.append(0, np.cumsum(inside))
    some = total[tails] > total[heads]
    lines = S.views(buf, heads[some], tails[some]).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.searchsorted(offsets, heads[some], "right") - 1
    distinct = np.unique((doc << 32) | lines) >> 32
    dup = np.bincount(doc, minlength=docs) - np.bincount(distinct, minlength=docs)
    # words in windows of 8 that are found again
    width, n = 8, len(starts)
    repeat = np.zeros(docs, np.int64)
    if n >= width:
        found = S.views(buf, starts, ends).dictionary_encode()
        w = found.indices.to_numpy().astype(np.int64)
        for k in (1, 2, 4):  # numbers of equal runs of two, four and eight words, within the block
            w = np.unique(w[:-k] * n + w[k:], return_inverse=True)[1]
        of = np.repeat(np.arange(docs), n_words)
        ok = np.flatnonzero(of[: n - width + 1] == of[width - 1 :])
        key = w[ok] * docs + of[ok]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(ok), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, ok[again], 1)
        np.add.at(cover, ok[again] + width, -1)
        repeat = np.bincount(of[np.cumsum(cover[:-1]) > 0], minlength=docs)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}, buf, offsets


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"


def judged(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rules' counts, the score and the verdict of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in X.blocks(batches, BLOCK_BYTES):
            counts, buf, offsets = base(table)
            slots, inside = gram_buckets(buf, offsets)
            value = np.zeros(len(buf) + 1)
            value[1 : len(slots) + 1] = np.where(inside, sent.value[slots], 0)
            each = document_sums(value[1:], offsets)
            score = each / np.maximum(np.diff(offsets) - GRAM + 1, 1)
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            ids = pc.cast(table.column("doc_id").combine_chunks(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in counts.values()), pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))], ["doc_id", *counts, "score", "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)

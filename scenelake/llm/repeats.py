"""Removal of byte strings that an earlier document holds too, by depth-limited radix sort of suffixes.

Every `width`-byte window that also starts in a document with a smaller doc_id
is covered. All suffixes that can repeat are sorted, only through their first
`width` bytes, by passes from the most significant digit on (eight bytes each);
groups that are equal after the last pass are exactly the repeated windows.

Which suffixes can repeat, and where they meet, follows from their content. Each
window has an anchor, the `gram`-byte string in it with the least hash; equal
windows have equal anchors. Windows side by side with one anchor travel as one
stretch of text. (1) Blocks send the hashes of their anchors; buckets answer
which of them two documents hold. (2) Blocks send their distinct stretches with
those anchors, each once with the smallest doc_id that has it in the block, so
hot passages are aggregated before they move; buckets radix-sort the suffixes of
the distinct stretches and answer which windows a smaller doc_id holds. (3)
Blocks remove what is covered. An anchor of very many stretches, as of a common
passage with ever other surroundings, would fill one bucket: its windows are
dealt one by one, by all their bytes, so that only equal windows meet, each once
a block. What a block has found is kept in files. Nothing is capped or sampled: an anchor whose
hash only seems repeated costs time, and one that repeats is never missed.

A null text is empty. Rows of equal doc_id are one document here: they don't
remove each other's strings. A null doc_id is larger than all others.
Columns of any name are carried along.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import splitting as S

#: Bytes of an anchor; of text in a block; of text for each bucket; positions hashed at once.
GRAM, BLOCK_BYTES, BUCKET_BYTES, CHUNK = 24, 8 << 20, 8 << 20, 1 << 19
#: Stretches of one anchor beyond which they are dealt window by window; what cut() adds.
HOT, RESULT = 1 << 16, ("kept", "n_bytes", "n_removed", "spans")
_M = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each position on, by doubling."""
    h, have, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if gram & have:
            if out is None:
                out, done = h, have
            else:  # the part so far, and behind it the next
                n = len(out) - have
                out = out[:n] * np.uint64(pow(_M, have, 1 << 64)) + h[done : done + n] if n > 0 else out[:0]
                done += have
        if have * 2 > gram:
            return X.mix(out[: max(0, len(data) - gram + 1)])
        n = len(h) - have
        h = h[:n] * np.uint64(pow(_M, have, 1 << 64)) + h[have:] if n > 0 else h[:0]
        have *= 2


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each `width` keys in a row."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def stretches(buf: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and hash of the anchor of each stretch of windows with one anchor."""
    heads, counts, hashes, n = [], [], [], len(buf)
    last = np.zeros(n + 1, bool)  # windows that start here would cross a document's end
    starts_left = np.minimum(offsets[1:], n)
    for first in range(0, max(n - width + 1, 0), CHUNK):
        data = buf[first : first + CHUNK + width - 1]
        h = _grams(data, gram)
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keys, width - gram + 1) & _LOW).astype(np.int64)
        m = len(at)
        ok = np.ones(m, bool)
        ends = starts_left[np.searchsorted(starts_left, first + 1) : np.searchsorted(starts_left, first + m + width, "right")]
        if len(ends):
            cover = np.zeros(m + 1, np.int32)
            np.add.at(cover, np.clip(ends - width + 1 - first, 0, m), 1)
            np.add.at(cover, np.clip(ends - first, 0, m), -1)
            ok = np.cumsum(cover[:-1]) == 0
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        head = np.flatnonzero(new)
        if not len(head):
            continue
        stop = np.cumsum(ok)
        seen = stop[head] - 1
        count = np.diff(np.append(seen, stop[-1]))
        heads.append(head + first)
        counts.append(count)
        hashes.append(h[at[head]])
    if not heads:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(heads), np.concatenate(counts), np.concatenate(hashes)


def _order(rest: pa.Table) -> np.ndarray:
    ids = rest.column("doc_id").combine_chunks().cast(pa.int64())
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy()


class _Block:
    """A block's text and the stretches that its windows make; put to files between the steps."""

    @classmethod
    def made(cls, table: pa.Table, width: int, gram: int, bits: int) -> _Block:
        self = cls()
        self.rest = table.drop_columns(["text"])
        self.buf, self.offsets = S.joined(table.column("text"))
        self.head, self.count, anchor = stretches(self.buf, self.offsets, width, gram)
        self.value = anchor >> np.uint64(64 - bits)
        return self

    def put(self, folder: str, block: int) -> None:
        X.put(folder, f"blocks/{block}", {
            "rest": _ipc(self.rest), "sizes": X.pack(X.narrow(np.diff(self.offsets))), "text": X.pack(self.buf, level=3),
            "stretches": X.pack(X.narrow(np.diff(self.head, prepend=0)), X.narrow(self.count), X.narrow(self.value)),
        })

    @classmethod
    def read(cls, folder: str, block: int) -> _Block:
        self, row = cls(), X.got(folder, f"blocks/{block}")
        (sizes,), (self.buf,) = X.unpack(row["sizes"]), X.unpack(row["text"])
        self.offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
        self.rest = pa.ipc.open_stream(row["rest"]).read_all()
        gaps, count, value = X.unpack(row["stretches"])
        self.head, self.count, self.value = np.cumsum(gaps, dtype=np.int64), count.astype(np.int64), value.astype(np.uint64)
        return self

    def docs(self) -> np.ndarray:
        """The order of the document that each stretch is in."""
        ids = _order(self.rest)
        return ids[np.searchsorted(self.offsets, self.head, "right") - 1] if len(self.head) else np.zeros(0, np.int64)

    def anchors(self, buckets: int) -> list[tuple[int, bytes]]:
        """For each bucket the distinct anchors (without what they have in common there, the remainder), which of them two documents of this block hold, and how many stretches each has."""
        distinct, which, many = np.unique(self.value, return_inverse=True, return_counts=True)
        doc = self.docs()
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        twice = low != high
        return [(b, X.pack(X.narrow(np.diff(distinct[at] // np.uint64(buckets), prepend=np.uint64(0))), np.packbits(twice[at]), X.narrow(many[at]))) for b, at in X.split_buckets((distinct % np.uint64(buckets)).astype(np.int64))]

    def repeated(self, answers: dict[int, bytes], buckets: int, width: int) -> None:
        """Keeps the stretches whose anchors repeat, and finds the distinct ones."""
        distinct, which = np.unique(self.value, return_inverse=True)
        known, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        for b, at in X.split_buckets((distinct % np.uint64(buckets)).astype(np.int64)):
            known[at], hot[at] = (np.unpackbits(x, count=len(at)).astype(bool) for x in X.unpack(answers[b]))
        keep = np.flatnonzero(known[which])
        self.doc = self.docs()[keep]
        self.head, self.count, value, hot = self.head[keep], self.count[keep], self.value[keep], hot[which[keep]]
        if hot.any():  # stretches of hot anchors go window by window, each by all its bytes
            self.head, self.count, self.doc, value = _by_window(self.buf, self.head, self.count, self.doc, value, hot, width)
        parts = []
        for k in range(0, len(self.head), 1 << 16):
            size = self.count[k : k + (1 << 16)] + width - 1
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(self.head[k : k + (1 << 16)] - (ends - size), size)
            parts.append(X.binaries(size, self.buf[at]))
        found = pa.chunked_array(parts, pa.binary()).combine_chunks().dictionary_encode()
        self.text, self.entry = found.dictionary, found.indices.to_numpy()
        n = len(self.text)
        self.least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.doc)
        goes = np.zeros(n, np.uint64)
        goes[self.entry] = value
        self.goes = (goes % np.uint64(buckets)).astype(np.int64)

    def stretches(self) -> list[tuple[int, bytes]]:
        out = []
        for b, at in X.split_buckets(self.goes):
            size, data = X.unpack(X.pack_words(self.text.take(pa.array(at))))
            out.append((b, X.pack(size, data, np.diff(self.least[at], prepend=0), level=3)))
        return out

    def put_repeated(self, folder: str, block: int) -> None:
        arrays = (X.narrow(self.head), X.narrow(self.count), self.doc, X.narrow(self.entry), self.least, X.narrow(self.goes))
        X.put(folder, f"repeated/{block}", {"arrays": X.pack(*arrays)})

    def covered(self, folder: str, block: int, answers: dict[int, bytes], width: int) -> np.ndarray:
        """Which bytes are covered."""
        head, count, doc, entry, least, goes = X.unpack(X.got(folder, f"repeated/{block}")["arrays"])
        head = head.astype(np.int64)
        mask = np.zeros(len(least), np.uint32)
        for b, at in X.split_buckets(goes.astype(np.int64)):
            mask[at] = X.unpack(answers[b])[0]
        bits = np.where(doc > least[entry], np.uint32(0xFFFFFFFF), mask[entry]) if len(entry) else np.zeros(0, np.uint32)
        mark = np.zeros(len(self.buf) + 1, np.int32)
        for j in range(int(count.max()) if len(count) else 0):
            mark[head[(count > j) & ((bits >> np.uint32(j)) & 1).astype(bool)] + j] = 1
        total = np.cumsum(mark[:-1], dtype=np.int32)
        out = total > 0
        out[width:] = total[width:] > total[:-width]
        return out


def _by_window(buf: np.ndarray, head: np.ndarray, count: np.ndarray, doc: np.ndarray, value: np.ndarray, hot: np.ndarray, width: int):
    """Stretches of hot anchors cut into windows, which are dealt by the hash of all their bytes; the others as they are."""
    at = np.flatnonzero(hot)
    row = np.repeat(at, count[at])
    place = head[row] + np.arange(len(row)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
    key = np.empty(len(row), np.uint64)
    for k in range(0, len(row), 1 << 16):
        part = place[k : k + (1 << 16)]
        key[k : k + (1 << 16)] = X.hashes(X.binaries(np.full(len(part), width), buf[(part[:, None] + np.arange(width)).ravel()]))
    rest = np.flatnonzero(~hot)
    join = lambda x, y: np.concatenate([x[rest], y])
    return join(head, place), join(count, np.ones(len(row), np.int64)), join(doc, doc[row]), join(value, key)


def _seen_twice(most: int, table: pa.Table) -> pa.Table:
    """Which anchors two documents hold, and which of them have more than `most` stretches."""
    each = [X.unpack(b) for b in table.column("blob").to_pylist()]
    values = [np.cumsum(x[0], dtype=np.uint64) for x in each]
    twice = np.concatenate([np.unpackbits(x[1], count=len(v)) for x, v in zip(each, values, strict=True)]).astype(bool)
    _, at, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    again = times > 1
    again[at[twice]] = True
    hot = np.bincount(at, weights=np.concatenate([x[2] for x in each])) > most
    ends = np.cumsum([len(v) for v in values])[:-1]
    blobs = [X.pack(np.packbits(x), np.packbits(y)) for x, y in zip(np.split(again[at], ends), np.split(hot[at], ends), strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})


def radix_groups(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that are equal through `width` bytes with another: their indices, and the group of each.

    Passes go from the most significant digit on; a suffix that stands alone
    after a pass takes no part in the next.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    digits = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    alive, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for k in range(0, width, 8):
        key = digits[starts[alive] + k]
        if width - k < 8:
            key = key & np.uint64((1 << (8 * (width - k))) - 1)
        order = np.argsort(key, kind="stable") if not k else np.lexsort((key, group))
        alive, group, key = alive[order], group[order], key[order]
        new = np.ones(len(alive), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        alive = alive[~alone]
    return alive, group


def _sorted_windows(width: int, table: pa.Table) -> pa.Table:
    each = [X.unpack(b) for b in table.column("blob").to_pylist()]
    found = pa.chunked_array([X.binaries(size, data) for size, data, _ in each], pa.binary()).combine_chunks().dictionary_encode()
    text, entry = found.dictionary, found.indices.to_numpy()
    docs = np.concatenate([np.cumsum(d) for _, _, d in each])
    least = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, docs)
    bounds = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)
    count = np.diff(bounds) - width + 1
    of = np.repeat(np.arange(len(text)), count)
    first = np.cumsum(count) - count
    starts = np.arange(len(of)) - np.repeat(first, count) + np.repeat(bounds[:-1], count)
    smallest = least[of]
    alive, group = radix_groups(data, starts, width)
    if len(alive):
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        smallest[alive] = np.repeat(np.minimum.reduceat(smallest[alive], cuts), np.diff(np.append(cuts, len(alive))))
    # an entry's answer is for the smallest doc_id of its own block
    size = count[entry]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    bit = (smallest[np.repeat(first[entry], size) + at] < np.repeat(docs, size)).astype(np.uint32) << at.astype(np.uint32)
    mask = np.add.reduceat(bit, np.cumsum(size) - size, dtype=np.uint32) if len(size) else np.zeros(0, np.uint32)
    ends = np.cumsum([len(d) for _, _, d in each])
    blobs = [X.pack(x) for x in np.split(mask, ends[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})


def cut(docs: DataFrame, width: int = 50, gram: int = GRAM) -> DataFrame:
    """All columns of the documents but text, and kept (binary), n_bytes, n_removed and spans (removed runs, of the input's bytes), in place of columns of these names."""
    if not 8 <= gram < width <= gram + 31:
        raise ValueError("a window holds its anchor and at most 31 bytes more")
    spark = docs.sparkSession
    folder = X.workdir(spark)
    n_bytes = X.input_bytes(docs)
    n = X.deal(spark, n_bytes, BUCKET_BYTES)
    bits = min(64, max(16, n_bytes.bit_length() + 6))
    docs = docs.drop(*RESULT)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    limit, most = BLOCK_BYTES, HOT

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in X.blocks(batches, limit):
            block = _Block.made(table, width, gram, bits)
            block.put(folder, number)
            yield X.messages(number, block.anchors(n), True)

    def distinct(number: int, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        block = _Block.read(folder, number)
        block.repeated(answers, n, width)
        block.put_repeated(folder, number)
        yield X.messages(number, block.stretches())

    def apply(number: int, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        block = _Block.read(folder, number)
        gone = block.covered(folder, number, answers, width)
        size = np.diff(block.offsets)
        removed = np.append(0, np.cumsum(gone))[block.offsets]
        left = np.diff(block.offsets - removed)
        kept = X.binaries(left, block.buf[~gone])
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = block.offsets[1:-1]
        inner = inner[inner < len(gone)]
        first[inner] |= gone[inner]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        last[inner[inner > 0] - 1] |= gone[inner[inner > 0] - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.searchsorted(a, block.offsets).astype(np.int32)
        base = np.repeat(block.offsets[:-1], np.diff(bounds))
        spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], ["first", "last"]))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in block.rest.columns]
        yield pa.RecordBatch.from_arrays([*columns, kept, pa.array(size), pa.array(size - left), spans], [*block.rest.column_names, *RESULT])

    anchors = X.exchanged(docs, hold, folder)
    names = X.saved(anchors.select("block", "bucket").filter("bucket < 0"), folder, "names")
    known = X.saved(X.answered(anchors.filter("bucket >= 0"), functools.partial(_seen_twice, most), X.MESSAGE), folder, "known")
    X.dropped(spark, f"{folder}/messages")
    # stretches are the most that moves: they go from their blocks to the buckets and are not put to a table before
    windows = X.by_block(names, known, n, distinct, X.MESSAGE)
    answers = X.answered(windows, functools.partial(_sorted_windows, width), X.MESSAGE)
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    schema = T.StructType([*rest, T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)])
    return X.by_block(names, answers, n, apply, schema)


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """The documents, with all their columns, without the covered bytes; bytes of a character that was cut are left out too. n_chars, where there is one, is counted anew."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("others")) if others else docs
    got = cut(packed, width).withColumn("text", F.expr("try_validate_utf8(cast(kept as string))"))
    got = got.withColumn("text", F.coalesce("text", F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), "\ufffd", "")))
    columns = {c: F.col(c) if c in ("doc_id", "text") else F.col("others")[c] for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(*(v.alias(c) for c, v in columns.items()))

"""Verbatim overlap of documents with a benchmark, by suffix arrays of the documents.

Documents are sharded in blocks. A shard sorts the suffixes of its words, to a
bounded depth, and every suffix of every test item is searched in it by
bisection; so each window of an item has the range of places where it occurs.
Windows that follow one another in a document and in an item at once are one
maximal verbatim match, of whatever length; it comes with its item, its first
word in the document and its words. Items are searched in stated sets of
bounded size, so the benchmark may grow: Spark writes each set into the shared
folder, and a shard reads one after the other, so documents are read once.
Within a set each distinct window is searched once, whatever the number of
items that share it; items are named a few documents at a time.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower
case. A window is `width` consecutive words of an item, or all words of a
shorter item. Null and empty texts have no words; rows of documents with equal
ids are apart, rows of items with equal ids are one item if any of them occurs.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import shared_files
from . import splitting as S

#: Bytes of item texts that are searched at once, and of documents in a shard.
SET_BYTES, SHARD_BYTES = 8 << 20, 8 << 20

#: Pairs of a place and an item that holds its window, in memory at once.
EXPANDED = 1 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Starts, ends, words per text, and the words, lower case."""
    buf, offsets = S.joined(texts)
    buf = S.lower_ascii(buf)
    starts, ends = S.words(buf, offsets, "alnum")
    return starts, ends, np.diff(np.searchsorted(starts, offsets)), S.views(buf, starts, ends)


class Items:
    """A set of test items: their words as numbers, and their distinct windows, each with the suffixes that begin with it (members).

    Windows are equal if their words are, so a window that many items share is
    searched once. names are the items' distinct ids, sorted; an item without an
    id has none (-1).
    """

    def __init__(self, item_ids: list[str | None], texts: pa.Array, width: int):
        _, _, counts, words = _words(texts)
        found = words.dictionary_encode()
        self.vocabulary, self.width = found.dictionary, width
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n, ends = len(codes), np.cumsum(counts)
        left = np.repeat(ends, counts) - np.arange(n)  # words to the item's end
        first = np.arange(n) == np.repeat(ends - counts, counts)
        window = np.where(np.repeat(counts < width, counts), np.where(first, left, 0), np.where(left >= width, width, 0))
        at = np.flatnonzero(window)
        padded = np.append(codes, np.zeros(width, np.int64))
        name = np.zeros(len(at), np.int64)
        for k in range(width):  # windows are named word by word
            code = np.where(k < window[at], padded[at + k] + 1, 0)
            name = np.unique(name * (len(self.vocabulary) + 1) + code, return_inverse=True)[1].reshape(-1)
        order = np.argsort(name, kind="stable")
        self.members = at[order]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(name))]).astype(np.int64)
        self.one = self.members[self.bounds[:-1]]  # a suffix of each window
        self.codes, self.length = codes, window[self.one]
        self.item = np.repeat(np.arange(len(counts)), counts)  # of each suffix
        self.names = pa.array(sorted({i for i in item_ids if i is not None}), pa.string())
        self.name = pc.index_in(pa.array(item_ids, pa.string()), self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.names) else np.full(len(counts), -1)

    def holders(self, windows: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes from low to high that begin with each of the windows, in ascending order, and which window each is of."""
        if high is None:
            begin, end = self.bounds[windows], self.bounds[windows + 1]
        else:
            n = len(self.codes)
            keys = np.repeat(np.arange(len(self.one)), np.diff(self.bounds)) * n + self.members
            begin, end = (np.searchsorted(keys, windows * n + x) for x in (low, high))
        size = end - begin
        which = np.repeat(np.arange(len(windows)), size)
        return self.members[begin[which] + np.arange(len(which)) - (np.cumsum(size) - size)[which]], which


def search(rows: np.ndarray, keys: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrows [low, high) of sorted rows, equal before column k, to those that have keys there, by bisection."""
    out = []
    for side in (0, 1):
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            value = rows[np.minimum(mid, len(rows) - 1), k]
            go = open_ & ((value < keys) if not side else (value <= keys))
            a = np.where(go, mid + 1, a)
            b = np.where(open_ & ~go, mid, b)
        out.append(a)
    return out[0], out[1]


def places(items: Items, found: pa.DictionaryArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows occur in a shard of words, in ascending order, and which windows these are.

    Only suffixes that begin with the first two words of some window (or with a
    window of one word) are sorted; all others match none. A place has at most
    one window of each length, so this grows with the shard, not with the items
    that share a window.
    """
    depth, n = items.width, len(found)
    none = np.zeros(0, np.int64)
    if not len(items.one) or not n:
        return none, none
    as_item = pc.index_in(found.dictionary, items.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.full(n + depth, -1, np.int64)
    codes[:n] = as_item[found.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(counts)
    size = len(items.vocabulary) + 1
    one = np.zeros(size, bool)
    one[items.codes[items.one[items.length == 1]]] = True
    long = items.one[items.length > 1]
    pairs = np.unique(items.codes[long] * size + items.codes[long + 1])
    at = np.flatnonzero(codes[:n] >= 0)
    if len(pairs):
        pair = codes[at] * size + codes[at + 1]
        hit = (codes[at + 1] >= 0) & (pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair)
        at = at[hit | one[codes[at]]]
    else:
        at = at[one[codes[at]]]
    if not len(at):
        return none, none
    last = ends[np.searchsorted(ends, at, "right")] - at  # words to the document's end
    rows = codes[at[:, None] + np.arange(depth)] + 1
    rows[np.arange(depth) >= last[:, None]] = 0
    order = np.lexsort(rows.T[::-1])
    array, rows = at[order], rows[order]
    low, high = np.zeros(len(items.one), np.int64), np.full(len(items.one), len(rows))
    for k in range(depth):
        alive = np.flatnonzero((items.length > k) & (low < high))
        if not len(alive):
            break
        low[alive], high[alive] = search(rows, items.codes[items.one[alive] + k] + 1, np.full(len(alive), k), low[alive], high[alive])
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), size)
    place = array[low[which] + np.arange(len(which)) - (np.cumsum(size) - size)[which]]
    order = np.argsort(place, kind="stable")
    return place[order], which[order]


def maximal(items: Items, place: np.ndarray, window: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Columns document, name, first word in the shard and words: windows one word apart on both sides are one match.

    Windows are paired with the items that hold them, about EXPANDED pairs at a
    time: matches don't cross items, so ranges of items are apart.
    """
    weight = int(np.diff(items.bounds)[window].sum())
    cuts = [0, len(items.codes)]
    if weight > EXPANDED:
        held = np.sort(items.holders(np.unique(window))[0])
        inner = held[np.linspace(0, len(held) - 1, -(-weight // EXPANDED) + 1).astype(int)[1:-1]]
        inner = np.searchsorted(items.item, items.item[inner])  # the item's first word
        cuts = np.unique([0, *inner, len(items.codes)]).tolist()
    out = [np.zeros((4, 0), np.int64)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        suffix, which = items.holders(window, low, high) if len(cuts) > 2 else items.holders(window)
        at = place[which]
        order = np.lexsort((at, at - suffix))
        at, suffix, length = at[order], suffix[order], items.length[window[which[order]]]
        item, doc = items.item[suffix], np.searchsorted(ends, at, "right")
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(suffix) != 1) | (np.diff(item) != 0) | (np.diff(doc) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        out.append(np.stack([doc[first], items.name[item[first]], at[first], at[last] + length[last] - at[first]]))
    return np.concatenate(out, axis=1)


def _distinct(columns: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Columns in the order of by (the first counts most), equal ones once."""
    columns = columns[:, np.lexsort(by[::-1])]
    new = np.ones(columns.shape[1], bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    return columns[:, new]


def item_sets(benchmark: DataFrame, width: int) -> list[str]:
    """Files of the items in sets of about SET_BYTES, or one item, written by Spark into the shared folder; the driver gets their names."""
    folder, limit = X.workdir(benchmark.sparkSession), SET_BYTES
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in X.blocks(batches, limit):
            path = f"{folder}/{uuid.uuid4().hex}.items"
            with shared_files.written(path) as out:
                out.write(pickle.dumps(Items(table.column("item_id").to_pylist(), table.column("text"), width)))
            yield pa.RecordBatch.from_pydict({"path": [path]})

    n = max(1, -(-X.text_bytes(texts) // limit))
    return sorted(r["path"] for r in texts.repartition(n).mapInArrow(run, "path string").collect())


@functools.lru_cache(maxsize=1)
def _loaded(path: str) -> Items:
    system, at = shared_files.opened(path)
    with system.open_input_file(at) as f:
        return pickle.loads(f.read())


SPANS = "doc_id long, n_words long, n_hit long, hits array<struct<first:long,last:long>>, items array<string>, matches array<struct<item:string,first:long,words:long>>"


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, hits (spans of hit words), items (ids as strings, sorted and distinct) and matches of each document.

    matches: each maximal verbatim match of at least a window, with its item,
    first word in the document (from 0) and number of words, the longest first.
    Words of an item without an id are hit and matched (item null), but it is in
    no document's items. A document with many matches is one row with all of them.
    """
    paths, shard = item_sets(benchmark, width), SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in X.blocks(batches, shard):
            _, _, counts, words = _words(table.column("text"))
            yield from _reports(table.column("doc_id").combine_chunks(), words.dictionary_encode(), counts, paths)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def _lists(doc: np.ndarray, low: int, high: int, values: pa.Array) -> pa.ListArray:
    """The values of documents low to high, which are in order, as a list each."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(low, high + 1)), pa.int32()), values)


def _reports(doc_ids: pa.Array, found: pa.DictionaryArray, counts: np.ndarray, paths: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of SPANS, some documents at a time, so that what items share is expanded for these alone."""
    ends = np.cumsum(counts)
    starts, n, n_docs = ends - counts, len(found), len(counts)
    cover, weight, got = np.zeros(n + 1, np.int64), np.zeros(n_docs), []
    for path in paths:
        items = _loaded(path)
        place, window = places(items, found, counts)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + items.length[window], -1)
        weight += np.bincount(np.searchsorted(ends, place, "right"), np.diff(items.bounds)[window], n_docs)
        got.append((path, place, window))
    hit = np.concatenate([np.cumsum(cover[:-1]) > 0, [False]])
    edge = np.zeros(n + 1, bool)  # spans don't cross documents
    edge[starts] = edge[n] = True
    a = np.flatnonzero(hit & (edge | ~np.roll(hit, 1)))
    b = np.flatnonzero(np.roll(hit, 1) & (edge | ~hit))
    spans = np.searchsorted(ends, a, "right")
    hits = np.bincount(spans, b - a, n_docs).astype(np.int64)
    low = 0
    while low < n_docs:
        high = low + max(1, int(np.searchsorted(np.cumsum(weight[low : low + 2000]), EXPANDED, "right")))
        names, parts = pa.array([], pa.string()), []
        for path, place, window in got:
            x, y = np.searchsorted(place, [starts[low], ends[high - 1]])
            if x < y:
                items = _loaded(path)
                parts.append((items.names, maximal(items, place[x:y], window[x:y], ends)))
        if len(parts) == 1:
            names = parts[0][0]
        elif parts:  # names of all sets together
            names = pc.unique(pa.concat_arrays([x for x, _ in parts]))
            names = names.take(pc.sort_indices(names))
            for known, m in parts:
                m[1] = np.append(pc.index_in(known, names).to_numpy(zero_copy_only=False), -1).astype(np.int64)[m[1]]
        m = np.concatenate([np.zeros((4, 0), np.int64), *(x for _, x in parts)], axis=1)
        m = _distinct(m, m[0], -m[3], m[2], m[1])
        pairs = _distinct(m[:2, m[1] >= 0], *m[:2, m[1] >= 0])
        texts = names.take(pa.array(np.where(m[1] < 0, 0, m[1]), mask=m[1] < 0))
        mine = slice(*np.searchsorted(spans, [low, high]))
        first, last = a[mine] - starts[spans[mine]], b[mine] - starts[spans[mine]]
        columns = [
            doc_ids.slice(low, high - low),
            pa.array(counts[low:high], pa.int64()),
            pa.array(hits[low:high]),
            _lists(spans[mine], low, high, pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["first", "last"])),
            _lists(pairs[0], low, high, names.take(pa.array(pairs[1]))),
            _lists(m[0], low, high, pa.StructArray.from_arrays([texts, pa.array(m[2] - starts[m[0]]), pa.array(m[3])], ["item", "first", "words"])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "hits", "items", "matches"])
        low = high


def without_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs; rows stay where they are."""
    paths, shard = item_sets(benchmark, width), SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in X.blocks(batches, shard):
            _, _, counts, words = _words(table.column("text"))
            found, clean = words.dictionary_encode(), np.ones(len(counts), bool)
            for path in paths:
                clean[np.searchsorted(np.cumsum(counts), places(_loaded(path), found, counts)[0], "right")] = False
            yield from table.filter(pa.array(clean)).to_batches(4000)

    return docs.mapInArrow(run, docs.schema)

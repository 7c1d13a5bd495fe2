"""Near-duplicate groups by bottom-k sketches of one hash function.

A document is the set of its word shingles, as 64-bit hashes of one function.
Equal sets are one class; one document of each class goes on. A sketch is the
SKETCH least hashes of a set. If two sets are similar to 0.8, the least SKETCH
hashes of their union are shared to 0.8 on average, and fewer than half of them
are in one case of ten millions or fewer (a binomial tail; sets that are
sketched whole lose nothing). So a document enters the inverted lists of the
rarer half, and one, of its retained hashes: two sketches that share half of
their values meet in such a list. Hashes are ordered by how many sketches hold
them, so very common shingles get no lists.

Lists give overlaps. (1) In each list the first member is a leader; members
that may be similar to it follow it, the others choose a leader among
themselves, and so on: unrelated documents that share a shingle are told apart
by their least DIGEST retained hashes and form no pair. (Of two sets similar to
0.8, fewer than SHARED of the DIGEST are equal in one case of 10 to the 8.) A
list of more than LIST members is dealt in pieces first, whose leaders meet
under their digests. Each document keeps its best leader; the estimate over the
sketch of the union, then the full sets decide. (2) Leaders with
their followers, and followers of different leaders of a list that share enough
of their digests, may still be in several components; these are put together by
their main component. There the documents that share values of their digests across
components meet, those outside of the main component with all, in cells of
bounded size: first their sketches, then, of those that still may be similar,
the full sets; a cell gives one link for each document and component. So no group is expanded into its pairs, unrelated documents are not
compared, and no link between components is left out.

Sketches and texts lie in one file a block of documents in the shared folder; sets
are made again where a block's documents are asked for; only those move. Keys are counted in
packed messages (see exchange), and joins by nodes or lists of very many rows
are spread, so no task holds a hot key.

Words are runs without white space, A-Z in lower case. A text of fewer words
than a shingle is one shingle; without words (null, empty) it is alone. Rows
stand for themselves, also with equal or null doc_id; a component's id is its
smallest doc_id, null if all are. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import shared_files
from . import splitting as S
from .components import components

#: Hashes retained; the least of them that tell unrelated documents apart, and how many of those must be equal.
SKETCH, DIGEST, SHARED = 64, 16, 3
#: Bytes of text and documents in a block; members of a list, or of a piece of it; followers that share a cell with their leader.
BLOCK_BYTES, BLOCK_DOCS, LIST, FOLLOWERS = 8 << 20, 1 << 15, 4096, 256
#: Documents and shingles on each side of a cell; bytes of input for each bucket of lists and cells.
CELL_DOCS, CELL_SHINGLES, BUCKET_BYTES = 512, 1 << 20, 16 << 20
_TOP, _ODD = np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the bounds of each text's."""
    buf, offsets = S.joined(texts)
    buf = S.lower_ascii(buf)
    starts, ends = S.words(buf, offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    found = S.views(buf, starts, ends).dictionary_encode()
    word = X.hashes(found.dictionary)[found.indices.to_numpy()]
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        h = word.copy()
        n = np.full(len(word), shingle)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(word))
        first = left == np.repeat(counts, counts)
        for k in range(1, shingle):
            more = left > k
            h[:-k][more[:-k]] = X.mix(h[:-k][more[:-k]] * _ODD + word[k:][more[:-k]]) if len(h) > k else h[:0]
        h = X.mix(h + np.minimum(left, n).astype(np.uint64))
    keep = (left >= shingle) | first & (left < shingle)
    h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


class Block:
    """A block's documents and its classes of equal sets, as its file has them. A class is numbered block << 16 | its place.

    A class keeps its sketch and one text: hashes don't compress and a set takes
    more than its text, so whole sets are made again where they are asked for.
    """

    HEAD = ("doc_id", "null", "text_hash", "place", "size", "first", "second", "least", "sketch")

    def __init__(self, folder: str, number: int, head: dict[str, np.ndarray], shingle: int, texts: pa.Array | None = None):
        self.folder, self.number, self.head, self.shingle, self.texts = folder, number, head, shingle, texts
        self.size = head["size"].astype(np.int64)
        self.rid = (number << 16) + np.arange(len(self.size))
        self.kept = np.minimum(self.size, SKETCH)

    @classmethod
    def made(cls, folder: str, number: int, table: pa.Table, shingle: int) -> Block:
        values, bounds = shingle_hashes(table.column("text"), shingle)
        ids = table.column("doc_id").combine_chunks()
        null = np.asarray(ids.is_null())
        doc_id = ids.fill_null(_NONE).to_numpy()
        place, seen, own, rows, prints, least = np.zeros(len(ids), np.int64), {}, [], [], [], []
        for k in range(len(ids)):
            part = values[bounds[k] : bounds[k + 1]]
            if not len(part):
                continue
            name = hashlib.blake2b(part.tobytes(), digest_size=16).digest()
            if name not in seen:
                seen[name] = len(own)
                own.append(part)
                rows.append(k)
                prints.append(name)
                least.append(_NONE)
            place[k] = 1 + seen[name]
            least[seen[name]] = min(least[seen[name]], int(doc_id[k]))
        prints = np.frombuffer(b"".join(prints), "<u8").reshape(-1, 2)
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
        head = {
            "doc_id": doc_id, "null": null.astype(np.uint8), "text_hash": table.column("text_hash").to_numpy(), "place": X.narrow(place),
            "size": X.narrow(np.array([len(x) for x in own], np.int64)), "first": prints[:, 0], "second": prints[:, 1], "least": np.array(least, np.int64), "sketch": flat([x[:SKETCH] for x in own]),
        }
        return cls(folder, number, head, shingle, table.column("text").combine_chunks().take(pa.array(rows, pa.int64())))

    def write(self) -> None:
        head = X.pack(*(self.head[k] for k in self.HEAD))
        buf, offsets = S.joined(self.texts)
        with shared_files.written(f"{self.folder}/sets/{self.number}") as out:
            out.write(struct.pack("<QQ", len(head), self.shingle) + head + X.pack(X.narrow(np.diff(offsets)), buf, level=3))

    @classmethod
    def read(cls, folder: str, number: int, whole: bool = False) -> Block:
        system, path = shared_files.opened(f"{folder}/sets/{number}")
        with system.open_input_file(path) as f:
            n, shingle = struct.unpack("<QQ", f.read(16))
            head = dict(zip(cls.HEAD, X.unpack(f.read(n)), strict=True))
            return cls(folder, number, head, shingle, X.binaries(*X.unpack(f.read())).view(pa.string()) if whole else None)

    def sets(self, at: np.ndarray, whole: bool) -> list[bytes]:
        """The hashes of each of these classes, all or only the sketch."""
        own, of = np.unique(at, return_inverse=True)
        if whole:
            values, bounds = shingle_hashes(self.texts.take(pa.array(own)), self.shingle)
        else:
            values, bounds = X.lists_at(np.append(0, np.cumsum(self.kept)), self.head["sketch"], own)
        sets = [values[bounds[k] : bounds[k + 1]].tobytes() for k in range(len(own))]
        return [sets[k] for k in of]

    def dealt(self, n: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Distinct retained values, in how many classes each is, and for each bucket its values and classes."""
        values, times = np.unique(self.head["sketch"], return_counts=True)
        none = np.zeros(0, np.int64)
        out = {b: (at, none) for b, at in X.split_buckets((values % np.uint64(n)).astype(np.int64))}
        for b, at in X.split_buckets((self.head["first"] % np.uint64(n)).astype(np.int64)):
            out[b] = (out.get(b, (none,))[0], at)
        return values, times, out

    def digests(self) -> np.ndarray:
        """The least DIGEST values of each class; of fewer, the first again."""
        at = np.cumsum(self.kept) - self.kept
        k = np.arange(DIGEST)
        return self.head["sketch"][(at[:, None] + np.where(k < self.kept[:, None], k, 0)).ravel()].reshape(-1, DIGEST)


_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
MESSAGE = "block long, bucket int, blob binary"


def _put_rows(name: str, rows: pa.Table) -> None:
    with shared_files.written(name) as out, pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(rows)


def _got_rows(name: str) -> pa.Table:
    system, path = shared_files.opened(name)
    with system.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def _scan(folder: str, shingle: int, n: int, limit: int, rows_at: str | None):
    """Writes the blocks' files, and their rows if asked for; sends each bucket the distinct values and classes. Bucket -1 names each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for _, table in X.blocks(batches, limit):
            for first in range(0, table.num_rows, BLOCK_DOCS):
                part = table.slice(first, BLOCK_DOCS)
                if rows_at:
                    _put_rows(f"{rows_at}/{number}", part.select(["text", "row"]))
                block = Block.made(folder, number, part, shingle)
                block.write()
                values, times, dealt = block.dealt(n)
                rows = [{"block": number, "bucket": -1, "blob": None}]
                for b, (at, own) in dealt.items():
                    rows.append({"block": number, "bucket": b, "blob": X.pack(np.diff(values[at] // np.uint64(n), prepend=np.uint64(0)), X.narrow(times[at]), block.head["first"][own], block.head["second"][own], X.narrow(own), block.head["least"][own])})
                yield pa.RecordBatch.from_pylist(rows, _MESSAGE)
                number += 1

    return run


def _counted(table: pa.Table) -> pa.Table:
    """How many classes hold each value; of each set the least class and doc_id."""
    each = [X.unpack(b) for b in table.column("blob").to_pylist()]
    values = [np.cumsum(x[0], dtype=np.uint64) for x in each]
    _, at = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([x[1] for x in each])).astype(np.int64)[at]
    first, second, least = (np.concatenate([x[k] for x in each]) for k in (2, 3, 5))
    rid = np.concatenate([(b << 16) + x[4].astype(np.int64) for b, x in zip(table.column("block").to_pylist(), each, strict=True)])
    order = np.lexsort((rid, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    heads = np.flatnonzero(new)
    rep, doc, group = np.empty(len(rid), np.int64), np.empty(len(rid), np.int64), np.cumsum(new) - 1
    if len(rid):
        rep[order], doc[order] = rid[order][heads][group], np.minimum.reduceat(least[order], heads)[group]
    cuts, marks = (np.cumsum([len(x) for x in y])[:-1] for y in (values, [e[2] for e in each]))
    blobs = [X.pack(X.narrow(c), r, d) for c, r, d in zip(np.split(total, cuts), np.split(rep, marks), np.split(doc, marks), strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())}, _MESSAGE)


POSTED = "kind int, block long, bucket int, blob binary, rid long, rep long, doc long"
_POSTED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("rid", pa.int64()), ("rep", pa.int64()), ("doc", pa.int64())])


def _piece_keys(values: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return np.where(piece > 0, X.mix(values + piece.astype(np.uint64) * _ODD), values)


def _postings(folder: str, n: int, num: int, den: int, most: int):
    """Kind 0: to each bucket its lists' members; kind 1: each class with the least class and doc_id of its set."""

    def run(table: pa.Table) -> pa.Table:
        block = Block.read(folder, table.column("block")[0].as_py())
        values, _, dealt = block.dealt(n)
        total, rep, doc = np.zeros(len(values), np.int64), np.zeros(len(block.rid), np.int64), np.zeros(len(block.rid), np.int64)
        for b, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True):
            at, own = dealt[b]
            total[at], rep[own], doc[own] = X.unpack(blob)
        flat, kept, size = block.head["sketch"], block.kept, block.size
        cls = np.repeat(np.arange(len(kept)), kept)
        many = total[np.searchsorted(values, flat)]
        order = np.lexsort((flat, many, cls))  # the rarest first
        place = np.arange(len(flat)) - np.repeat(np.cumsum(kept) - kept, kept)
        keep = order[(place <= (kept - least_shared(size, num, den))[cls]) & (many[order] > 1) & (rep == block.rid)[cls]]
        value, many, cls = flat[keep], many[keep], cls[keep]
        piece = np.where(many > most, 1 + (X.mix(block.rid[cls].astype(np.uint64)) % np.maximum(-(-many // most), 1).astype(np.uint64)).astype(np.int64), 0)
        digest = (block.digests() & np.uint64(0xFFFF)).astype(np.uint16)
        rows = []
        for b, at in X.split_buckets((_piece_keys(value, piece) % np.uint64(n)).astype(np.int64)):
            at = at[np.argsort(value[at], kind="stable")]
            own, of = np.unique(cls[at], return_inverse=True)
            blob = X.pack(np.diff(value[at], prepend=np.uint64(0)), X.narrow(piece[at]), X.narrow(of), block.rid[own], X.narrow(size[own]), digest[own].ravel())
            rows.append({"kind": 0, "block": block.number, "bucket": b, "blob": blob})
        classes = pa.table({"kind": pa.array(np.ones(len(rep), np.int32)), "rid": pa.array(block.rid), "rep": pa.array(rep), "doc": pa.array(doc, mask=doc == _NONE)})
        blank = [pa.nulls(len(rep), _POSTED.field(x).type) for x in ("block", "bucket", "blob")]
        classes = pa.Table.from_arrays([classes.column("kind"), *blank, *(classes.column(x) for x in ("rid", "rep", "doc"))], schema=_POSTED)
        return pa.concat_tables([pa.Table.from_pylist(rows, _POSTED), classes])

    return run


def near(a: np.ndarray, b: np.ndarray, size: np.ndarray, digest: np.ndarray, num: int, den: int) -> np.ndarray:
    """Values of the digests that the pairs share; 0 where sizes or digests rule out that they are similar."""
    out = np.zeros(len(a), np.int64)
    x, y = size[a], size[b]
    at = np.flatnonzero(den * np.minimum(x, y) >= num * np.maximum(x, y))
    for k in range(0, len(at), 1 << 14):
        i = at[k : k + (1 << 14)]
        p, q = digest[a[i]], digest[b[i]]
        shared = ((p[:, :, None] == q[:, None, :]).any(2) & (np.arange(DIGEST) < size[a[i], None])).sum(1)
        out[i] = np.where(shared >= SHARED, shared, 0)
    return out


def leaders(key: np.ndarray, size: np.ndarray, digest: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of members sorted by list: the leader that each follows, or itself; the values shared; and which lists have followers, by member."""
    lead, shared, alive = np.arange(len(key)), np.zeros(len(key), np.int64), np.arange(len(key))
    while len(alive):
        head = np.ones(len(alive), bool)
        head[1:] = key[alive][1:] != key[alive][:-1]
        a, b = alive[head][np.cumsum(head) - 1][~head], alive[~head]
        got = near(a, b, size, digest, num, den)
        lead[b[got > 0]], shared[b] = a[got > 0], got
        alive = b[got == 0]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    of = np.cumsum(first) - 1
    return lead, shared, (np.bincount(of, weights=shared) > 0)[of] if len(key) else np.zeros(0, bool)


def _crossing(key: np.ndarray, lead: np.ndarray, size: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which members share SHARED values of their digests with members of their list that have other leaders, whichever those are."""
    many = np.minimum(size, DIGEST)
    row = np.repeat(np.arange(len(key)), many)
    column = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    _, which = np.unique(X.mix(key[row] + (digest[row, column].astype(np.uint64) + np.uint64(1)) * _ODD), return_inverse=True)
    order = np.lexsort((lead[row], which))
    new = np.ones(len(order), bool)
    new[1:] = (which[order][1:] != which[order][:-1]) | (lead[row][order][1:] != lead[row][order][:-1])
    return np.bincount(row, weights=np.bincount(which[order[new]])[which] > 1, minlength=len(key)) >= SHARED if len(row) else np.zeros(len(key), bool)


LISTED = "kind int, rid long, a long, chunk long, shared int, value long, n long, digest binary"
_LISTED = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("a", pa.int64()), ("chunk", pa.int64()), ("shared", pa.int32()), ("value", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def _listed(kind: int, rid: np.ndarray, **columns) -> pa.Table:
    whole = {"kind": pa.array(np.full(len(rid), kind, np.int32)), "rid": pa.array(rid)} | columns
    return pa.Table.from_arrays([whole.get(f.name, pa.nulls(len(rid), f.type)) for f in _LISTED], schema=_LISTED)


def _followers(key: np.ndarray, rid: np.ndarray, lead: np.ndarray, shared: np.ndarray, together: int) -> pa.Table:
    """Kind 0: each document's best leader in these lists. chunk: so that not too many share a cell with it."""
    at = np.flatnonzero(lead != np.arange(len(lead)))
    a = lead[at]
    order = np.argsort(a, kind="stable")
    place = np.empty(len(at), np.int64)
    sizes = np.diff(np.append(np.flatnonzero(np.diff(a[order], prepend=-1)), len(at)))
    place[order] = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    best = np.lexsort((rid[a], -shared[at], rid[at]))
    best = best[np.diff(rid[at][best], prepend=-1) != 0]
    at, a, place = at[best], a[best], place[best]
    return _listed(0, rid[at], a=pa.array(rid[a]), chunk=pa.array(place // together), shared=pa.array(shared[at].astype(np.int32)))


def _lists(num: int, den: int, together: int):
    """Kind 0: best leaders; kind 1: leaders with those that follow them, members of lists that may be similar to others' followers, and of lists in pieces; kind 2: leaders of pieces."""

    def run(table: pa.Table) -> pa.Table:
        value, piece, rid, size, digest = [], [], [], [], []
        for blob in table.column("blob").to_pylist():
            gaps, p, of, r, s, d = X.unpack(blob)
            value.append(np.cumsum(gaps, dtype=np.uint64))
            piece.append(p.astype(np.int64))
            rid.append(r[of])
            size.append(s[of].astype(np.int64))
            digest.append(d.reshape(-1, DIGEST)[of])
        value, piece, rid, size, digest = (np.concatenate(x) for x in (value, piece, rid, size, digest))
        key = _piece_keys(value, piece)
        order = np.lexsort((rid, key))
        value, piece, rid, size, digest, key = (x[order] for x in (value, piece, rid, size, digest, key))
        lead, shared, some = leaders(key, size, digest, num, den)
        some = np.flatnonzero(some & (piece == 0))
        members = np.append(some[_crossing(key[some], lead[some], size[some], digest[some])], np.flatnonzero(piece > 0))
        some = some[np.bincount(lead[some], minlength=len(lead))[lead[some]] > 1]
        own = X.mix(value[some] + (rid[lead[some]].astype(np.uint64) + np.uint64(1)) * _ODD)
        top = np.flatnonzero((piece > 0) & (lead == np.arange(len(lead))))
        return pa.concat_tables([
            _followers(key, rid, lead, shared, together),
            _listed(1, rid[members], value=pa.array(value[members].view(np.int64))),
            _listed(1, rid[some], value=pa.array(own.view(np.int64))),
            _listed(2, rid[top], value=pa.array(value[top].view(np.int64)), n=pa.array(size[top]), digest=pa.array([x.tobytes() for x in digest[top]], pa.binary())),
        ])

    return run


def _met(n: int):
    """Leaders of pieces, under each value of their digests; bucket in place of kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, value, size = (batch.column(x).to_numpy() for x in ("rid", "value", "n"))
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint16).reshape(-1, DIGEST)
            at = np.repeat(np.arange(len(rid)), np.minimum(size, DIGEST))
            j = np.arange(len(at)) - np.repeat(np.cumsum(np.minimum(size, DIGEST)) - np.minimum(size, DIGEST), np.minimum(size, DIGEST))
            key = X.mix(value.view(np.uint64)[at] + (digest[at, j].astype(np.uint64) + np.uint64(1)) * _ODD)
            rows = _listed(0, rid[at], value=pa.array(key.view(np.int64)), n=pa.array(size[at]), digest=pa.array([x.tobytes() for x in digest[at]], pa.binary()))
            yield from rows.set_column(0, "kind", pa.array((key % np.uint64(n)).astype(np.int32))).to_batches(10_000)

    return run


def _upper(num: int, den: int, together: int):
    def run(table: pa.Table) -> pa.Table:
        key, rid, size = table.column("value").to_numpy().view(np.uint64), table.column("rid").to_numpy(), table.column("n").to_numpy()
        digest = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint16).reshape(-1, DIGEST)
        order = np.lexsort((rid, key))
        key, rid, size, digest = key[order], rid[order], size[order], digest[order]
        lead, shared, _ = leaders(key, size, digest, num, den)
        return _followers(key, rid, lead, shared, together)

    return run


def estimates(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Share of the least SKETCH hashes of each union that both sets hold."""
    rows = np.full((len(a), 2 * SKETCH), _TOP)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        rows[k, : len(x)] = x
        rows[k, SKETCH : SKETCH + len(y)] = y
    rows.sort(axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    new &= rows != _TOP
    both = np.zeros(rows.shape, bool)
    both[:, :-1] = new[:, :-1] & ~new[:, 1:] & (rows[:, 1:] != _TOP)
    least = np.cumsum(new, axis=1) <= SKETCH
    return (both & least).sum(1) / np.maximum((new & least).sum(1), 1)


def least_shared(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Retained values that a set of so many shingles shares with each that is similar; of small sets all partners are sketched whole."""
    return np.where(size * den <= SKETCH * num, -(-num * size // den), np.minimum(size, SKETCH) // 2)


def _inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values in order, and which set each is of."""
    values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    return values[order], of[order]


def _overlap(values: np.ndarray, of: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """How many values of `own` each of n sets holds."""
    low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
    many = high - low
    return np.bincount(of[np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)], minlength=n)


def cell_promising(component: np.ndarray, asks: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which documents of a cell may be similar to one of another component on its other side, as far as sketches tell."""
    at, ask, out = np.flatnonzero(~asks), np.flatnonzero(asks), np.zeros(len(asks), bool)
    if not len(at) or not len(ask):
        return out
    need = least_shared(np.array([len(x) for x in sketches]), num, den)
    values, of = _inverted([sketches[k] for k in at])
    for k in ask:
        hit = (_overlap(values, of, sketches[k], len(at)) >= np.maximum(need[at], need[k])) & (component[at] != component[k])
        out[at[hit]] = True
        out[k] = hit.any()
    return out


def cell_links(rid: np.ndarray, component: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Of documents that ask and documents that are asked: links that join all components of the cell that similar documents join.

    A link between components that earlier links of the cell have joined says
    nothing new, so there are fewer links than documents, however many are similar.
    """
    at, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
    if not len(at) or not len(ask):
        return []
    if len(at) == 1:  # followers and their leader
        ask = ask[component[ask] != component[at[0]]]
        head = sets[at[0]]
        ask = ask[estimates([sets[k][:SKETCH] for k in ask], [head[:SKETCH]] * len(ask)) >= 0.5] if len(ask) else ask
        out = []
        for k in ask:
            place = np.minimum(np.searchsorted(head, sets[k]), len(head) - 1)
            shared = int((head[place] == sets[k]).sum())
            if den * shared >= num * (len(head) + len(sets[k]) - shared):
                out.append((int(rid[at[0]]), int(rid[k])))
        return out
    size = np.array([len(sets[k]) for k in at])
    values, of = _inverted([sets[k] for k in at])
    joined = np.unique(component, return_inverse=True)[1]
    out = []
    for k in ask:
        shared = _overlap(values, of, sets[k], len(at))
        hit = np.flatnonzero((den * shared >= num * (len(sets[k]) + size - shared)) & (joined[at] != joined[k]))
        if len(hit):
            other, first = np.unique(joined[at[hit]], return_index=True)
            out += [(int(rid[at[x]]), int(rid[k])) for x in hit[first]]
            joined[np.isin(joined, other)] = joined[k]
    return out


def _fetched(asked: DataFrame, folder: str, n: int, whole: bool) -> DataFrame:
    """Documents (rid, component, asks) of cells (c1, c2) with their sets, or only their sketches, from the blocks' files."""

    def fetch(table: pa.Table) -> pa.Table:
        block = Block.read(folder, table.column("block")[0].as_py(), whole)
        at = table.column("rid").to_numpy() & 0xFFFF
        sets = block.sets(at, whole)
        return table.drop_columns(["block"]).append_column("members", pa.array(sets, pa.large_binary() if sum(map(len, sets)) > 1 << 30 else pa.binary()))

    got = asked.select(F.shiftright("rid", 16).alias("block"), "c1", "c2", "rid", "component", "asks").repartition(n, "block").groupBy("block").applyInArrow(fetch, "c1 long, c2 long, rid long, component long, asks boolean, members binary")
    return got.withColumn("deal", F.pmod(F.xxhash64("c1", "c2"), F.lit(n)))


def _cells(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of each cell the rows, and their documents, components, roles and values."""
    c1, c2, rid, component, asks = (np.asarray(table.column(x)) for x in ("c1", "c2", "rid", "component", "asks"))
    members = table.column("members")
    order = np.lexsort((rid, c2, c1))
    new = np.flatnonzero((np.diff(c1[order], prepend=-1) != 0) | (np.diff(c2[order], prepend=-1) != 0))
    for own in np.split(order, new[1:]):
        yield own, rid[own], component[own], asks[own], [np.frombuffer(members[int(k)].as_buffer(), "<u8") for k in own]


def _promising(asked: DataFrame, folder: str, n: int, num: int, den: int) -> DataFrame:
    """The documents of cells whose sketches leave it open that they are similar to one on the other side."""

    def keep(table: pa.Table) -> pa.Table:
        out = np.zeros(table.num_rows, bool)
        for own, _, component, asks, sketches in _cells(table):
            out[own] = cell_promising(component, asks, sketches, num, den)
        return table.select(["c1", "c2", "rid", "component", "asks"]).filter(pa.array(out))

    return _fetched(asked, folder, n, False).groupBy("deal").applyInArrow(keep, "c1 long, c2 long, rid long, component long, asks boolean")


def _verified(asked: DataFrame, folder: str, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of documents that meet in cells, by their whole sets."""

    def links(table: pa.Table) -> pa.Table:
        out = []
        for _, rid, component, asks, sets in _cells(table):
            out += cell_links(rid, component, asks, sets, num, den)
        a, b = ([x[k] for x in out] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _fetched(asked, folder, n, True).groupBy("deal").applyInArrow(links, "a long, b long")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))


def _across(members: DataFrame, label: DataFrame, folder: str, n: int, num: int, den: int) -> DataFrame:
    """Links between components whose documents share lists (value, rid)."""
    spark = members.sparkSession
    rows = X.saved(_labelled(members, label), folder, "members")
    total = rows.count()
    parts = rows.groupBy("value", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("value").agg(F.max_by("component", F.struct("k", -F.col("component"))).alias("main"), F.sum("k").alias("w"), F.count("*").alias("parts")).filter("parts > 1")
    own = X.spread_join(rows, main.select("value", "main", "w"), "value", "w", total).select("main", "rid", "component").distinct()

    def digests(table: pa.Table) -> pa.Table:
        block = Block.read(folder, table.column("block")[0].as_py())
        at = table.column("rid").to_numpy() & 0xFFFF
        many = np.minimum(block.size[at], DIGEST)
        row = np.repeat(np.arange(len(at)), many)
        column = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        out = table.drop_columns(["block"]).take(pa.array(row))
        return out.append_column("n", pa.array(block.size[at][row])).append_column("value", pa.array(block.digests()[at][row, column].view(np.int64)))

    each = own.withColumn("block", F.shiftright("rid", 16)).groupBy("block").applyInArrow(digests, "main long, rid long, component long, n long, value long")
    each = X.saved(each, folder, "digests")
    meet = each.groupBy("main", "value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("w")).filter("low < high").select("main", "value", "w")
    found = X.saved(X.spread_join(each, meet, ["main", "value"], "w", 16 * total), folder, "shared")
    found = X.saved(found.groupBy("main", "rid", "component", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= SHARED).drop("k"), folder, "found")
    side = lambda c: F.greatest(F.ceil(F.sum(F.when(c, 1).otherwise(0)) / CELL_DOCS), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / CELL_SHINGLES), F.lit(1)).cast("int")
    size = found.groupBy("main").agg(side(F.col("component") != F.col("main")).alias("outers"), side(F.lit(True)).alias("alls"), F.count("*").alias("w"))
    at = X.saved(X.spread_join(found, size, "main", "w", total), folder, "placed")
    place = lambda c, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keep = ["main", "rid", "component"]
    asking = at.filter("component <> main").withColumn("i", place("outers", 1)).withColumn("j", every("alls")).select(*keep, "i", "j", F.lit(True).alias("asks"))
    asked = at.withColumn("j", place("alls", 2)).withColumn("i", every("outers")).select(*keep, "i", "j", F.lit(False).alias("asks"))
    cells = asking.unionByName(asked.select(*keep, "i", "j", "asks")).select(F.col("main").alias("c1"), F.expr("shiftleft(cast(i as long), 32) + j").alias("c2"), "rid", "component", "asks")
    open_ = X.saved(_promising(cells, folder, n, num, den), folder, "open")
    out = X.saved(_verified(open_, folder, n, num, den), folder, "links-2")
    X.dropped(spark, *(f"{folder}/{x}" for x in ("members", "digests", "shared", "found", "placed")))
    return out


def groups(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, folder: str | None = None, rows_at: str | None = None) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, class_id (smallest doc_id of equal sets) and component_id of each row.

    Sets are linked where den * intersection >= num * union; num / den is at
    least 0.8, which the sketches' bounds rest on. The result is read from files
    in the folder, a new one of the shared folder if not given. With rows_at, the
    blocks' texts and other columns are put there, and block and at say where.
    """
    if 5 * num < 4 * den:
        raise ValueError("the threshold must be 0.8 or more")
    spark = docs.sparkSession
    folder = folder or X.workdir(spark)
    row = [F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row")] if rows_at else []
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"), *row)
    n = X.deal(spark, X.input_bytes(docs), BUCKET_BYTES)
    shared_files.folder(f"{folder}/sets")
    sent = X.saved(docs.mapInArrow(X.tidy(_scan(folder, shingle, n, BLOCK_BYTES, rows_at)), MESSAGE), folder, "messages")
    counts = X.answered(sent.filter("bucket >= 0"), _counted, MESSAGE)
    posted = X.saved(counts.repartition(n, "block").groupBy("block").applyInArrow(_postings(folder, n, num, den, LIST), POSTED), folder, "postings")
    names = X.saved(sent.select("block", "bucket").filter("bucket = -1").select("block"), folder, "names")
    X.dropped(spark, f"{folder}/messages")
    listed = X.saved(X.answered(posted.filter("kind = 0").select("block", "bucket", "blob"), _lists(num, den, FOLLOWERS), LISTED), folder, "lists")
    classes = X.saved(posted.filter("kind = 1").select("rid", "rep", "doc"), folder, "classes")
    X.dropped(spark, f"{folder}/postings")
    follow = listed.filter("kind = 0")
    if not (pieces := listed.filter("kind = 2")).isEmpty():
        met = pieces.mapInArrow(_met(n), LISTED).withColumnRenamed("kind", "bucket")
        follow = follow.unionByName(met.groupBy("bucket").applyInArrow(_upper(num, den, FOLLOWERS), LISTED))
    best = follow.groupBy("rid").agg(F.max_by(F.struct("a", "chunk"), F.struct("shared", -F.col("a"))).alias("x")).select("rid", F.col("x.a").alias("c1"), F.col("x.chunk").alias("c2"))
    best = X.saved(best, folder, "best")
    asking = best.select("c1", "c2", "rid", F.col("rid").alias("component"), F.lit(True).alias("asks"))
    asked = best.select("c1", "c2").distinct().select("c1", "c2", F.col("c1").alias("rid"), F.col("c1").alias("component"), F.lit(False).alias("asks"))
    links = X.saved(_verified(asking.unionByName(asked), folder, n, num, den), folder, "links")
    label = X.saved(components(links, f"{folder}/first"), folder, "labels")
    more = _across(listed.filter("kind = 1").select("rid", "value"), label, folder, n, num, den)
    if not more.isEmpty():
        label = X.saved(components(links.unionByName(more), f"{folder}/second"), folder, "labels-2")
    least = label.join(classes.filter("rid = rep").select(F.col("rep").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("id"), F.count("*").alias("w"))
    ids = X.spread_join(label, least, "component", "w", label.count()).select(F.col("node").alias("rep"), "id")
    named = classes.join(ids, "rep", "left").select(F.shiftright("rid", 16).alias("block"), "rid", "doc", F.coalesce("id", "doc").alias("id"))
    whole = named.unionByName(names.select("block", *(F.lit(None).cast("long").alias(x) for x in ("rid", "doc", "id"))))

    def result(table: pa.Table) -> pa.Table:
        block = Block.read(folder, table.column("block")[0].as_py())
        table = table.filter(pa.compute.is_valid(table.column("rid"))).sort_by("rid")
        place = block.head["place"].astype(np.int64)
        ids = pa.array(block.head["doc_id"], mask=block.head["null"].astype(bool))
        at = pa.array(place - 1, mask=place == 0)
        own = [pa.compute.if_else(at.is_null(), ids, table.column(x).combine_chunks().take(at)) for x in ("doc", "id")]
        size = np.append(0, block.size)[place]
        out = {"doc_id": ids, "text_hash": pa.array(block.head["text_hash"]), "n_shingles": pa.array(size), "class_id": own[0], "component_id": own[1]}
        if rows_at:
            out |= {"block": pa.array(np.full(len(size), block.number)), "at": pa.array(np.arange(len(size)))}
        return pa.table(out)

    schema = "doc_id long, text_hash long, n_shingles long, class_id long, component_id long" + (", block long, at long" if rows_at else "")
    return whole.repartition(n, "block").groupBy("block").applyInArrow(result, schema)


def without_near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents, with all their columns, of which no near copy has a smaller doc_id.

    Rows that repeat a doc_id are told apart by their texts; a row without a
    doc_id goes if a near copy has one. The result is read from the blocks' rows
    in the shared folder: only places in blocks are shuffled, never texts.
    """
    spark = docs.sparkSession
    folder = X.workdir(spark)
    n = X.deal(spark, X.input_bytes(docs), BUCKET_BYTES)
    rows_at, names = f"{folder}/rows", docs.columns
    found = groups(docs, shingle, folder=f"{folder}/groups", rows_at=rows_at).filter("doc_id <=> component_id")
    kept = X.saved(found.groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("at")), folder, "kept")  # at most BLOCK_DOCS a block
    X.dropped(spark, f"{folder}/groups")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at in zip(batch.column("block").to_pylist(), batch.column("at"), strict=True):
                rows = _got_rows(f"{rows_at}/{block}").take(at.values)
                others = iter(rows.column("row").combine_chunks().flatten())
                columns = [rows.column("text").combine_chunks() if c == "text" else next(others) for c in names]
                yield from pa.table(columns, names).to_batches(2000)

    return kept.repartition(n, "block").mapInArrow(X.tidy(left), docs.schema)

"""A Katz backoff model of word trigrams, and the log10 probability of every text under it.

Counts up to MOST are discounted by Good and Turing's estimate, the rest goes to
lower orders: P(w | u v) is d(c) c(u, v, w) / c(u, v) for triples seen in training
and alpha(u, v) P(w | v) for others; P(w | v) is d(c) c(v, w) / c(v) for pairs seen
and alpha(v) P(w) for others. An alpha is exact: what the seen continuations leave
of 1, divided by what they leave of 1 in the lower order; so P( . | h) sums to 1
over the training words and the one type that stands for all unknown words. A
history that is not in training leaves all to the lower order. P(w) is
d(c) c(w) / N, and what the words leave of 1 is the unknown type's. Where all
continuations of a history occur more than MOST times, discounts leave nothing
and one count is added to its total for the rest. The first word of a text has
the begin alone as its history.

The counts live in tables dealt by hash: a bucket of words has their counts and
numbers, a bucket of pairs or triples their counts. Blocks of documents send the
distinct words, pairs and triples that they hold, with their training counts, and
get the global counts back; buckets send what each history's backoff weight needs
to the bucket of that history. Triples whose history is in no other block stay in
the block, as it has all their counts, and triples whose history was not in
training are not sent. Then every token is evaluated in its block: the triple, and
where it is unseen, recursively the pair, the word, and the unknown type.

A-Z is in lower case, words are runs without white space, one end follows each
text. A null text is empty and holds only its end. Rows stand for themselves;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import exchange as X
from . import splitting as S

#: Largest count that is discounted; text in a block; input for each bucket; tokens of a history whose continuations share a bucket.
MOST, BLOCK_BYTES, BUCKET_BYTES, HISTORY = 5, 4 << 20, 8 << 20, 1 << 15
#: What no word can be: the end of a text and the history of its first token.
END, BEGIN = b"", b"\n"
ANSWERS = "kind int, block long, bucket int, blob binary, stats array<long>"
_ANSWER = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


def discounts(n: np.ndarray) -> np.ndarray:
    """d(1) to d(MOST), each below 1, from n[r], how many types have count r (1 to MOST + 1); where the estimate fails, (r - 1/2) / r."""
    d = np.ones(MOST + 1)
    n = np.asarray(n, np.float64)
    tail = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 1.0
    for r in range(1, MOST + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else np.nan
        d[r] = (ratio - tail) / (1 - tail) if tail < 1 else np.nan
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


class Words:
    """The unigram level: N, V, P of each count, and P of the unknown type."""

    def __init__(self, stats: np.ndarray):
        self.total, self.types = int(stats[0]), int(stats[1])
        n = np.append(0, stats[2 : MOST + 3])
        self.d = discounts(n)
        r = np.arange(1, MOST + 1)
        left = float(((1 - self.d[1:]) * r * n[1 : MOST + 1]).sum())
        self.extra = 0 if left > 0 else 1
        self.unknown = (left or 1.0) / (self.total + self.extra)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.where(count <= MOST, count, 0)] * count / max(self.total + self.extra, 1), self.unknown)


def _row(kind: int, block: int | None, bucket: int, blob: bytes | None, stats=None) -> dict:
    return {"kind": kind, "block": block, "bucket": bucket, "blob": blob, "stats": stats}


def _hold(folder: str, n: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in X.blocks(batches, limit):
            buf, offsets = S.joined(table.column("text"))
            buf = S.lower_ascii(buf)
            starts, ends = S.words(buf, offsets)
            distinct, codes = bpe.coded(S.views(buf, starts, ends))
            counts = np.diff(np.searchsorted(starts, offsets))
            train = table.column("train").to_numpy()
            own = np.bincount(codes[np.repeat(train, counts)], minlength=len(distinct))
            # the last two are the end and the begin of a text, in every block
            distinct = pa.concat_arrays([distinct, pa.array([END, BEGIN], pa.binary())])
            own = np.concatenate([own, [train.sum()] * 2])
            goes = (X.hashes(distinct) % np.uint64(n)).astype(np.int64)
            messages = [(b, X.pack(*X.unpack(X.pack_words(distinct.take(pa.array(at)))), X.narrow(own[at]))) for b, at in X.split_buckets(goes)]
            X.put(folder, f"blocks/{block}", {"doc_ids": bpe.doc_ids(table), "train": X.pack(train.astype(np.uint8)), "counts": X.pack(X.narrow(counts)), "codes": X.pack(X.narrow(codes)), "goes": X.pack(X.narrow(goes))})
            yield X.messages(block, messages, True)

    return run


def _count_words(n: int):
    def answer(table: pa.Table) -> pa.Table:
        each = [X.unpack(b) for b in table.column("blob").to_pylist()]
        bucket = table.column("bucket")[0].as_py()
        found = pa.chunked_array([X.binaries(size, data) for size, data, _ in each], pa.binary()).combine_chunks().dictionary_encode()
        at = found.indices.to_numpy()
        count = np.bincount(at, weights=np.concatenate([c for _, _, c in each]), minlength=len(found.dictionary)).astype(np.int64)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        ids = bucket + n * rank  # frequent words have small numbers
        if ids.max() >= (1 << 32) - 1:
            raise ValueError("more than 2**32 - 2 words")
        tokens = count[np.array([w != BEGIN for w in found.dictionary.to_pylist()])]
        stats = [int(tokens.sum()), int((tokens > 0).sum()), *(int((tokens == r).sum()) for r in range(1, MOST + 2))]
        ends = np.cumsum([len(c) for _, _, c in each])
        rows = [_row(0, b, bucket, X.pack(X.narrow(i), X.narrow(c))) for b, i, c in zip(table.column("block").to_pylist(), np.split(ids[at], ends[:-1]), np.split(count[at], ends[:-1]), strict=True)]
        return pa.Table.from_pylist([*rows, _row(3, None, bucket, None, stats)], _ANSWER)

    return answer


class _Block:
    """A block's tokens with global numbers and counts, and its distinct pairs."""

    def __init__(self, folder: str, block: int, n: int, most: int, words: dict[int, bytes] | None = None):
        """most: tokens of a history in a bucket. words: the answers with the words' numbers and counts; without, they are read from the file that they were put to."""
        self.n, self.most = n, most
        row = X.got(folder, f"blocks/{block}")
        self.doc_ids = row["doc_ids"]
        (self.counts,), (train,), (codes,), (goes,) = (X.unpack(row[x]) for x in ("counts", "train", "codes", "goes"))
        self.counts, self.goes, self.train = self.counts.astype(np.int64), goes.astype(np.int64), train.astype(bool)
        goes = self.goes
        self.ids, self.count = np.zeros(len(goes), np.uint64), np.zeros(len(goes), np.int64)
        if words is None:
            self.ids[:], self.count[:] = X.unpack(X.got(folder, f"numbers/{block}")["words"])
        else:
            for b, at in X.split_buckets(goes):
                self.ids[at], self.count[at] = X.unpack(words[b])
            X.put(folder, f"numbers/{block}", {"words": X.pack(X.narrow(self.ids), X.narrow(self.count))})
        # tokens: each document's words and its end; before each, its history
        docs, end, begin = len(self.counts), len(goes) - 2, len(goes) - 1
        self.doc = np.repeat(np.arange(docs), self.counts + 1)
        last = np.cumsum(self.counts + 1) - 1
        self.word = np.full(len(self.doc), end, np.int64)
        keep = np.ones(len(self.doc), bool)
        keep[last] = False
        self.word[keep] = codes
        self.history = np.full(len(self.doc), begin, np.int64)
        inner = np.ones(len(self.doc), bool)
        inner[last - self.counts] = False
        at = np.flatnonzero(inner)
        self.history[at] = self.word[at - 1]
        self.both = np.flatnonzero((self.count[self.word] > 0) & (self.count[self.history] > 0))
        w, h = self.word[self.both], self.history[self.both]
        self.keys, first, self.which = np.unique((self.ids[h] << np.uint64(32)) | self.ids[w], return_index=True, return_inverse=True)
        self.times = np.bincount(self.which, weights=train[self.doc[self.both]], minlength=len(self.keys)).astype(np.int64)
        self.key_word, self.key_history = self.count[w[first]], w[first]
        low, high = self.keys & np.uint64(0xFFFFFFFF), self.keys >> np.uint64(32)
        parts = (1 + self.count[h[first]] // most).astype(np.uint64)  # a common history's pairs in as many buckets as its count asks for
        self.key_goes = ((X.mix(high) + X.mix(low) % parts) % np.uint64(n)).astype(np.int64)

    def pairs(self) -> list[tuple[int, bytes]]:
        out = []
        for b, at in X.split_buckets(self.key_goes):
            high, low = self.keys[at] >> np.uint64(32), self.keys[at] & np.uint64(0xFFFFFFFF)
            out.append((b, X.pack(X.narrow(np.diff(high, prepend=np.uint64(0))), X.narrow(low), X.narrow(self.times[at]), X.narrow(self.key_word[at]))))
        return out

    def with_triples(self, folder: str, block: int, answers: dict[int, bytes] | None = None) -> _Block:
        """The distinct triples of histories seen in training, whose word has number 0 if its pair was not seen.

        answers: the counts of the pairs and whether other blocks hold them; without, they are read from their file.
        """
        self.pair, shared = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), bool)
        if answers is None:
            pair, flag = X.unpack(X.got(folder, f"pairs/{block}")["pairs"])
            self.pair[:], shared[:] = pair, flag
        else:
            for b, at in X.split_buckets(self.key_goes):
                self.pair[at], shared[at] = X.unpack(answers[b])
            X.put(folder, f"pairs/{block}", {"pairs": X.pack(X.narrow(self.pair), shared.astype(np.uint8))})
        at_token = np.full(len(self.word), -1, np.int64)
        at_token[self.both] = self.which
        before = np.append(-1, at_token[:-1])  # an end is in no pair's place before a word
        before[np.append(True, self.doc[1:] != self.doc[:-1])[: len(before)]] = -1
        self.triple_at = np.flatnonzero((before >= 0) & (self.pair[before] > 0)) if len(self.keys) else np.zeros(0, np.int64)
        history, last = before[self.triple_at], at_token[self.triple_at]
        low = np.where(last >= 0, self.pair[last], 0) if len(self.keys) else last
        word = np.where(low > 0, self.ids[self.word[self.triple_at]] + np.uint64(1), np.uint64(0))
        code, first, self.triple = np.unique((history.astype(np.uint64) << np.uint64(32)) | word, return_index=True, return_inverse=True)
        self.t_history, self.t_word, self.t_low = history[first], code & np.uint64(0xFFFFFFFF), low[first]
        self.t_times = np.bincount(self.triple, weights=self.train[self.doc[self.triple_at]], minlength=len(code)).astype(np.int64)
        self.t_own = ~shared[self.t_history]
        parts = (1 + self.pair[self.t_history] // self.most).astype(np.uint64)
        self.t_split = parts > 1
        goes = (X.mix(self.keys[self.t_history]) + X.mix(self.t_word) % parts) % np.uint64(self.n)
        self.t_goes = np.where(self.t_own, -1, goes.astype(np.int64))
        return self

    def triples(self, block: int) -> list[tuple[int, bytes]]:
        """What goes to buckets; and to one below 0, how many own triples have each count."""
        own = [int((self.t_times[self.t_own] == r).sum()) for r in range(1, MOST + 2)]
        out = [(-2 - ((block >> 32) + block) % self.n, X.pack(np.array(own)))]
        for b, at in X.split_buckets(self.t_goes):
            if b >= 0:
                gaps = np.diff(self.keys[self.t_history[at]], prepend=np.uint64(0))
                out.append((b, X.pack(X.narrow(gaps), X.narrow(self.t_word[at]), X.narrow(self.t_times[at]), X.narrow(self.t_low[at]), self.t_split[at].astype(np.uint8))))
        return out


def _count_pairs(n: int, words: Words):
    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, times, known, size = [], [], [], []
        for blob in table.column("blob").to_pylist():
            gaps, low, t, w = X.unpack(blob)
            keys.append((np.cumsum(gaps, dtype=np.uint64) << np.uint64(32)) | low.astype(np.uint64))
            times.append(t)
            known.append(w)
            size.append(len(low))
        all_keys = np.concatenate(keys)
        distinct, first, at = np.unique(all_keys, return_index=True, return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64)
        p = words.p(np.concatenate([x.astype(np.int64) for x in known])[first])
        shared = (np.bincount(at, minlength=len(distinct)) > 1).astype(np.uint8)
        ends = np.cumsum(size)[:-1]
        rows = [_row(0, b, bucket, X.pack(X.narrow(x), y)) for b, x, y in zip(table.column("block").to_pylist(), np.split(count[at], ends), np.split(shared[at], ends), strict=True)]
        seen = np.flatnonzero(count > 0)
        history = distinct[seen] >> np.uint64(32)
        ids, of = np.unique(history, return_inverse=True)
        many = np.stack([np.bincount(of[count[seen] == r], minlength=len(ids)) for r in range(1, MOST + 1)])
        mass = np.bincount(of, weights=p[seen], minlength=len(ids))
        for b, x in X.split_buckets((ids % np.uint64(n)).astype(np.int64)):
            rows.append(_row(1, None, b, X.pack(X.narrow(np.diff(ids[x], prepend=np.uint64(0))), *(X.narrow(m[x]) for m in many), mass[x])))
        return pa.Table.from_pylist([*rows, _row(3, None, bucket, None, [int((count == r).sum()) for r in range(1, MOST + 2)])], _ANSWER)

    return answer


def _weigh(d: np.ndarray):
    """Backoff weights of the words that blocks hold; negative where one count was added to the history's total."""

    def answer(table: pa.Table) -> pa.Table:
        ids, left, mass = [], [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind == 1:
                gaps, *many, p = X.unpack(blob)
                ids.append(np.cumsum(gaps, dtype=np.uint64))
                left.append(sum((1 - d[r]) * r * many[r - 1].astype(np.float64) for r in range(1, MOST + 1)))
                mass.append(p)
        known, at = np.unique(np.concatenate(ids) if ids else np.zeros(0, np.uint64), return_inverse=True)
        left = np.bincount(at, weights=np.concatenate(left), minlength=len(known)) if ids else np.zeros(0)
        mass = np.bincount(at, weights=np.concatenate(mass), minlength=len(known)) if ids else np.zeros(0)
        rows = []
        for kind, block, bucket, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "block", "bucket", "blob")), strict=True):
            if kind == 0:
                own, count = (x.astype(np.int64) for x in X.unpack(blob))
                place = np.minimum(np.searchsorted(known, own.astype(np.uint64)), max(len(known) - 1, 0))
                alpha = np.ones(len(own))
                if len(known):
                    hit = known[place] == own.astype(np.uint64)
                    bare = left[place] <= 0
                    rest = np.where(bare, 1 / (count + 1.0), left[place] / np.maximum(count, 1))
                    alpha = np.where(hit, np.where(bare, -1, 1) * rest / (1 - mass[place]), 1.0)
                rows.append({"block": block, "bucket": bucket, "blob": X.pack(alpha)})
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())]))

    return answer


def _sums(history: np.ndarray, count: np.ndarray, low: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n histories: how many triples have each count up to MOST, and the discounted counts of the pairs that end its seen triples. d: the pairs' discounts."""
    seen = count > 0
    many = np.stack([np.bincount(history[count == r], minlength=n) for r in range(1, MOST + 1)])
    return many, np.bincount(history[seen], weights=(d[np.where(low <= MOST, low, 0)] * low)[seen], minlength=n)


def _count_triples(n: int, d: np.ndarray):
    """Counts for the blocks; sums of a history, and which blocks ask for them, for its bucket: where a triple is unseen, and where all of the history's are here more than MOST times or some are elsewhere."""

    def answer(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), [X.unpack(b) for b in table.column("blob").to_pylist()]
        if bucket < 0:
            return pa.Table.from_pylist([_row(3, None, bucket, None, np.sum([b[0] for b in blobs], axis=0).tolist())], _ANSWER)
        ids, of = np.unique(np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs]), return_inverse=True)
        word, times, low, split = (np.concatenate([b[k] for b in blobs]) for k in range(1, 5))
        distinct, first, at = np.unique((of.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_index=True, return_inverse=True)
        count = np.bincount(at, weights=times, minlength=len(distinct)).astype(np.int64)
        many, mass = _sums(of[first], count, low[first].astype(np.int64), d, len(ids))
        ask = np.zeros(len(ids), bool)
        ask[of[split > 0]] = True
        ask |= many.sum(0) == 0
        wanted = (count[at] == 0) | ask[of]
        needed = ask.copy()
        needed[of[wanted]] = True
        home = (X.mix(ids) % np.uint64(n)).astype(np.int64)
        rows = [_row(3, None, bucket, None, [int((count == r).sum()) for r in range(1, MOST + 2)])]
        held = np.flatnonzero(needed)
        for b, x in X.split_buckets(home[held]):
            x = held[x]
            rows.append(_row(1, None, b, X.pack(X.narrow(np.diff(ids[x], prepend=np.uint64(0))), *(X.narrow(m[x]) for m in many), mass[x])))
        begin = 0
        for block, blob in zip(table.column("block").to_pylist(), blobs, strict=True):
            end = begin + len(blob[0])
            rows.append(_row(0, block, bucket, X.pack(X.narrow(count[at[begin:end]]))))
            asked = np.unique(of[begin:end][wanted[begin:end]])
            for b, x in X.split_buckets(home[asked]):
                rows.append(_row(2, block, b, X.pack(X.narrow(np.diff(ids[asked[x]], prepend=np.uint64(0))))))
            begin = end
        return pa.Table.from_pylist(rows, _ANSWER)

    return answer


def _left(many: list[np.ndarray] | np.ndarray, d: np.ndarray) -> np.ndarray:
    return sum((1 - d[r]) * r * many[r - 1].astype(np.float64) for r in range(1, MOST + 1))


def _weigh_pairs(d: np.ndarray):
    """To each block, of the histories that it asks for: their keys, what discounts leave, and the discounted counts of the pairs. d: the triples' discounts."""

    def answer(table: pa.Table) -> pa.Table:
        keys, left, mass, asks = [], [], [], []
        for kind, block, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "block", "blob")), strict=True):
            gaps, *rest = X.unpack(blob)
            if kind == 1:
                keys.append(np.cumsum(gaps, dtype=np.uint64))
                left.append(_left(rest[:-1], d))
                mass.append(rest[-1])
            else:
                asks.append((block, np.cumsum(gaps, dtype=np.uint64)))
        known, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.uint64), None)
        left, mass = (np.bincount(at, weights=np.concatenate(x), minlength=len(known)) if keys else np.zeros(0) for x in (left, mass))
        bucket, each = table.column("bucket")[0].as_py(), {}
        for block, own in asks:
            each.setdefault(block, []).append(own)
        rows = []
        for block, own in each.items():
            own = np.unique(np.concatenate(own))  # the parts of a history ask for it each
            place = np.searchsorted(known, own)
            rows.append({"block": block, "bucket": bucket, "blob": X.pack(X.narrow(np.diff(own, prepend=np.uint64(0))), left[place], mass[place])})
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())]))

    return answer


def _stats(answers: DataFrame, n: int) -> np.ndarray:
    row = answers.filter("kind = 3").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(n))).first()
    return np.array([int(x or 0) for x in row], np.int64)


def _swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are in tables, as nothing names them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scores(docs: DataFrame, train: Column, history: int = HISTORY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. train: which rows are learned from; history: tokens of a history whose continuations share a bucket."""
    spark = docs.sparkSession
    folder = X.workdir(spark)
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    n = X.deal(spark, X.input_bytes(docs), BUCKET_BYTES)
    sent = X.exchanged(docs, _hold(folder, n, BLOCK_BYTES), folder)
    first = X.saved(X.answered(sent.filter("bucket >= 0"), _count_words(n), ANSWERS), folder, "words")
    words = Words(_stats(first, MOST + 3))
    # tables that nothing reads any more go, as the later ones are large
    names = X.saved(sent.filter("bucket = -1"), folder, "names")
    X.dropped(spark, f"{folder}/messages")
    cells = ["kind", "block", "bucket", "blob"]

    def pairs(number: int, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        yield X.messages(number, _Block(folder, number, n, history, answers).pairs())

    second = X.saved(X.answered(X.by_block(names, first.filter("kind = 0"), n, pairs, X.MESSAGE), _count_pairs(n, words), ANSWERS), folder, "pairs_counted")
    _swept(spark)
    d = discounts(np.append(0, _stats(second, MOST + 1)))

    def triples(number: int, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        yield X.messages(number, _Block(folder, number, n, history).with_triples(folder, number, answers).triples(number))

    third = X.saved(X.answered(X.by_block(names, second.filter("kind = 0"), n, triples, X.MESSAGE), _count_triples(n, d), ANSWERS), folder, "triples")
    sums = X.saved(second.filter("kind = 1"), folder, "sums")
    X.dropped(spark, f"{folder}/pairs_counted")
    _swept(spark)
    d3 = discounts(np.append(0, _stats(third, MOST + 1)))
    asked = first.filter("kind = 0").select(*cells).unionByName(sums.select(*cells))
    word_weights = X.answered(asked, _weigh(d), X.MESSAGE).withColumn("bucket", F.col("bucket") + n)
    pair_weights = X.answered(third.filter("kind in (1, 2)").select(*cells), _weigh_pairs(d3), X.MESSAGE).withColumn("bucket", F.col("bucket") + 2 * n)

    def score(number: int, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        block = _Block(folder, number, n, history).with_triples(folder, number)
        alpha = np.zeros(len(block.ids))
        for b, at in X.split_buckets(block.goes):
            alpha[at] = X.unpack(answers[n + b])[0]
        c, ch = block.count[block.word], block.count[block.history]
        seen = np.zeros(len(c), np.int64)
        seen[block.both] = block.pair[block.which]
        a = np.where(ch > 0, alpha[block.history], 1.0)
        lower = np.abs(a) * words.p(c)
        higher = d[np.where(seen <= MOST, seen, 0)] * seen / np.maximum(ch + (a < 0), 1)
        p = np.where(seen > 0, higher, lower)
        # triples: counts of their own or from the buckets, and the weights of their histories; the others lose nothing to unseen triples here
        count = block.t_times.copy()
        for b, at in X.split_buckets(block.t_goes):
            if b >= 0:
                count[at] = X.unpack(answers[b])[0]
        own = block.t_own
        many, mass = _sums(block.t_history[own], count[own], block.t_low[own], d, len(block.keys))
        left = _left(many, d3)
        weighed = np.zeros(len(block.keys), bool)
        weighed[block.t_history[own]] = True
        for b, blob in answers.items():
            if b >= 2 * n:
                gaps, rest, low = X.unpack(blob)
                at = np.searchsorted(block.keys, np.cumsum(gaps, dtype=np.uint64))
                left[at], mass[at], weighed[at] = rest, low, True
        bare = weighed & (left <= 0)
        whole = np.maximum(block.pair + bare, 1)
        middle = block.count[block.key_history] + (alpha[block.key_history] < 0)  # totals of the pairs' last words as histories
        back = np.where(bare, 1.0, left) / whole / (1 - mass / np.maximum(middle, 1))
        h, t = block.t_history[block.triple], count[block.triple]
        at = block.triple_at
        p[at] = np.where(t > 0, d3[np.where(t <= MOST, t, 0)] * t / whole[h], back[h] * p[at])
        p = np.log10(p)
        base = np.log10((c + 1) / (words.total + words.types + 1))
        heads = np.append(0, np.cumsum(block.counts + 1))[:-1]
        known = np.add.reduceat((c > 0).astype(np.int64), heads)
        yield pa.RecordBatch.from_arrays([bpe.doc_ids_of(block.doc_ids), pa.array(~block.train), pa.array(block.counts + 1), pa.array(known), pa.array(np.full(len(heads), words.total)), pa.array(np.add.reduceat(base, heads)), pa.array(np.add.reduceat(p, heads))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = third.filter("kind = 0").select("block", "bucket", "blob").unionByName(word_weights).unionByName(pair_weights)
    return X.by_block(names, answers, n, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

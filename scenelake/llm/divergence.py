"""How far sources of a language differ in the words they use: smoothed term shares, compared exactly.

Count-min sketches of document frequencies are added up over all documents. A
sketch never underestimates, so a term of which some cell is too small is
certainly rare and is discarded before it is shuffled; survivors are counted
exactly, with their exact document frequency. Pairs of sources meet in a sparse
join of the terms that both hold; what terms of one or of neither add follows
from counts of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import splitting as S

#: Documents of a language that a kept term occurs in, at least; ranks kept of terms; added to each count.
LEAST, RANKS, PRIOR = 30, 50, 5
#: Cells of a row of the sketch, and rows: 6 million cells whatever the input. Where they fill up, less is discarded before the shuffle, and results stay the same.
WIDTH, DEPTH = 1 << 21, 3
#: Rows in a batch from Python.
_ROWS = 20_000
_KEPT = np.zeros(256, bool)
_KEPT[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each occurrence the text's number and the term's, and the distinct terms: runs of letters a-z, A-Z (lower-cased) and of all beyond ASCII."""
    buf, offsets = S.joined(texts)
    inside = _KEPT[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    coded = X.binaries(np.flatnonzero(last) + 1 - starts, _LOWER[buf[inside]]).dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    return doc, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = column.combine_chunks().cast(pa.string()).fill_null("").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _cells(langs: pa.Array, lang: np.ndarray, words: pa.Array, word: np.ndarray, width: int) -> np.ndarray:
    """The cell in each row of the sketch of pairs of language and term."""
    seeds = X.mix(X.hashes(pa.array([b"_" + x.encode() for x in langs.to_pylist()], pa.binary())))  # never empty, as the hash of '' depends on its neighbours
    h = X.hashes(words)[word] ^ seeds[lang]
    return np.stack([(X.mix(h + np.uint64(k)) % np.uint64(width)).astype(np.int64) + k * width for k in range(DEPTH)]) if len(h) else np.zeros((DEPTH, 0), np.int64)


def _pairs(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of text and term, and the number of occurrences."""
    pair, n = np.unique((doc << 32) | word, return_counts=True)
    return pair >> 32, pair & 0xFFFFFFFF, n


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """cell and n of the count-min sketch of document frequencies by language, over all documents; each task sends the sum of its own."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(width * DEPTH, np.int64)
        for _, rows in X.blocks(batches):
            doc, word, words = terms(rows.column("text"))
            lang, langs = _coded(rows.column("lang"))
            doc, word, _ = _pairs(doc, word)
            pair, n = np.unique((lang[doc] << 32) | word, return_counts=True)
            for row in _cells(langs, pair >> 32, words, pair & 0xFFFFFFFF, width):
                table += np.bincount(row, n, len(table)).astype(np.int64) if len(row) > len(table) // 4 else 0
                if len(row) <= len(table) // 4:
                    np.add.at(table, row, n)
        held = np.flatnonzero(table)
        for k in range(0, len(held), _ROWS):
            at = held[k : k + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["cell", "n"])

    rows = docs.select("text", "lang").mapInArrow(X.tidy(added), "cell int, n long")
    return rows.groupBy("cell").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents) of the terms whose cells are all heavy, over all documents."""
    sent, size = docs.sparkSession.sparkContext.broadcast(np.packbits(heavy)), len(heavy)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).view(bool)[:size]
        for _, rows in X.blocks(batches):
            doc, word, words = terms(rows.column("text"))
            (lang, langs), (source, sources) = _coded(rows.column("lang")), _coded(rows.column("source"))
            k = max(len(words), 1)
            seen, at = np.unique(lang[doc] * k + word, return_inverse=True)
            held = bits[_cells(langs, seen // k, words, seen % k, len(bits) // DEPTH)].all(axis=0)[at]
            doc, word, n = _pairs(doc[held], word[held])
            part, at = np.unique((lang[doc] * max(len(sources), 1) + source[doc]) * k + word, return_inverse=True)
            df, n = np.bincount(at, minlength=len(part)), np.bincount(at, n, len(part)).astype(np.int64)
            group, word = part // k, part % k
            for i in range(0, len(part), _ROWS):
                a = slice(i, i + _ROWS)
                lang_at, source_at = (pa.array(x) for x in divmod(group[a], max(len(sources), 1)))
                yield pa.RecordBatch.from_arrays([langs.take(lang_at), sources.take(source_at), words.take(pa.array(word[a])).cast(pa.string()), pa.array(n[a]), pa.array(df[a])], ["lang", "source", "term", "n", "df"])

    rows = docs.select("text", "lang", "source").mapInArrow(X.tidy(counted), "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: str, total: str, v: str) -> str:
    """1 + floor(10^9 (count + PRIOR) / (total + PRIOR v)), in two steps of longs: exact for up to 9 * 10^13 occurrences."""
    a, d = f"({count} + {PRIOR})", f"({total} + {PRIOR} * {v})"
    return f"1 + ({a} * 100000 div {d}) * 10000 + (({a} * 100000 % {d}) * 10000 div {d})"


def divergences(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value and rank: of each pair of sources of a language, and of each source's own terms.

    A term counts in a language if at least `least` of its documents hold it.
    Shares of kept terms are 1 + floor(10^9 (count + 5) / (N + 5 V)). Part
    `pair` sums the distances of shares over all V kept terms; part `term` has
    the terms whose share is above the language's, up to rank `ranks`.

    Null text, lang and source are ''. Empty and null texts have no terms, but
    their group occurs. Repeated rows count as often as they stand. An empty
    table gives no rows. Ties of value go by item. Other columns are not read.

    A language has as many rows of part `pair` as it has ordered pairs of
    sources. The self-join by term makes one row for each unordered pair of
    sources of a term, summed where it arises; no task holds a source's rows.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    folder = X.workdir(spark)
    heavy = np.zeros(width * DEPTH, bool)
    heavy[sketch(docs, width).filter(F.col("n") >= least).select("cell").toArrow().column("cell").to_numpy()] = True  # at most the cells that there are
    of_term = Window.partitionBy("lang", "term")  # a term's sources
    held = counts(docs, heavy).withColumns({"df": F.sum("df").over(of_term), "total": F.sum("n").over(of_term)}).filter(F.col("df") >= least)
    held = X.saved(held.select("lang", "source", "term", "n", "total"), folder, "counts")

    langs = held.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("sum", "v", "all")}
    groups = X.saved(groups.select("lang", "source", *(x.alias(c) for c, x in zero.items())).withColumn("p0", F.expr(f"case when v = 0 then 0 else {_share('0', 'sum', 'v')} end")), folder, "groups")

    shares = held.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "sum", "v"))).select("lang", "source", "term", "n", "total", "v", "all", "p", "p0")
    out = _pair_part(shares, groups).unionByName(_term_part(shares, ranks))
    return X.saved(out, folder, "result")


def _pair_part(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over all kept terms of |p - q| of ordered pairs of sources.

    As if no term of both were there, a term of one alone adds |p - q0|, and
    one of neither |p0 - q0|; terms of both are put right by the join.
    """
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    fix = F.expr("abs(pa - pb) - abs(pa - b0) - abs(a0 - pb) + abs(a0 - b0)")
    both = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(fix).alias("x"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))  # terms of equal share
    alone = alike.join(other, "lang").filter("source <> b").groupBy("lang", F.col("source").alias("a"), "b").agg(F.sum(F.expr("times * (abs(p - b0) - abs(p0 - b0))")).alias("x"))
    none = groups.select("lang", F.col("source").alias("a"), "v", F.col("p0").alias("a0")).join(other, "lang").filter("a <> b").select("lang", "a", "b", F.expr("v * abs(a0 - b0)").alias("x"))

    def turned(x: DataFrame) -> DataFrame:
        return x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "x")

    parts = both.unionByName(turned(both)).unionByName(alone).unionByName(turned(alone)).unionByName(none)
    total = parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("x").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _term_part(shares: DataFrame, ranks: int) -> DataFrame:
    q = _share("total", "`all`", "v")
    above = shares.withColumn("value", F.expr(f"p - ({q})")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    got = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return got.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

"""Connected components of a graph in tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b); each round is written to the folder.

    A round joins each node's smallest neighbour back to its edges. Minima are
    aggregated before rows move; the edges of a node with very many neighbours
    stay where they are and meet its minimum by a broadcast of bounded size
    (spread_join), so no task holds the neighbours of one node.
    """
    spark = edges.sparkSession
    now = X.saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "edges-0")
    for k in range(1, 60):
        if _settled(now):
            break
        n = 2 * now.count()
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w"))
        large = X.spread_join(both, least, "u", "w", n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = X.saved(large.distinct(), folder, f"large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        small = X.spread_join(large, least, "u", "w", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = X.saved(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), folder, f"edges-{k}")
        X.dropped(spark, f"{folder}/edges-{k - 1}", f"{folder}/large-{k}")
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root, or has one edge, to a root."""
    above = edges.groupBy("u").agg(F.count("*").alias("w"))
    roots = edges.select(F.col("v").alias("u")).distinct()
    return above.filter("w > 1").isEmpty() and roots.join(above, "u", "left_semi").isEmpty()

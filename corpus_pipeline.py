"""A corpus pipeline: quality, near copies, repeats, contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with their columns, whatever their names; the last returns tokens. Null and empty
texts, repeated rows, null doc_ids and empty tables go through every stage as its
operator says. run() writes what a stage returns
to the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import bpe, classifier, decontaminate, exchange, near_duplicates, repeats
from scenelake.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; it learns from the rows that op1 learns from."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    column = "quality_score"
    while column in docs.columns:  # a name of none of the documents' columns
        column += "_"
    return classifier.scored(docs, classifier.fit(docs, labels), column).filter(F.col(column) >= 0.5).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    ship(spark)
    return near_duplicates.without_near_copies(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without 50-byte strings of earlier ones."""
    ship(spark)
    return repeats.without_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontaminate.without_overlaps(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    ship(spark)
    got = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    return got.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality classifier", quality),
    ("near copies", near_copies),
    ("repeated strings", repeated_strings),
    ("benchmark decontamination", contamination),
    ("BPE", tokens),
]

#: No SQL for the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = exchange.workdir(spark)
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/stage-{k}")
    return docs

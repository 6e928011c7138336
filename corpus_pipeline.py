"""A corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of documents. ``run`` writes each stage's result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import bpe, exact_dedup, mixing, quality, simhash
from tapeworks.llm.util import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text")  # no column of docs can clash with what is added
    return quality.classify(rows, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc.*")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.dedup(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the row with the smallest doc_id."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    return bpe.digests(docs)


STAGES = [("quality", keep_good), ("exact_dedup", keep_one_copy), ("simhash_dedup", keep_one_of_near), ("mixing", mix_sources), ("bpe", encode)]
#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

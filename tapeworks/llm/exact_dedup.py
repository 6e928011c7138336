"""Exact dedup with a heavy-hitter split.

Texts are compared by the SHA-256 of their normalised form (A-Z lower-cased, null as empty). Misra-Gries summaries, one
per partition and merged by addition, find every digest that holds more than one row in ``HEAVY``; those candidates are
counted exactly, and their winners, at most ``2 * HEAVY`` rows, are broadcast so that hot groups are settled on the map
side. All other digests, each under 1/HEAVY of the rows, go through an ordinary shuffle.

Defined results: a null or empty text is one text like any other; a null doc_id is smaller than any other; of rows that
share both text and doc_id exactly one stays; an empty table gives an empty result; other columns are carried along
(``dedup``) or ignored (``groups``).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.util import ascii_lower, stored, table

#: Digests with more than one row in HEAVY are settled on the map side.
HEAVY = 512


def digest(text):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def shrink(counts: Counter, k: int) -> Counter:
    """The Misra-Gries reduction to k counters: what the (k+1)-th holds is taken from all."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({key: n - cut for key, n in counts.items() if n > cut})


def summaries(k: int):
    """A function for mapInArrow: a summary of at most k digests for each partition."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = shrink(counts, k)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "est"])

    return run


def heavy(digests: DataFrame, rank, heavy_share: int = HEAVY) -> DataFrame:
    """Digest, count and largest ``rank`` of every digest with over one row in heavy_share; at most 2 * heavy_share rows.

    A summary of k = 2 * heavy_share counters loses at most rows/k of a digest's count, so each such digest keeps an
    estimate of at least rows/k, and no more than k digests can.
    """
    rows = digests.count()
    k = 2 * heavy_share
    found = digests.select("digest").mapInArrow(summaries(k), "digest binary, est long")
    found = found.groupBy("digest").agg(F.sum("est").alias("est")).where(F.col("est") > rows / (k + 1) - 1e-9).select("digest")
    exact = digests.join(F.broadcast(stored(found, "heavy")), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max(rank).alias("top"))
    return stored(exact.where("n > 1"), "winners")


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(docs.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    rank = F.struct(F.col("doc_id"), F.col("row"))
    hot = heavy(rows, rank)
    window = Window.partitionBy("digest")
    light = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select("doc_id", "digest", "row", F.count("*").over(window).alias("n"), F.max(rank).over(window).alias("top"))
    settled = rows.join(F.broadcast(hot), "digest").select("doc_id", "digest", "row", "n", "top")
    return light.unionByName(settled).select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows of hot digests that lose to their broadcast winner go on the map side, before anything is shuffled.
    """
    mine, hit, place = "__digest", "__top", "__place"
    marked = docs.withColumn(mine, digest(F.col("text")))
    hot = heavy(stored(marked.select("doc_id", F.col(mine).alias("digest")), "digests"), F.col("doc_id"))
    hot = hot.select(F.col("digest").alias(mine), F.struct("top").alias(hit))
    left = marked.join(F.broadcast(hot), mine, "left").where(F.col(hit).isNull() | F.col(f"{hit}.top").eqNullSafe(F.col("doc_id")))
    order = Window.partitionBy(mine).orderBy(F.col("doc_id").desc_nulls_last())
    return left.withColumn(place, F.row_number().over(order)).where(f"{place} = 1").select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE_SQL = {
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """
}

"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size, three at most. Whole copies are
sure; the fractions are rounded together. Two documents at a time pass mass between them until one holds 0 or 1 copy; the
amount is measured in words, so that the words a source gives stay what they were, and the direction is drawn so that
each document's expected copies stay what they were. Leaves of ``LEAF`` documents at most are rounded apart, largest
document first, and leave one fraction each; a reduction tree of ``FAN`` leaves a node combines these down to one for
each source, whose rounding is the only error: less than one document.

Leaves, order and draws follow from hashes of doc_id and text length, so reruns agree whatever the partitioning.

Defined results: null and empty texts have size 0 and give no copy; a null source is a source of its own, last in order; a
source without words has target 0; repeated rows are rows of their own; an empty table gives an empty result; other
columns are ignored (``plan``) or kept (``mix``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.util import stored, table

WEIGHTS, MOST = (1, 2, 3), 3.0
LEAF, FAN, SEED = 2_000, 64, 20240229
#: Documents of a group, largest first, that are made whole before the others.
LARGE = 64
#: Source tables of at most so many rows are broadcast.
FEW_SOURCES = 2_000
EDGE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, from a row (source, source_size) for each source.

    Targets are min(MOST * size, level * weight) with the level at which they sum to all words: what resharing the excess
    by weight comes to. Sorted by size / weight, sources before the level are full and those after it share the rest, so
    one running sum finds it. There is a row for each source here, however many documents there are.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("full", MOST * F.col("source_size"))
    by_level = Window.orderBy(F.col("full") / F.col("w"), "source")
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    fits = F.when(F.col("level") * F.col("w") <= F.col("full"), F.col("level"))
    everywhere = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = weighed.withColumn("level", level).withColumn("level", F.first(fits, ignorenulls=True).over(everywhere))
    kept = [c for c in sizes.columns if c not in ("source", "source_size")]
    return ranked.select("source", "source_size", *kept, F.least("full", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def settle_large(copies: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Makes the first ``LARGE`` fractions whole against those after them.

    Beside small partners a large document would take many random steps to become whole, and may be left over. So its
    outcome is drawn at once, and each partner in turn passes the words it can in that direction, in the proportion that
    keeps its own expected copies.
    """
    out, size = copies.copy(), size.astype(np.float64)
    for i in np.flatnonzero((copies > EDGE) & (copies < 1 - EDGE))[:LARGE]:
        have, partners = out[i], i + 1 + np.flatnonzero((out[i + 1 :] > EDGE) & (out[i + 1 :] < 1 - EDGE))
        if not EDGE < have < 1 - EDGE:
            out[i] = round(have)
            continue
        can = np.minimum(out[partners] * size[partners] / (1 - have), (1 - out[partners]) * size[partners] / have)
        part = np.clip(size[i] - (np.cumsum(can) - can), 0, can)
        up = draw[i] < have
        out[partners] += (-(1 - have) if up else have) * part / size[partners]
        done = min(1.0, part.sum() / size[i])
        out[i] = have + done * ((1 - have) if up else -have)
    whole = (out < EDGE) | (out > 1 - EDGE)
    out[whole] = np.round(out[whole])
    return out


def settle(copies: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds the fractions of one group in the given order; gives the copies and the place of the one left, or -1."""
    out, left, have, words = copies.copy(), -1, 0.0, 1.0
    for i in np.flatnonzero((copies > EDGE) & (copies < 1 - EDGE)).tolist():
        if left < 0:
            left, have, words = i, float(out[i]), float(size[i])
            continue
        other, more = float(out[i]), float(size[i])
        # words that can pass from i to the one left, and back
        to, back = min((1 - have) * words, other * more), min(have * words, (1 - other) * more)
        moved = to if draw[i] * (to + back) < back else -back
        have, other = have + moved / words, other - moved / more
        if have < EDGE or have > 1 - EDGE:
            out[left] = round(have)
            left, have, words = i, other, more
            if other < EDGE or other > 1 - EDGE:
                out[i], left = round(other), -1
        else:
            out[i] = round(other)
    if left >= 0:
        out[left] = have
    return out, left


def round_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
    size, draw = rows["size"].to_numpy(), rows["draw"].to_numpy()
    rows["copies"], _ = settle(settle_large(rows["copies"].to_numpy(), size, draw), size, 1 - draw)
    return rows


def uniform(*columns):
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def plan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", text).alias("key"))
    # rows that are alike in all are told apart by a number, so that they spread over leaves like others
    nth = F.row_number().over(Window.partitionBy("key", "source").orderBy("size"))
    sized = sized.withColumn("nth", nth).withColumn("tie", F.when(F.col("nth") == 1, F.col("key")).otherwise(F.xxhash64("key", "nth")))
    sized = stored(sized, "sizes")
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))), "targets")
    n_sources, most = sources.agg(F.count("*"), F.max("n_docs")).first()
    leaves = max(1, -(-(most or 0) // LEAF))  # of the largest source
    named = sources.withColumnRenamed("source", "of")
    joined = sized.join(F.broadcast(named) if n_sources <= FEW_SOURCES else named, F.col("source").eqNullSafe(F.col("of")))
    share = F.when(F.col("size") > 0, F.least(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(MOST))).otherwise(0.0)
    joined = joined.withColumn("share", share).withColumn("base", F.floor(F.col("share") + EDGE)).withColumn("copies", F.greatest(F.col("share") - F.col("base"), F.lit(0.0)))
    leaf = F.pmod(F.xxhash64(F.lit(SEED), "tie"), F.ceil(F.col("n_docs") / LEAF)).cast("int")
    state = joined.select("doc_id", "size", "source_size", "target", "key", "nth", "tie", F.xxhash64("of", F.col("of").isNull()).alias("group"), "base", "copies", leaf.alias("leaf"), uniform(F.lit(SEED), "tie", F.lit(0)).alias("draw"))
    done, level = [], 0
    while True:
        state = stored(state.groupBy("group", "leaf").applyInPandas(round_group, state.schema), "rounded")
        open_ = (F.col("copies") > EDGE) & (F.col("copies") < 1 - EDGE)
        done.append(state.where(~open_))
        if leaves == 1:
            break
        leaves, level = -(-leaves // FAN), level + 1
        state = state.where(open_).withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("int")).withColumn("draw", uniform(F.lit(SEED), "tie", F.lit(level)))
    last = state.where(open_).withColumn("copies", (uniform(F.lit(SEED), "tie", F.lit(-1)) < F.col("copies")).cast("double"))
    done.append(last)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    copies = (F.col("base") + F.round("copies")).cast("long")
    return whole.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key", "group", "nth")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it."""
    key, group = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.xxhash64("source", F.col("source").isNull())
    taken = plan(docs).where("copies > 0").select("key", "group", "nth", "copies")
    # all of docs is one column here, so that no name of it can clash; rows of one key, source and number are alike but for other columns
    named = docs.select(F.struct("*").alias("doc"), key.alias("key"), group.alias("group"))
    marked = named.withColumn("nth", F.row_number().over(Window.partitionBy("key", "group").orderBy(F.lit(1))))
    return marked.join(taken, ["key", "group", "nth"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL: dict = {}

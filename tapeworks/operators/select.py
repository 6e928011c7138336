"""Exact order statistics by distributed selection: a range of values is narrowed by counts until it holds one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.sources.files import forget, kept

#: Parts into which a range is cut in each round.
PARTS = 1024


def order_statistics(rows: DataFrame, column: str, ranks: list, *keys: str, parts: int = PARTS) -> DataFrame:
    """keys, i, value: for each group the values at the given ranks, i the place in ``ranks``.

    ranks: columns of ``n``, the group's count of values, from 0. Null and nan values aren't counted. Each round counts the values
    in ``parts`` parts of the range that still holds a rank, by partial sums; the part with the rank, from its least value to its
    largest, is the next range. A round's result is a row for each group and rank, and at most ``parts`` rows for one are ever
    put in order. Ranges shrink ``parts``-fold at least, so some six rounds do for any doubles.
    """
    values = kept(rows.select(*keys, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")), "values")
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = kept(whole.select(*keys, F.posexplode(F.array(*ranks)).alias("i", "rank"), "lo", "hi").withColumn("rank", F.col("rank").cast("long")), "ranks")
    keyed = [F.col(f"s.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    # halves, so that the width of a range can't overflow; where one end is infinite the quotient says nothing
    at = F.floor(F.coalesce(F.nanvl(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0)), F.lit(0.0)) * parts)
    part = F.when(x == lo, 0).when(x == hi, parts - 1).otherwise(F.least(F.greatest(at, F.lit(1)), F.lit(parts - 2))).cast("int")
    while not state.where("lo < hi").isEmpty():
        open_, before = state.where("lo < hi"), state
        met = values.alias("v").join(open_.alias("s"), [*keyed, F.col("v.x").between(F.col("s.lo"), F.col("s.hi"))]).select(*(F.col(f"s.{k}").alias(k) for k in keys), "i", "rank", "lo", "hi", "x")
        counts = met.select(*keys, "i", "rank", part.alias("part"), "x").groupBy(*keys, "i", "rank", "part").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        state = kept(state.where("lo = hi").unionByName(found.select(*keys, "i", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi")), "ranks")
        forget(before)
    forget(values)
    return state.select(*keys, "i", F.col("lo").alias("value"))


def median(rows: DataFrame, column: str, *keys: str, name: str = "median", parts: int = PARTS) -> DataFrame:
    """keys and the exact median of a column: the middle value, or the mean of the middle two."""
    n = F.col("n")
    found = order_statistics(rows, column, [F.floor((n - 1) / 2), F.floor(n / 2)], *keys, parts=parts)
    return found.groupBy(*keys).agg((F.sum(F.col("value") / 2)).alias(name))

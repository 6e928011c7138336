"""Exponential averages and lags over a dense tape, exact and in parallel.

An average y[t] = a x[t] + b y[t-1] is a scan. Within a short block it has a closed form, one windowed sum; what a block
hands to the next is a number for each average, so the fold over blocks touches one row a block. Lags look back at most one
long block: each row is also shown to the block after its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import decay
from tapeworks.operators.grid import SPAN

#: Bars in a short block. 2^(SHORT / half-life) must stay in double range, so half-lives are 4 bars at least.
SHORT = 3_600


@dataclass(frozen=True)
class Average:
    """name: result column; of: the column averaged; first: the value before the first bar, or None for the first x."""

    name: str
    of: str
    halflife: float
    first: float | None = 0.0


def running(x: np.ndarray, halflife: float, start: float) -> np.ndarray:
    """The average after each of an array's values, from the one before the first; the closed form by rows of SHORT values."""
    n, b = len(x), decay(halflife)
    rows = -(-n // SHORT) if n > SHORT else 1
    wide = min(n, SHORT)
    whole = x if rows * wide == n else np.append(x, np.zeros(rows * wide - n))
    fade = b ** np.arange(1, wide + 1)
    out = np.cumsum(whole.reshape(rows, wide) * ((1 - b) / fade), axis=1) * fade
    carried = start
    for row in out:
        row += fade * carried
        carried = row[-1]
    return out.ravel()[:n]


def averages(tape: DataFrame, specs: list[Average]) -> DataFrame:
    """tape (symbol, big, t, ...) with a column for each average. All share one sort and one fold."""
    so_far = Window.partitionBy("symbol", "big", "blk").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tape.withColumn("blk", F.floor(F.col("t") / SHORT)).withColumn("j", F.col("t") - F.col("blk") * SHORT)

    def part(s: Average) -> Column:
        b = decay(s.halflife)
        return F.sum(F.col(s.of) * (1 - b) * F.pow(F.lit(b), -F.col("j")))

    # what a block hands on is a plain sum over its rows: no order, and partial sums before the exchange
    ends = placed.groupBy("symbol", "blk").agg(
        F.count("*").alias("n"), F.min("j").alias("j0"), *((part(s) * F.pow(F.lit(decay(s.halflife)), F.max("j"))).alias(s.name) for s in specs), *(F.min_by(s.of, "t").cast("double").alias(f"first_{s.name}") for s in specs if s.first is None)
    )
    local_sums = placed.select("*", *((part(s).over(so_far) * F.pow(F.lit(decay(s.halflife)), F.col("j"))).alias(f"__{s.name}") for s in specs))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("blk")
        carried, out = np.array([rows[f"first_{s.name}"].iloc[0] if s.first is None else s.first for s in specs]), []
        rest = np.array([decay(s.halflife) for s in specs])
        for n, end in zip(rows["n"].to_numpy(), rows[[s.name for s in specs]].to_numpy(float)):
            out.append(carried)
            carried = end + rest**n * carried
        return pd.DataFrame(np.array(out), columns=[s.name for s in specs]).assign(symbol=rows["symbol"].to_numpy(), blk=rows["blk"].to_numpy(), j0=rows["j0"].to_numpy())

    carries = ends.groupBy("symbol").applyInPandas(fold, ", ".join([*(f"`{s.name}` double" for s in specs), "symbol string", "blk long", "j0 long"]))
    carries = carries.select("symbol", "blk", "j0", *(F.col(s.name).alias(f"c_{s.name}") for s in specs))
    joined = local_sums.join(carries, ["symbol", "blk"])
    done = [(F.col(f"__{s.name}") + F.col(f"c_{s.name}") * F.pow(F.lit(decay(s.halflife)), F.col("j") - F.col("j0") + 1)).alias(s.name) for s in specs]
    return joined.select(*tape.columns, *done)


def lags(tape: DataFrame, column: str, ks: list[int], name: str = "lag_{k}") -> DataFrame:
    """tape with the column k bars ago for each k up to SPAN; before the tape began, the first value.

    Where a lag is null, the block shown begins at the tape's first bar, so the first value there is the tape's.
    """
    if max(ks) > SPAN:
        raise ValueError(f"lags look back {SPAN} bars at most")
    shown = tape.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("at", F.when(F.col("home"), F.col("big")).otherwise(F.col("big") + 1))
    order = Window.partitionBy("symbol", "at").orderBy("t")
    back = [F.coalesce(F.lag(column, k).over(order), F.first(column).over(order)).alias(name.format(k=k)) for k in ks]
    return shown.select(*tape.columns, "home", *back).where("home").drop("home")


#: Rows in a block of numbered rows.
ROWS = 65_536


def numbered(rows: DataFrame, *keys: str, order: str = "t") -> DataFrame:
    """rows with ``n``, their number from 0 in the order of a whole number that is theirs alone within its keys.

    Counted block by block of ``SPAN`` units of the order: a block's rows are numbered in its task, and what came before it is
    a running count over a row a block.
    """
    placed = rows.withColumn("__blk", F.floor(F.col(order) / SPAN))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    counts = placed.groupBy(*keys, "__blk").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__blk").orderBy(order)) - 1
    return placed.withColumn("__in", inside).join(counts, [*keys, "__blk"]).withColumn("n", (F.col("__before") + F.col("__in")).cast("long")).drop("__blk", "__before", "__in")


def looking_back(rows: DataFrame, reach: int, made: dict, *keys: str) -> DataFrame:
    """Numbered rows with a column for each of ``made``: name to a function of a window over the keys.

    The functions may look ``reach`` rows back. The window holds a block of ``ROWS`` rows (or ``reach``, if that is more) and the last
    ``reach`` of the block before, never all rows of a key.
    """
    size = max(ROWS, reach)
    block = F.floor(F.col("n") / size)
    shown = rows.withColumn("__at", F.explode(F.when(F.col("n") - block * size >= size - reach, F.array(block, block + 1)).otherwise(F.array(block))))
    order = Window.partitionBy(*keys, "__at").orderBy("n")
    found = shown.select("*", *(f(order).alias(name) for name, f in made.items()))
    return found.where(F.col("__at") == block).drop("__at")


def trailing_mean(column: str, width: int):
    """For ``looking_back`` by width - 1: the mean of the last ``width`` rows, or of as many as there are."""
    return lambda order: F.avg(column).over(order.rowsBetween(-(width - 1), 0))


def so_far(rows: DataFrame, sums: dict, *keys: str) -> DataFrame:
    """Numbered rows with, for each name in ``sums``, the running sum of a column: sums in blocks of ``ROWS``, and a row a block."""
    placed = rows.withColumn("__blk", F.floor(F.col("n") / ROWS))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*keys, "__blk").agg(*(F.sum(of).alias(name) for name, of in sums.items()))
    ends = ends.select(*keys, "__blk", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__{name}") for name in sums))
    inside = Window.partitionBy(*keys, "__blk").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.select("*", *(F.sum(of).over(inside).alias(name) for name, of in sums.items())).join(ends, [*keys, "__blk"])
    return found.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).drop("__blk", *(f"__{name}" for name in sums))

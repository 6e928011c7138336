"""Context behind a cursor, settlement ahead of it, normalised windows and pooled levels.

A cursor is (symbol, t); cursors may repeat and carry an ``id``, unique within their symbol. Cursors meet the tape block by block
(``around``), and what they see of it is an array; the long forms here lay such arrays out a row a bar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import at_least, clipped
from tapeworks.operators.around import slices

CHANNELS = ("hi_off", "lo_off", "lv", "lntr", "imb", "valid")


def context(cursors: DataFrame, logs: DataFrame, length: int) -> DataFrame:
    """The last ``length`` rows up to each cursor, with log prices relative to the cursor's. Long form: pos from 1."""
    wide = slices(cursors.select("symbol", "t", "id"), logs.withColumn("valid", F.col("valid").cast("int")), 1 - length, 0, ["logp", *CHANNELS])
    here = F.element_at("logp", -1)
    zipped = F.arrays_zip("logp", *CHANNELS)
    rows = wide.select("id", "symbol", "t", here.alias("here"), F.posexplode(zipped).alias("at", "x"))
    flags = [F.col(f"x.{c}").cast("boolean").alias(c) if c == "valid" else F.col(f"x.{c}").alias(c) for c in CHANNELS]
    return rows.select("id", "symbol", "t", *flags, (F.col("x.logp") - F.col("here")).alias("rel"), (F.col("at") + 1).cast("long").alias("pos"))


def normalised(window: DataFrame, length: int, sig: Column) -> DataFrame:
    """Eight bounded channels of a context in long form: path, ret, hi, lo, act, ntr, imb, valid."""
    s = at_least(sig, 1e-8)
    order, whole = Window.partitionBy("symbol", "id").orderBy("pos"), Window.partitionBy("symbol", "id")
    step = F.col("rel") - F.lag("rel").over(order)
    channels = {
        "path": F.col("rel") / (s * math.sqrt(length)), "ret": F.coalesce(step, F.lit(0.0)) / s, "hi": F.col("hi_off") / s, "lo": F.col("lo_off") / s,
        "act": F.col("lv") - F.avg("lv").over(whole), "ntr": F.col("lntr") - F.avg("lntr").over(whole), "imb": F.col("imb"), "valid": F.col("valid").cast("double"),
    }
    return window.select("id", "symbol", "t", "pos", *(clipped(x, 10.0).alias(k) for k, x in channels.items()))


def pooled(window: DataFrame, length: int, span: int, stride: int, columns: list[str]) -> DataFrame:
    """Means of the groups of ``stride`` rows in the last ``span``; what is left over at the newest end is dropped."""
    span = min(span, length)
    at = F.col("pos") - (length - span) - 1
    group = F.floor(at / stride)
    rows = window.where((at >= 0) & (group < span // stride)).withColumn("step", group)
    return rows.groupBy("id", "symbol", "t", "step").agg(*(F.avg(c).alias(c) for c in columns))


def futures(cursors: DataFrame, logs: DataFrame, horizon: int) -> DataFrame:
    """The cursors with ``truth``, an array: log returns from each to the next ``horizon`` bars, where all of them are known."""
    wide = slices(cursors, logs, 0, horizon, ["logp"])
    return wide.withColumn("truth", F.transform(F.slice("logp", 2, horizon), lambda x: x - F.element_at("logp", 1))).drop("logp")


def settled(cursors: DataFrame, logs: DataFrame, horizon: int) -> DataFrame:
    """id, symbol, t, h, truth: ``futures`` in long form."""
    wide = futures(cursors.select("symbol", "t", "id"), logs, horizon)
    return wide.select("id", "symbol", "t", F.posexplode("truth").alias("h", "truth")).withColumn("h", (F.col("h") + 1).cast("long"))


def replay_times(tape: DataFrame, length: int, horizon: int, stride: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """symbol, t, id: every ``stride`` bars from the first with full context to the last with a full future."""
    ends = tape.groupBy("symbol").agg((F.min("t") + length + 1).alias("lo"), (F.max("t") - horizon + 1).alias("hi"))
    lo = F.greatest("lo", F.lit(start)) if start is not None else F.col("lo")
    hi = F.least("hi", F.lit(stop)) if stop is not None else F.col("hi")
    bounded = ends.select("symbol", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    return bounded.select("symbol", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(stride).cast("long"))).alias("t")).withColumn("id", F.col("t"))


def batch_cursors(lo: Column, hi: Column, batch: int, jitter: Column, i: Column) -> Column:
    """Where cursor i of ``batch`` begins: spread evenly over [lo, hi], moved by the given jitter, held within."""
    step = F.floor((hi - lo) / batch)
    return F.greatest(F.least(lo + i * step + F.pmod(jitter, F.greatest(step, F.lit(1))), hi), lo)


def advanced(t: Column, stride: int, lo: Column, hi: Column, redraw: Column) -> Column:
    """The next place of a cursor; beyond hi it is drawn again from [lo, hi - 1)."""
    return F.when(t + stride > hi, lo + F.pmod(redraw, F.greatest(hi - lo - 1, F.lit(1)))).otherwise(t + stride)

"""Ticks to bars, bars to a dense grid, and the integer codec of a tape.

Everything is keyed by (symbol, t), t a bar number. A symbol's tape is cut into blocks of ``SPAN`` bars; all ordered work is
done within blocks, and what must cross their borders is one row a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import EPS, at_least, cents

#: Bars in a block.
SPAN = 172_800
VOLUME_SCALE, TAKER_SCALE = 1e5, 65_535.0
PRICES = ("open", "high", "low", "close")


def seconds(ts):
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def epoch_seconds(stamp):
    """A stamp in s, ms, us or ns, told apart by its size, as seconds."""
    scale = F.when(stamp > F.lit(10**17), 10**9).when(stamp > F.lit(10**14), 10**6).when(stamp > F.lit(10**11), 1000).otherwise(1)
    return ((stamp - F.pmod(stamp, scale)) / scale).cast("long")


def bars(ticks: DataFrame) -> DataFrame:
    """symbol, t, open, high, low, close, vol, qvol, ntrades, takerfrac from ticks (symbol, t, at, price, size, taker).

    ``at`` orders the ticks of a bar. Prices are quantised to hundredths, sizes to 1e-5, traded value to units, and the
    taker's share to 1/65535. One aggregation with partial sums on the map side.
    """
    grouped = ticks.groupBy("symbol", "t").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("size").alias("vol"), F.sum(F.col("size") * F.col("price")).alias("qvol"), F.count("*").alias("ntrades"), F.sum("taker").alias("tb"),
    )
    share = F.when(F.col("vol") > 0, F.least(at_least(F.col("tb") / at_least(F.col("vol"), EPS), 0.0), F.lit(1.0))).otherwise(0.0)
    return grouped.select(
        "symbol", "t", *((F.rint(F.col(c) * 100) / 100).alias(c) for c in PRICES),
        (F.rint(F.col("vol") * VOLUME_SCALE) / VOLUME_SCALE).alias("vol"), F.rint("qvol").alias("qvol"), "ntrades", (F.rint(share * TAKER_SCALE) / TAKER_SCALE).alias("takerfrac"),
    )


def last_wins(rows: DataFrame, *order: str) -> DataFrame:
    """One row for each (symbol, t): the last by the given order."""
    rest = [c for c in rows.columns if c not in ("symbol", "t")]
    return rows.groupBy("symbol", "t").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("symbol", "t", "r.*")


def densify(found: DataFrame, common: bool = False) -> DataFrame:
    """Every t between a symbol's first and last, with nulls where there is no bar, and the block number ``big``.

    With ``common`` all symbols get the span of the whole table.

    The skeleton is made block by block, never as one array for a tape. Skeleton and bars meet in one exchange by block, on
    which every later block-wise step can build.
    """
    ends = found.groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    if common:
        whole = Window.partitionBy()  # a row for each symbol
        ends = ends.select("symbol", F.min("a").over(whole).alias("a"), F.max("b").over(whole).alias("b"))
    blocks = ends.select("symbol", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / SPAN), F.floor(F.col("b") / SPAN))).alias("big"))
    times = F.sequence(F.greatest("a", F.col("big") * SPAN), F.least("b", (F.col("big") + 1) * SPAN - 1))
    skeleton = blocks.repartition("symbol", "big").select("symbol", "big", F.explode(times).alias("t"))
    rest = [c for c in found.columns if c not in ("symbol", "t")]
    both = found.withColumn("big", F.floor(F.col("t") / SPAN)).unionByName(skeleton, allowMissingColumns=True)
    met = both.repartition("symbol", "big").groupBy("symbol", "big", "t").agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest))
    return met.withColumn("valid", F.col("close").isNotNull())


def filled(grid: DataFrame) -> DataFrame:
    """Flat candles at the last known close where there is no bar; before the first bar, at the first close."""
    inside = Window.partitionBy("symbol", "big").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = grid.withColumn("near", F.last("close", ignorenulls=True).over(inside))
    ends = grid.groupBy("symbol", "big").agg(F.max_by("close", F.when(F.col("valid"), F.col("t"))).alias("end"), F.min_by("close", F.when(F.col("valid"), F.col("t"))).alias("start"))
    earlier = Window.partitionBy("symbol").orderBy("big").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    whole = Window.partitionBy("symbol").orderBy("big").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("symbol", "big", F.coalesce(F.last("end", ignorenulls=True).over(earlier), F.first("start", ignorenulls=True).over(whole)).alias("carried"))
    close = F.coalesce("near", "carried")
    flat = {c: F.coalesce(c, close) for c in PRICES} | {c: F.coalesce(c, F.lit(0.0)) for c in ("vol", "qvol", "takerfrac")} | {"ntrades": F.coalesce("ntrades", F.lit(0))}
    return known.join(ends, ["symbol", "big"]).select("symbol", "big", "t", *(x.alias(c) for c, x in flat.items()), "valid")


def gaps(grid: DataFrame, width: int) -> DataFrame:
    """Bars, genuine bars and the share of gaps for each symbol and stretch of ``width`` bars."""
    n = F.count("*")
    return grid.groupBy("symbol", F.floor(F.col("t") / width).alias("stretch")).agg(n.alias("n"), F.count_if("valid").alias("n_valid"), F.round(100 * (n - F.count_if("valid")) / n, 4).alias("gap_pct"))


def breaks(shards: DataFrame) -> DataFrame:
    """Shards (symbol, t0, n) that the next shard doesn't continue."""
    after = F.lead("t0").over(Window.partitionBy("symbol").orderBy("t0"))
    return shards.withColumn("next_t0", after).where(F.col("next_t0") != F.col("t0") + F.col("n"))


def encoded(tape: DataFrame) -> DataFrame:
    """The integer form: close as differences within a block, other prices as offsets from close, quantised sizes.

    The first difference of a block is the close itself, so that blocks decode alone.
    """
    order = Window.partitionBy("symbol", "big").orderBy("t")
    c = cents(F.col("close"))
    whole = tape.withColumn("c", F.when(F.abs(c) <= 2**31 - 1, c).otherwise(F.raise_error(F.lit("price beyond 32 bits")).cast("long")))
    return whole.select(
        "symbol", "big", "t", (F.col("c") - F.coalesce(F.lag("c").over(order), F.lit(0))).alias("dclose"), *((cents(F.col(x)) - F.col("c")).alias(f"{x}_off") for x in PRICES[:3]),
        F.rint(F.col("vol") * VOLUME_SCALE).cast("long").alias("vol_q"), F.rint("qvol").cast("long").alias("qvol_q"), "ntrades", F.rint(F.col("takerfrac") * TAKER_SCALE).cast("int").alias("taker_q"), "valid",
    )


def decoded(codes: DataFrame) -> DataFrame:
    """The inverse of ``encoded``, up to quantisation."""
    order = Window.partitionBy("symbol", "big").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = codes.withColumn("c", F.sum("dclose").over(order))
    return whole.select(
        "symbol", "big", "t", *(((F.col("c") + F.col(f"{x}_off")) / 100).alias(x) for x in PRICES[:3]), (F.col("c") / 100).alias("close"),
        (F.col("vol_q") / VOLUME_SCALE).alias("vol"), F.col("qvol_q").cast("double").alias("qvol"), "ntrades", (F.col("taker_q") / TAKER_SCALE).alias("takerfrac"), "valid",
    )


def projected(tape: DataFrame) -> DataFrame:
    """The log form: logp, close, hi_off, lo_off, lv, lntr, imb, valid."""
    price = lambda c: F.ln(at_least(F.col(c), 1e-9))
    return tape.select(
        "symbol", "big", "t", price("close").alias("logp"), "close", (price("high") - price("close")).alias("hi_off"), (price("low") - price("close")).alias("lo_off"),
        F.log1p(at_least(F.col("vol"), 0.0)).alias("lv"), F.log1p(at_least(F.col("ntrades").cast("double"), 0.0)).alias("lntr"), F.when(F.col("vol") > 0, (F.col("takerfrac") - 0.5) * 2).otherwise(0.0).alias("imb"), "valid",
    )


def restored(logs: DataFrame) -> DataFrame:
    """Physical columns from the log form; the traded value becomes vol * close."""
    vol = F.expm1("lv")
    return logs.select("symbol", "big", "t", "close", F.exp(F.col("logp") + F.col("hi_off")).alias("high"), F.exp(F.col("logp") + F.col("lo_off")).alias("low"), vol.alias("vol"), (vol * F.col("close")).alias("qvol"), F.rint(F.expm1("lntr")).alias("ntrades"), (F.col("imb") / 2 + 0.5).alias("takerfrac"), "valid")

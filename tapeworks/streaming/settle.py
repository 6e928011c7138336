"""Settlement in a stream: a forecast is scored when the bar it speaks of arrives, and never before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(forecasts: DataFrame, prices: DataFrame, late: str = "10 minutes") -> DataFrame:
    """symbol, at, ahead, forecast, anchor, truth, hit for each forecast (symbol, at, ahead in seconds, forecast, anchor) and
    the price (symbol, at, logp) that it speaks of.

    A join of two streams on the symbol and the time at which the forecast falls due. Both times are watermarked, which bounds
    the state: a forecast waits for its price until the prices' watermark has passed, and no longer.
    """
    due = F.timestamp_micros(F.unix_micros("at") + F.col("ahead").cast("long") * 1_000_000)
    left = forecasts.select(F.col("symbol").alias("f_symbol"), F.col("at").alias("f_at"), "ahead", "forecast", "anchor", due.alias("due")).withWatermark("due", late)
    right = prices.select("symbol", "at", "logp").withWatermark("at", late)
    met = left.join(right, (F.col("f_symbol") == F.col("symbol")) & (F.col("due") == F.col("at")))
    truth = F.col("logp") - F.col("anchor")
    return met.select("symbol", F.col("f_at").alias("at"), "ahead", "forecast", "anchor", truth.alias("truth"), (F.signum("forecast") == F.signum(truth)).alias("hit"))

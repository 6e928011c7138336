"""The event table as ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.grid import seconds

#: Prices are values lifted by this much, so that log returns stay small.
LIFT = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, bar: int = 60, panel: bool = False) -> DataFrame:
    """symbol, t, at, price, size, taker: one symbol, or one for each event type; t counts bars since 1970."""
    events = table(spark, sf_dir, "events").where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return events.select(
        (F.col("event_type") if panel else F.lit("ALL")).alias("symbol"), F.floor(seconds(F.col("ts")) / bar).alias("t"), F.struct("ts", "event_id").alias("at"),
        (F.col("value") + LIFT).alias("price"), F.col("value").alias("size"), F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("taker"),
    )

"""Replays: which stretch of a tape is replayed, and a snapshot of it from which scores and frames follow without a model or the tape.

A snapshot is a folder of tables: ``forecasts`` (paths as arrays), ``truth`` (arrays), ``bars`` (the closes that frames show) and
``about``, one row of its sizes. ``about`` is written last, so that a snapshot whose writing was cut short is made anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import context, grid, score
from tapeworks.operators.recurrence import numbered
from tapeworks.sources import store
from tapeworks.sources.files import kept

DAY = 86_400


def session(tape: DataFrame, length: int, horizon: int, bar: int = 1, hours: float = 24.0, day: str | None = None, seed: int | None = None) -> DataFrame:
    """symbol, start, stop: the stretch to be replayed of each symbol's tape, in bars, ``hours`` long.

    It begins with a date given as text (``day``), or with a seed on one of the days, each as likely and the same for the same seed, or
    at the first bar with full context. A start drawn by seed leaves room for the whole session where there is any. Stretches are held within
    what has full context (``length`` bars) and a full future (``horizon`` bars); symbols without such bars have no row.
    """
    size, per_day = int(hours * 3600 / bar), DAY // bar
    lo, hi = F.min("t") + length + 1, F.max("t") - horizon + 1
    ends = tape.groupBy("symbol").agg(lo.alias("lo"), hi.alias("hi")).where("lo < hi").withColumn("last", F.greatest("lo", F.col("hi") - size))
    if day is not None:
        start = F.floor(store.day_bounds(F.lit(day))[0] / bar)
        begun = ends.withColumn("start", start)
    elif seed is not None:
        days = ends.withColumn("day", F.explode(F.sequence(F.floor(F.col("lo") / per_day), F.floor(F.col("last") / per_day))))
        drawn = F.min_by("day", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("day").cast("string"))))
        begun = days.groupBy("symbol", "lo", "hi", "last").agg((drawn * per_day).alias("start")).withColumn("start", F.least(F.greatest("lo", "start"), "last"))
    else:
        begun = ends.withColumn("start", F.col("lo"))
    within = begun.select("symbol", F.greatest("lo", "start").cast("long").alias("start"), F.least("hi", F.col("start") + size).cast("long").alias("stop"))
    return within.where("start < stop")


def cursors(bounds: DataFrame, stride: int) -> DataFrame:
    """symbol, t, id: every ``stride`` bars of a session."""
    return bounds.select("symbol", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(stride).cast("long"))).alias("t")).withColumn("id", F.col("t"))


@dataclass
class Snapshot:
    forecasts: DataFrame
    truth: DataFrame
    bars: DataFrame
    horizon: int
    lookback: int

    def scores(self, window: int = 60) -> DataFrame:
        return score.scores(self.forecasts, self.truth, self.horizon, window)

    def scorecard(self) -> DataFrame:
        return score.scorecard(self.scores())

    def frames(self, window: int = 60, stride: int = 1) -> DataFrame:
        """Frames of every ``stride``-th cursor; what they tell of hits and errors so far counts all cursors."""
        at = self.truth.select("symbol", "t", "id")
        found = score.frames(at, self.bars, self.forecasts, kept(self.scores(window), "scores"), self.lookback, self.horizon)
        if stride == 1:
            return found
        nth = numbered(at, "symbol").where(F.col("n") % stride == 0).select("symbol", "t")
        return found.join(nth, ["symbol", "t"], "left_semi")


def save(path: str, at: DataFrame, tape: DataFrame, forecasts: DataFrame, horizon: int, lookback: int) -> None:
    """Writes a snapshot. at: the cursors (symbol, t, id); forecasts: model, symbol, id, t, sig, paths at these."""
    ends = at.groupBy("symbol").agg((F.min("t") - lookback).alias("from"), (F.max("t") + horizon).alias("to"))  # a row for each symbol
    shown = tape.join(ends, "symbol").where("t >= from and t <= to").select("symbol", "t", "close")
    tables = {"forecasts": forecasts, "truth": context.futures(at, grid.projected(tape), horizon).select("symbol", "t", "id", "truth"), "bars": shown}
    for name, table in tables.items():
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    tape.sparkSession.createDataFrame([(horizon, lookback)], "horizon int, lookback int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str) -> Snapshot:
    about = spark.read.schema("horizon int, lookback int").json(f"{path}/about").first()
    return Snapshot(*(spark.read.parquet(f"{path}/{name}") for name in ("forecasts", "truth", "bars")), about["horizon"], about["lookback"])


def snapshot(spark: SparkSession, path: str, make: Callable[[], tuple], horizon: int, lookback: int) -> Snapshot:
    """The snapshot in the folder; if none was written to its end, ``make`` gives (cursors, tape, forecasts) and it is written first."""
    if not store.exists(spark, f"{path}/about"):
        save(path, *make(), horizon, lookback)
    return load(spark, path)

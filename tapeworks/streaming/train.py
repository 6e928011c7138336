"""A forecaster that learns as the stream goes, and counters of what a stream reads.

The model is what ``forecast.walk_arrays`` takes: by how much a signal leads the median (``drift``), and a constant lead (``level``), in units of the
first mode. It is the ridge regression of settled futures on the signal. A micro-batch adds up its sums of products, one row;
the coefficients that follow from all sums so far, and their exponential average, are the next version of a small table.
Versions are named by their batch and follow from the one before, so that a batch that runs again writes the same again.
"""

from __future__ import annotations

import math
import threading

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: What keeps the regression's matrix invertible, and how slowly the averaged coefficients follow.
RIDGE, DECAY = 1e-6, 0.98
SUMS = ("n", "x", "xx", "y", "xy")
VERSION = "batch long, " + ", ".join(f"{c} double" for c in SUMS) + ", level double, drift double, mean_level double, mean_drift double"


def examples(seen: DataFrame, futures: DataFrame, horizon: int) -> DataFrame:
    """symbol, t, x, y: the signal at a cursor, and the lead of the first mode that would have met the end of its future.

    seen: symbol, t, sig, signal; futures: symbol, t, truth. What isn't finite teaches nothing.
    """
    unit = math.sqrt(2.0) / (0.5 * math.pi) * math.sqrt(horizon)  # the end of a path whose first coefficient is one
    y = F.element_at("truth", -1) / (F.greatest("sig", F.lit(1e-8)) * unit)
    rows = seen.join(futures.select("symbol", "t", "truth"), ["symbol", "t"]).select("symbol", "t", F.col("signal").alias("x"), y.alias("y"))
    return rows.where(~F.isnan(F.col("x") * F.col("y")) & (F.abs(F.col("x") * F.col("y")) < float("inf")))


def sums_of(rows: DataFrame) -> tuple[float, ...]:
    x, y = F.col("x"), F.col("y")
    return tuple(float(v or 0) for v in rows.agg(F.count("*"), F.sum(x), F.sum(x * x), F.sum(y), F.sum(x * y)).first())


def solved(sums) -> tuple[float, float]:
    """level and drift from the sums of products."""
    n, x, xx, y, xy = sums
    level, drift = np.linalg.solve([[n + RIDGE, x], [x, xx + RIDGE]], [y, xy])
    return float(level), float(drift)


def learnt(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream of examples to the end of what is there; gives all versions of the coefficients, by batch.

    path holds the versions and the stream's progress. A stream begun again there goes on from its last version.
    """
    spark = stream.sparkSession
    versions = f"{path.rstrip('/')}/versions"

    def teach(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        before = version(session, versions, batch - 1)
        old = [before[c] for c in SUMS] if before else [0.0] * len(SUMS)
        sums = [a + b for a, b in zip(old, sums_of(rows))]
        level, drift = solved(sums)
        means = [DECAY * before[f"mean_{c}"] + (1 - DECAY) * v for c, v in (("level", level), ("drift", drift))] if before else [level, drift]
        session.createDataFrame([(batch, *sums, level, drift, *means)], VERSION).coalesce(1).write.mode("overwrite").parquet(f"{versions}/v={batch}")

    stream.writeStream.foreachBatch(teach).option("checkpointLocation", f"{path.rstrip('/')}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(VERSION).option("recursiveFileLookup", "true").parquet(versions)


def version(spark: SparkSession, versions: str, batch: int):
    """The version that a batch wrote, or None before the first."""
    return spark.read.schema(VERSION).parquet(f"{versions}/v={batch}").first() if batch >= 0 else None


class Counters(StreamingQueryListener):
    """Appends a row for each batch of the streams it is told of: rows read, and rows a second as they came and as they went.

    columns: stream, batch, stamp, rows, arrived, done, ms. ``wait`` returns once the streams begun under it have ended.
    """

    COLUMNS = "stream string, batch long, stamp string, rows long, arrived double, done double, ms long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended, self.mine = spark, path, threading.Event(), set()

    def __enter__(self) -> Counters:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.ended.wait(60)  # events come after the streams' own end
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self.mine.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.runId), p.batchId, p.timestamp, p.numInputRows, float(p.inputRowsPerSecond or 0), float(p.processedRowsPerSecond or 0), int(p.batchDuration))
        self.spark.createDataFrame([row], self.COLUMNS).coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.mine.discard(str(event.runId))
        if not self.mine:
            self.ended.set()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.COLUMNS).json(self.path)

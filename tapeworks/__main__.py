"""Whole runs by name: ``python -m tapeworks pack|materialise|train|replay|render|smoke ...``.

pack          candle files (CSV or zip) to shards of a month of seconds each
materialise   shards to a store of the 59 features, partitioned by month
train         shards to a forecaster that learns from settled cursors as they stream by
replay        a session of shards to a snapshot, and the scorecard of the forecasters in it
render        a snapshot to the records of its frames, with the scorecard beside them; no model, no shards
smoke         the others on a synthetic tape, in a folder given
"""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import analyser, context, forecast, grid, replays
from tapeworks.sources import klines, shards, store
from tapeworks.sources.files import kept
from tapeworks.streaming import train as stream

#: Bars of a second in a shard: 31 days.
WIDTH = 31 * 86_400


def pack(spark: SparkSession, source: str, target: str, symbol: str = "ALL", width: int = WIDTH) -> DataFrame:
    """Fills what the candles leave open and writes shards; gives the manifest. Stretches that are there already stay."""
    read = klines.read_zip if source.endswith(".zip") else klines.read_csv
    return shards.write(grid.filled(grid.densify(read(spark, source, symbol))), target, width)


def tape(spark: SparkSession, folder: str) -> DataFrame:
    return shards.read(spark, folder).withColumn("big", F.floor(F.col("t") / grid.SPAN))


def materialise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """The features of every second, kept by month."""
    store.save(analyser.features(tape(spark, folder)).drop("big"), target, 1)
    return store.load(spark, target, 1)


def seen(bars: DataFrame, at: DataFrame) -> DataFrame:
    """The cursors, each with the volatility and the signal at hand."""
    made = analyser.features(bars, names=("logvol_300s", "ret_60s_z")).select("symbol", "t", F.exp(F.col("logvol_300s") - 9.0).alias("sig"), F.col("ret_60s_z").alias("signal"))
    return at.join(made, ["symbol", "t"])


def replay(
    spark: SparkSession, folder: str, snapshot: str, length: int = 10_800, horizon: int = 1_500, modes: int = 24, stride: int = 20, lookback: int = 7_200, hours: float = 24.0, day: str | None = None, seed: int | None = None, models: DataFrame | None = None,
) -> DataFrame:
    """Replays a session, by date, by seed or from the beginning, into a snapshot; gives one row for each forecaster.

    A snapshot that is there already is opened instead, and needs no shards. models (model, drift, level): a driftless walk, and
    walks led and faded by the last minute's move, unless given.
    """

    def make():
        bars = kept(tape(spark, folder), "tape")
        at = replays.cursors(replays.session(bars, length, horizon, 1, hours, day, seed), stride)
        every = models if models is not None else spark.createDataFrame([("walk", 0.0), ("trend", 0.1), ("fade", -0.1)], "model string, drift double")
        return at, bars, forecast.path_arrays(forecast.walk_arrays(seen(bars, at), every, horizon, modes), horizon)

    return replays.snapshot(spark, snapshot, make, horizon, lookback).scorecard()


def render(spark: SparkSession, snapshot: str, target: str, roll: int = 60, stride: int = 1) -> DataFrame:
    """A frame for each ``stride``-th cursor of a snapshot, in order, and the scorecard as JSON beside them; gives the scorecard."""
    found = replays.load(spark, snapshot)
    found.frames(roll, stride).repartitionByRange("symbol", "t").sortWithinPartitions("symbol", "t").write.mode("overwrite").parquet(f"{target}/frames")
    return store.sidecar(found.scorecard(), f"{target}/scorecard")


def train(spark: SparkSession, folder: str, target: str, length: int = 10_800, horizon: int = 1_500, stride: int = 60, batches: int = 16) -> DataFrame:
    """A forecaster learnt from the settled cursors of all shards, streamed in order of time; gives its versions, batch by batch.

    Run again in the same folder, it goes on from its last version with examples that came after.
    """
    bars = kept(tape(spark, folder), "tape")
    at = context.replay_times(bars, length, horizon, stride)
    rows = stream.examples(seen(bars, at), context.futures(at, grid.projected(bars), horizon), horizon)
    known = f"{target}/examples"
    begun = store.exists(spark, known)
    if begun:
        rows = rows.join(spark.read.schema(rows.schema).parquet(known).select("symbol", "t"), ["symbol", "t"], "left_anti").select(*rows.columns)
    rows = kept(rows, "examples")
    if not begun or not rows.isEmpty():
        rows.repartitionByRange(batches, "t").write.mode("append").parquet(known)
    return stream.learnt(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(known), target)


def smoke(spark: SparkSession, folder: str, seconds: int = 20_000) -> DataFrame:
    """A made-up tape packed, materialised and replayed."""
    t, u = F.col("id") + 1_700_000_000, F.rand(7)
    price = F.round(30_000 * F.exp(1e-3 * F.sin(F.col("id") / 900.0)) + F.randn(7), 2)
    lines = spark.range(seconds).where("id % 50 != 7").select((t * 1000).alias("open_time"), *(price.alias(c) for c in ("o", "h", "l", "c")), u.alias("v"), t.alias("end"), (u * price).alias("qv"), F.lit(3).alias("n"), (u / 2).alias("tb"), F.lit(0).alias("tq"), F.lit(0).alias("i"))
    lines.write.csv(f"{folder}/candles")
    pack(spark, f"{folder}/candles", f"{folder}/shards")
    materialise(spark, f"{folder}/shards", f"{folder}/features")
    versions = train(spark, f"{folder}/shards", f"{folder}/learnt", length=4_000, stride=500, batches=3)
    last = versions.agg(F.max_by(F.struct("mean_drift", "mean_level"), "batch").alias("v")).select(F.lit("learnt").alias("model"), F.col("v.mean_drift").alias("drift"), F.col("v.mean_level").alias("level"))
    models = spark.createDataFrame([("walk", 0.0, 0.0), ("trend", 0.1, 0.0), ("fade", -0.1, 0.0)], "model string, drift double, level double").unionByName(last)
    replay(spark, f"{folder}/shards", f"{folder}/replay", length=4_000, stride=2_000, lookback=600, models=models)
    return render(spark, f"{folder}/replay", f"{folder}/shown")


def main() -> None:
    parser = argparse.ArgumentParser(prog="tapeworks", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for run in (pack, materialise, train, replay, render, smoke):
        command = commands.add_parser(run.__name__, description=run.__doc__)
        for name, p in list(inspect.signature(run).parameters.items())[1:]:
            if p.default is inspect.Parameter.empty:
                command.add_argument(name)
            elif name != "models":
                command.add_argument(f"--{name}", default=p.default, type={"day": str, "seed": int}.get(name, type(p.default)))
    asked = vars(parser.parse_args())
    spark = SparkSession.builder.appName("tapeworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = globals()[asked.pop("command")](spark, **asked)
    found.show(50, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()

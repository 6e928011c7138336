"""Streams run over a table that is already there, to its end, for the registry and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.scalars import r6
from tapeworks.operators import grid
from tapeworks.operators.analyser import NAMES
from tapeworks.plans import settings as S
from tapeworks.sources.events import ticks
from tapeworks.sources.files import scratch
from tapeworks.streaming import analyser, panel, settle


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{scratch(spark, f'{tempfile.gettempdir()}/tapeworks')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, path: str | None = None) -> DataFrame:
    """What an appending stream gives when all that is there has been read."""
    path = path or place(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/[e]vents.parquet")


def stream_analyser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to bars to features: two streams, the second reading the table of closed bars that the first appends to.

    A bar is given out once the watermark, ten minutes behind the latest event, has passed it. A live stream has no end, so the
    last ten minutes of the table wait for events that don't come.
    """
    path = place(spark)
    closed = drained(analyser.bars(events(spark, sf_dir)), path)
    found = drained(analyser.features(spark.readStream.schema(closed.schema).parquet(f"{path}/out")))
    return found.select("symbol", "t", "valid", *(r6(F.col(n)).alias(n) for n in NAMES))


def stream_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every STRIDE-th bar of the filled tape a forecast of no move for each of the next HORIZON bars, settled as these arrive."""
    path = f"{place(spark)}/tape"
    grid.projected(grid.filled(grid.densify(grid.bars(ticks(spark, sf_dir))))).select("symbol", "t", "logp").write.parquet(path)
    schema = spark.read.parquet(path).schema
    bars = lambda: spark.readStream.schema(schema).parquet(path).withColumn("at", F.timestamp_seconds(F.col("t") * 60))
    ahead = F.explode(F.sequence(F.lit(60), F.lit(60 * S.HORIZON), F.lit(60)))
    asked = bars().where(F.col("t") % S.STRIDE == 0).select("symbol", "at", F.col("logp").alias("anchor"), F.lit(0.0).alias("forecast"), ahead.alias("ahead"))
    found = drained(settle.settled(asked, bars()))
    return found.select("symbol", (F.unix_seconds("at") / 60).cast("long").alias("t"), (F.col("ahead") / 60).cast("long").alias("h"), r6(F.col("truth")).alias("truth"), "hit")


@contextmanager
def stored_in_rocks(spark: SparkSession):
    """Streams started here keep their state in RocksDB, and the process that Spark starts beside the driver for them finds this package.

    That process doesn't get what ``addPyFile`` ships; tasks do.
    """
    key, environment = "spark.sql.streaming.stateStore.providerClass", spark.sparkContext.environment
    before, paths = spark.conf.get(key, None), environment.get("PYTHONPATH")
    spark.conf.set(key, panel.PROVIDER)
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(Path(__file__).resolve().parents[2]), paths]))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
        environment.pop("PYTHONPATH")
        environment.update({"PYTHONPATH": paths} if paths else {})


def stream_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of a symbol for each event type, from its first bar to the last that ended ten minutes before the last event."""
    with stored_in_rocks(spark):
        found = drained(panel.features(panel.ticks(events(spark, sf_dir))))
    return found.select("symbol", "t", "valid", *(r6(F.col(n)).alias(n) for n in NAMES))


QUERIES = {"stream_panel": stream_panel, "stream_analyser": stream_analyser, "stream_settlement": stream_settlement}

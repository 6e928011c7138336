"""Archives of candles, month by month: what is wanted against what is at hand, and a status for each month.

An archive is a CSV, plain or in a zip, named ``<symbol>-<anything>-2024-01.csv`` for a month or ``...-2024-01-31.csv`` for a day. A month's own
archive is preferred; without one, its days are put together. Each month ends as ``ok``, ``cached`` (its shard is there already),
``empty`` (its archives hold no candle of the month), ``unavailable`` (no archive, or none with a byte in it) or ``error``: an archive that can't be read costs its
month alone, and the others are packed.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import grid
from tapeworks.sources import shards
from tapeworks.sources.files import kept, opened
from tapeworks.sources.klines import COLUMNS, READ, candles, unit

NAME = r"([^/]+?)-(?:[^/]*-)?(\d{4}-\d{2})(-\d{2})?\.(csv|zip)$"
STATUSES = "symbol string, month string, status string, source string, archives long, n long, n_valid long, bytes long, gap_pct double, error string"
PARSED = "symbol string, month string, file string, row long, error string, " + ", ".join(f"{c} {t}" for c, t in READ.items())


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, symbol, month and day (null for a month's archive) of the archives in a folder. Their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    part = lambda i: F.regexp_extract("path", NAME, i)
    return files.where(F.col("path").rlike(NAME)).select("path", part(1).alias("symbol"), part(2).alias("month"), F.nullif(part(3), F.lit("")).alias("day"))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every month from the first to the last, as year and month."""
    stretch = F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(stretch).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))


def planned(wanted: DataFrame, archives: DataFrame, symbol: str) -> DataFrame:
    """symbol, month, source (monthly, daily or null), paths: what each wanted month is to be packed from."""
    own = archives.where(F.col("symbol") == symbol).groupBy("month").agg(F.collect_list(F.when(F.col("day").isNull(), F.col("path"))).alias("whole"), F.array_sort(F.collect_list(F.when(F.col("day").isNotNull(), F.col("path")))).alias("days"))  # 32 at most
    met = wanted.join(own, "month", "left")
    source = F.when(F.size("whole") > 0, "monthly").when(F.size("days") > 0, "daily")
    paths = F.when(source == "monthly", F.col("whole")).when(source == "daily", F.col("days")).otherwise(F.array().cast("array<string>"))
    return met.select(F.lit(symbol).alias("symbol"), "month", source.alias("source"), paths.alias("paths"))


def lines(content: bytes, path: str) -> pd.DataFrame:
    """The candles of an archive. One unit of time holds for a whole file: that of its first stamp."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            content = archive.read(archive.namelist()[0])
    body = content if content[:1].isdigit() else content.partition(b"\n")[2]  # a first line without a stamp is a header
    if not body.strip():
        return pd.DataFrame(columns=list(READ))
    rows = pd.read_csv(io.BytesIO(body), header=None, names=list(COLUMNS), usecols=list(READ))
    scale = unit(int(rows["open_time"].iloc[0])) if len(rows) else 1
    return rows.assign(open_time=rows["open_time"].astype("int64") // scale)[list(READ)]


def parsed(batches):
    """For mapInPandas over (symbol, month, path, content): candles, or one row with what went wrong."""
    for batch in batches:
        for symbol, month, path, content in batch.itertuples(index=False, name=None):
            try:
                rows = lines(content, path).assign(error=None)
            except Exception as e:  # an archive may be anything; what it is costs its own month
                rows = pd.DataFrame([{"error": f"{type(e).__name__}: {e}"[:500]}])
            yield rows.assign(symbol=symbol, month=month, file=path, row=range(len(rows))).reindex(columns=["symbol", "month", "file", "row", "error", *READ])


def starts(month: Column, bar: int) -> tuple[Column, Column]:
    """First bar of a month, and the first after it."""
    day = F.to_date(F.concat(month, F.lit("-01")))
    at = lambda d: (F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 / bar).cast("long")
    return at(day), at(F.add_months(day, 1))


def packed(spark: SparkSession, folder: str, target: str, symbol: str, first: str, last: str, bar: int = 1, level: int = 17) -> DataFrame:
    """Packs every month of a symbol that is wanted and not there into a shard of its own; gives a status for each month."""
    plan = kept(planned(months(spark, first, last), listed(spark, folder), symbol), "plan")
    there = {x.base_name for x in at_hand(target)}
    is_cached = F.concat_ws("-", "symbol", "month").isin([x.removesuffix(".shard") for x in there])
    todo = plan.where(~is_cached).select("symbol", "month", F.explode("paths").alias("path"))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    rows = kept(todo.join(content, "path").select("symbol", "month", "path", "content").mapInPandas(parsed, PARSED), "candles")
    failed = rows.where(F.col("error").isNotNull()).groupBy("symbol", "month").agg(F.min("error").alias("error"))

    begin, end = starts(F.col("month"), bar)
    good = rows.where(F.col("error").isNull()).join(failed.select("symbol", "month"), ["symbol", "month"], "left_anti")
    stamped = good.withColumn("open_time", F.floor(F.col("open_time") / bar)).where((F.col("open_time") >= begin) & (F.col("open_time") < end))
    # a month is a tape of its own, from its first bar to its last
    found = candles(stamped.drop("error", "symbol"), symbol, F.col("open_time"), ["month"]).withColumn("symbol", F.concat_ws("|", "symbol", "month")).drop("month")
    ends = found.select("symbol", F.element_at(F.split("symbol", r"\|"), -1).alias("month")).distinct().select("symbol", F.explode(F.array(begin, end - 1)).alias("t"))
    whole = found.unionByName(ends.join(found.select("symbol", "t"), ["symbol", "t"], "left_anti"), allowMissingColumns=True)
    tape = grid.filled(grid.densify(whole)).withColumn("month", F.element_at(F.split("symbol", r"\|"), -1)).withColumn("symbol", F.lit(symbol))
    manifest = shards.write(tape, target, by=F.col("month"), level=level).select("symbol", F.regexp_extract("file", r"(\d{4}-\d{2})\.shard$", 1).alias("month"), "n", "n_valid", "bytes", "gap_pct", "status")

    met = plan.join(manifest, ["symbol", "month"], "left").join(failed, ["symbol", "month"], "left")
    status = F.when(is_cached, "cached").when(F.col("source").isNull(), "unavailable").when(F.col("error").isNotNull(), "error").when(F.col("status").isNull(), "empty").otherwise(F.col("status"))
    return met.select("symbol", "month", status.alias("status"), "source", F.size("paths").cast("long").alias("archives"), "n", "n_valid", "bytes", "gap_pct", "error")


def at_hand(target: str) -> list[pyarrow.fs.FileInfo]:
    fs, root = opened(target)
    return shards.listed(fs, root)[0]

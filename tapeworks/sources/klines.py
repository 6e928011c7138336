"""Exchange candles as CSV, plain or zipped: headers or none, twelve columns of which nine are read.

Stamps are in seconds, milli-, micro- or nanoseconds: one unit a file, told by the size of its first stamp. To learn it, a file is
opened and read as far as its first candle.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.sources.files import opened

# fixed values: the columns of the format, in order; the sixth and the last are not read
COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignored")
READ = {"open_time": "long", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "quote_volume": "double", "trades": "long", "taker_base": "double"}
#: Stamps above a limit are in the unit beside it, in parts of a second.
UNITS = ((10**17, 10**9), (10**14, 10**6), (10**11, 10**3))
SHAPE = "file string, row long, " + ", ".join(f"{c} {t}" for c, t in READ.items())


def unit(stamp: int) -> int:
    return next((u for limit, u in UNITS if stamp > limit), 1)


def units(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, unit: what the first stamp of each file tells; files without a candle have no row. Only their heads are read."""

    def run(batches):
        for batch in batches:
            made = []
            for path in batch["file"]:
                fs, inner = opened(path)
                with fs.open_input_stream(inner) as raw, io.TextIOWrapper(raw, encoding="utf-8", errors="replace") as lines:
                    first = next((line for line in lines if line[:1].isdigit()), None)
                if first is not None:
                    made.append((path, unit(int(first.split(",", 1)[0]))))
            yield pd.DataFrame(made, columns=["file", "unit"])

    named = [paths] if isinstance(paths, str) else paths
    listed = spark.read.format("binaryFile").load(named).select(F.col("_metadata.file_path").alias("file"))
    return listed.mapInPandas(run, "file string, unit long")


def read_csv(spark: SparkSession, paths: str | list[str], symbol: str = "ALL") -> DataFrame:
    """Candles of CSV files; lines that don't begin with a digit are headers."""
    raw = spark.read.csv(paths, schema=", ".join(f"{c} string" for c in COLUMNS), header=False)
    rows = raw.where(F.col("open_time").rlike("^[0-9]")).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), *(F.col(c).cast(t).alias(c) for c, t in READ.items()))
    return candles(rows.join(units(spark, paths), "file"), symbol, F.expr("open_time div unit"))


def read_zip(spark: SparkSession, paths: str | list[str], symbol: str = "ALL") -> DataFrame:
    """Candles of zip archives with a CSV each. An archive is one task's: it can't be split."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as file:
                    skip = 0 if file.read(1).isdigit() else 1
                    file.seek(0)
                    first, scale = 0, None
                    for part in pd.read_csv(file, header=None, names=list(COLUMNS), usecols=list(READ), skiprows=skip, chunksize=500_000):
                        scale = scale or unit(int(part["open_time"].iloc[0]))
                        yield part[list(READ)].assign(file=path, row=range(first, first + len(part)), open_time=part["open_time"] // scale)[["file", "row", *READ]]
                        first += len(part)

    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    return candles(raw.mapInPandas(run, SHAPE), symbol, F.col("open_time"))


def candles(rows: DataFrame, symbol: str, t: Column, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """symbol, t, prices, vol, qvol, ntrades, takerfrac, keep; of candles for one t the last in file order stays."""
    from tapeworks.operators.grid import TAKER_SCALE, VOLUME_SCALE, last_wins

    share = F.when(F.col("volume") > 0, F.least(F.greatest(F.col("taker_base") / F.greatest("volume", F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    found = rows.select(
        F.lit(symbol).alias("symbol"), t.alias("t"), *keep, *((F.rint(F.col(c) * 100) / 100).alias(c) for c in ("open", "high", "low", "close")),
        (F.rint(F.col("volume") * VOLUME_SCALE) / VOLUME_SCALE).alias("vol"), F.rint("quote_volume").alias("qvol"), F.col("trades").alias("ntrades"), (F.rint(share * TAKER_SCALE) / TAKER_SCALE).alias("takerfrac"), "file", "row",
    )
    return last_wins(found, "file", "row").drop("file", "row")

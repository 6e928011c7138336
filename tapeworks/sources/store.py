"""A feature store in Parquet: months as partitions, range scans pruned by them, cached results, metrics and side files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def month(t, bar: int):
    return F.date_format(F.timestamp_seconds(t * bar), "yyyy-MM")


def save(rows: DataFrame, path: str, bar: int) -> None:
    """Writes rows (symbol, t, ...) by month, zstd-compressed; months written again replace themselves alone."""
    keyed = rows.withColumn("month", month(F.col("t"), bar)).repartition("symbol", "month").sortWithinPartitions("symbol", "t")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol", "month").parquet(path)


def load(spark: SparkSession, path: str, bar: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows with start <= t < stop. The months of the range are in the predicate, so that other months aren't listed."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where((F.col("t") >= start) & (F.col("month") >= month(F.lit(start), bar)))
    if stop is not None:
        rows = rows.where((F.col("t") < stop) & (F.col("month") <= month(F.lit(stop - 1), bar)))
    return rows


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds training metrics (variant, ...) as JSON lines, a folder for each variant."""
    rows.write.mode("append").partitionBy("variant").json(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training metrics, a JSON object a line, from every variant's folder."""
    return spark.read.json(path).withColumn("file", F.input_file_name())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path, which is computed and written if it isn't there."""
    if not exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sidecar(rows: DataFrame, path: str) -> DataFrame:
    """Writes a small table as JSON beside what it sums up, and reads it."""
    rows.coalesce(1).write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def day_bounds(day):
    """First and past-last second of a date given as text."""
    start = F.unix_seconds(F.to_timestamp(day))
    return start, start + 86_400


def utc(seconds):
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")

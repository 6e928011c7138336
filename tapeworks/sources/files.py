"""File systems by address, for tasks that read and write files of their own."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Names that Spark gives to stores which the Arrow library knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "abfss": "abfs"}


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path in it."""
    scheme, mark, rest = folder.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else folder if ":" in folder else os.path.abspath(folder))


def shared_dir(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder; none if neither is set."""
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or (option.get() if option.isDefined() else None)


def scratch(spark: SparkSession, made: str) -> str:
    """The shared folder; where none is set and the master is this machine alone, the given local one."""
    found = shared_dir(spark)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return found or made


def kept(df: DataFrame, name: str) -> DataFrame:
    """df computed once, written as a table in the shared folder and read again: lineage ends there, and its size is known."""
    path = f"{scratch(df.sparkSession, f'{tempfile.gettempdir()}/tapeworks')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.kept_at = path
    return found


def forget(df: DataFrame) -> None:
    """Deletes a table that ``kept`` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

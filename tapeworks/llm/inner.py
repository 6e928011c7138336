"""Integer vectors and exact inner products, shared by the searches over embeddings.

A vector takes part if it and its id aren't null and no component is null or not finite. Components become floor(scale * x),
x as double, as 64-bit integers; what passes 64 bits, a component or a score, counts as the largest or smallest such integer.
Rows are told apart by a number of their own, so repeated ids and repeated rows are rows like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.util import stored

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integers(vectors: DataFrame, scale: int, *columns) -> DataFrame:
    """row, vec_id, ``columns`` and v (array of longs) of the rows that take part, written once."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), *columns, F.transform(v, lambda x: F.floor(x * scale)).alias("v")), "integers")


def sample(rows: DataFrame, n: int, size: int) -> pa.Table:
    """About ``size`` of n rows, those whose number hashes lowest: row and v."""
    place = F.pmod(F.xxhash64("row"), F.lit(1 << 40))
    return rows.where(place <= F.lit(int((1 << 40) * min(1.0, size / max(n, 1))))).select("row", "v").toArrow().sort_by("row")


def by_width(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in a column of lists: the places of these vectors, and the vectors as rows of an array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    widths = np.diff(offsets)
    found = []
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        found.append((at, flat[offsets[at][:, None] + np.arange(w)].astype(np.int64)))
    return found


def reach(*arrays: np.ndarray) -> float:
    """No sum of products of rows of these arrays is larger in size."""
    return float(arrays[0].shape[1]) * float(np.prod([np.abs(a.astype(np.float64)).max(initial=0) for a in arrays]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b: in doubles while these are exact, else in integers, at last in Python's."""
    size = reach(a, b)
    if size < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if size < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def best(df: DataFrame, key: list[str], order: list, k: int, rank: str) -> DataFrame:
    """The first k rows of each key, numbered from 1 in ``rank``; all but k rows of a key and task go before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def dealt(asking: DataFrame, batches: int, held: DataFrame, shards: int):
    """Batches of asking rows against shards (column b) of held rows, every pair in a task of its own; for applyInArrow."""
    left = asking.withColumn("a", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = held.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))

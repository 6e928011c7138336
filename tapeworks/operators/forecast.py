"""Quantile paths on a smooth basis, and the forecaster that needs no weights: a driftless walk at the volatility at hand.

Models are a boundary: whatever gives raw coefficients (model, id, t, q, k, raw) can be ordered, synthesised and scored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.scalars import at_least, inverse_softplus, softplus, z_score

QUANTILES = (0.1, 0.5, 0.9)
# fixed values: named recipes (width, layers, heads, basis, dropout, rate, stability, tilt, weight decay)
RECIPES = {
    "base": (640, 12, 10, 24, 0.05, 3.0e-4, 0.35, 0.50, 0.02),
    "deep": (768, 16, 12, 32, 0.10, 2.0e-4, 0.50, 0.35, 0.05),
    "wide": (1024, 10, 16, 32, 0.05, 2.5e-4, 0.25, 0.65, 0.02),
    "agile": (512, 14, 8, 40, 0.15, 5.0e-4, 0.20, 0.80, 0.01),
    "mini": (128, 3, 4, 20, 0.05, 8.0e-4, 0.25, 0.65, 0.01),
    "micro": (192, 4, 6, 16, 0.05, 6.0e-4, 0.30, 0.50, 0.01),
    "nano": (96, 2, 4, 12, 0.00, 1.0e-3, 0.30, 0.50, 0.01),
}
RECIPE_COLUMNS = "name string, width int, layers int, heads int, n_basis int, dropout double, rate double, stability double, tilt double, weight_decay double"
POPULATION = ("base", "deep", "wide", "agile")
#: Pooled levels of a window: span and stride in bars; and the rows of a patch.
LEVELS, PATCH = ((1024, 1), (4096, 4), (16384, 16), (43200, 64)), 16


def basis_value(h: Column, k: Column, horizon: int) -> Column:
    w = (k - 0.5) * math.pi
    return math.sqrt(2.0) * F.sin(h / horizon * w) / w


def basis(spark: SparkSession, horizon: int, n_basis: int) -> DataFrame:
    """h, k, phi for h up to the horizon and k up to n_basis: the modes of a Brownian path."""
    hs, ks = spark.range(1, horizon + 1).withColumnRenamed("id", "h"), spark.range(1, n_basis + 1).withColumnRenamed("id", "k")
    return hs.crossJoin(ks).withColumn("phi", basis_value(F.col("h"), F.col("k"), horizon))


def unit(horizon: int, n_basis: int) -> float:
    """The end of a path whose coefficients are all one."""
    return sum(math.sqrt(2.0) * math.sin((k - 0.5) * math.pi) / ((k - 0.5) * math.pi) for k in range(1, n_basis + 1))


def walk_offsets(horizon: int, n_basis: int, quantiles=QUANTILES) -> list[float]:
    """Raw offset of each quantile, such that at the horizon a path lies z(q) deviations of a walk from the median."""
    m = list(quantiles).index(0.5) if 0.5 in quantiles else len(quantiles) // 2
    z, end, out = [abs(z_score(q)) for q in quantiles], unit(horizon, n_basis), []
    for i in range(len(quantiles)):
        inner = z[i - 1] if i > m + 1 else z[i + 1] if i < m - 1 else 0.0
        out.append(0.0 if i == m else inverse_softplus(max(z[i] - inner, 1e-3) / end))
    return out


def ordered(coefficients: DataFrame, *keys: str, quantiles=QUANTILES) -> DataFrame:
    """coef: the median's raw coefficient plus, or less, the softplus of every raw offset from the median outwards.

    This orders coefficients; that paths are ordered too is for ``crossings`` to check.
    """
    m = list(quantiles).index(0.5) if 0.5 in quantiles else len(quantiles) // 2
    whole = Window.partitionBy(*keys, "k")
    median = F.max(F.when(F.col("q") == m, F.col("raw"))).over(whole)
    offset = F.when(F.col("q") == m, 0.0).otherwise(softplus(F.col("raw")))
    upper = F.sum(F.when(F.col("q") > m, offset).otherwise(0.0)).over(whole.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    lower = F.sum(F.when(F.col("q") < m, offset).otherwise(0.0)).over(whole.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, 0))
    return coefficients.withColumn("coef", median + F.when(F.col("q") > m, upper).otherwise(-lower))


def paths(coefficients: DataFrame, modes: DataFrame, horizon: int, *keys: str) -> DataFrame:
    """keys, q, h, path: coefficients against the basis, times the walk's deviation at the horizon (column sig).

    The basis is a table of horizon x n_basis rows, fixed by the model, and broadcast.
    """
    scale = at_least(F.col("sig"), 1e-8) * math.sqrt(horizon)
    return coefficients.join(F.broadcast(modes), "k").groupBy(*keys, "q", "h").agg(F.sum(F.col("coef") * F.col("phi") * scale).alias("path"))


def ordered_arrays(raw: list[Column], quantiles=QUANTILES) -> Column:
    """``ordered`` on arrays over the modes, one for each quantile: an array of such arrays."""
    m = list(quantiles).index(0.5) if 0.5 in quantiles else len(quantiles) // 2
    out = {m: raw[m]}
    for way in (range(m + 1, len(raw)), range(m - 1, -1, -1)):
        away = None
        for q in way:
            step = F.transform(raw[q], softplus)
            away = step if away is None else F.zip_with(away, step, lambda a, b: a + b)
            out[q] = F.zip_with(raw[m], away, (lambda a, b: a + b) if q > m else (lambda a, b: a - b))
    return F.array(*(out[q] for q in range(len(raw))))


def walk_arrays(cursors: DataFrame, models: DataFrame, horizon: int, n_basis: int) -> DataFrame:
    """``walk`` as a row a model and cursor, with coef, an ordered array over quantiles of arrays over modes; no shuffle.

    models may have a column ``level`` too, a lead that doesn't depend on the signal.
    """
    offsets, m = walk_offsets(horizon, n_basis), QUANTILES.index(0.5)
    models = models if "level" in models.columns else models.withColumn("level", F.lit(0.0))
    lead = F.concat(F.array(F.col("level") + F.col("drift") * F.col("signal")), F.array_repeat(F.lit(0.0), n_basis - 1))
    raw = [lead if q == m else F.array_repeat(F.lit(offset), n_basis) for q, offset in enumerate(offsets)]
    every = cursors.crossJoin(F.broadcast(models))  # a row for each model, of which there are few
    return every.withColumn("coef", ordered_arrays(raw)).drop("drift", "level", "signal")


def path_arrays(coefficients: DataFrame, horizon: int) -> DataFrame:
    """Rows with coef (quantiles x modes) and sig get paths (quantiles x horizon) in its place: one matrix product a batch."""
    inner = T.ArrayType(T.ArrayType(T.DoubleType()))
    shape = T.StructType([*(f for f in coefficients.schema if f.name != "coef"), T.StructField("paths", inner)])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            outer = batch.column("coef")
            quantiles, modes = len(outer[0]), len(outer[0][0])
            c = outer.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(batch), quantiles, modes)
            w = (np.arange(1, modes + 1) - 0.5) * math.pi
            phi = math.sqrt(2.0) * np.sin(np.arange(1, horizon + 1)[:, None] / horizon * w) / w
            scale = np.maximum(batch.column("sig").to_numpy(zero_copy_only=False), 1e-8) * math.sqrt(horizon)
            paths = (c @ phi.T) * scale[:, None, None]
            ends = lambda n, size: pa.array(np.arange(n + 1, dtype=np.int32) * size)
            lists = pa.ListArray.from_arrays(ends(len(batch), quantiles), pa.ListArray.from_arrays(ends(len(batch) * quantiles, horizon), pa.array(paths.ravel())))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "coef"), lists], names=[f.name for f in shape])

    return coefficients.mapInArrow(run, shape)


def laid_out(forecasts: DataFrame) -> DataFrame:
    """Forecasts with paths as arrays, in long form: q, h and path."""
    rest = [c for c in forecasts.columns if c != "paths"]
    by_quantile = forecasts.select(*rest, F.posexplode("paths").alias("q", "p"))
    return by_quantile.select(*rest, F.col("q").cast("long").alias("q"), F.posexplode("p").alias("h", "path")).withColumn("h", (F.col("h") + 1).cast("long"))


def gathered(forecasts: DataFrame, *keys: str) -> DataFrame:
    """The inverse of ``laid_out``: paths as arrays, from rows of keys, q, h and path."""
    lines = forecasts.groupBy(*keys, "q").agg(F.array_sort(F.collect_list(F.struct("h", "path")))["path"].alias("p"))
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("q", "p")))["p"].alias("paths"))


def prices(path: Column, last: Column) -> Column:
    return last * F.exp(F.greatest(F.least(path, F.lit(0.5)), F.lit(-0.5)))


def crossings(found: DataFrame, *keys: str) -> DataFrame:
    """Points at which a higher quantile's path lies below a lower one's."""
    below = F.lag("path").over(Window.partitionBy(*keys, "h").orderBy("q"))
    return found.withColumn("below", below).where(F.col("path") < F.col("below"))


def tilt(spark: SparkSession, horizon: int, power: float = 0.5) -> DataFrame:
    """h, hw: weights h^(-power / 2), of mean one."""
    raw = spark.range(1, horizon + 1).select(F.col("id").alias("h"), F.pow(1.0 / F.sqrt(F.col("id").cast("double")), F.lit(power)).alias("w"))
    return raw.select("h", (F.col("w") / F.avg("w").over(Window.partitionBy())).alias("hw"))


def walk(cursors: DataFrame, models: DataFrame, horizon: int, n_basis: int) -> DataFrame:
    """Raw coefficients (model, id, t, sig, q, k, raw): walk offsets, and a median led by ``drift`` times the signal.

    cursors: id, t, sig, signal; models: model, drift. Both quantiles and modes are constants of the plan.
    """
    offsets = walk_offsets(horizon, n_basis)
    m = QUANTILES.index(0.5)
    every = cursors.crossJoin(F.broadcast(models))  # a row for each model, of which there are few
    spread = every.withColumn("q", F.explode(F.array(*(F.lit(i).cast("long") for i in range(len(QUANTILES)))))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_basis).cast("long"))))
    lead = F.when(F.col("k") == 1, F.col("drift") * F.col("signal")).otherwise(0.0)
    return spread.withColumn("raw", F.when(F.col("q") == m, lead).otherwise(F.element_at(F.array(*map(F.lit, offsets)), F.col("q").cast("int") + 1)))


def recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RECIPES.items()], RECIPE_COLUMNS)


def population(spark: SparkSession, n: int) -> DataFrame:
    """A recipe for each of n members; the names of later rounds end in their number."""
    rows = [(i, (key := POPULATION[i % len(POPULATION)]) + ("" if i < len(POPULATION) else str(i // len(POPULATION))), *RECIPES[key][:4]) for i in range(n)]
    return spark.createDataFrame(rows, "member int, name string, width int, layers int, heads int, n_basis int")

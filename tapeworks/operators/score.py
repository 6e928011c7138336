"""Forecasts against what happened: losses, scores over time, scorecards, and frames of a replay.

Forecasts are rows of model, symbol, id, t, sig and paths (an array over quantiles of arrays over the horizon); the truth is rows
of symbol, id and an array over the horizon. Each meeting of the two is one row, whose sums are made from arrays in one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.around import slices
from tapeworks.operators.forecast import QUANTILES, prices
from tapeworks.operators.recurrence import looking_back, numbered, so_far, trailing_mean
from tapeworks.operators.select import median
from tapeworks.sources.files import kept

MEDIAN = QUANTILES.index(0.5)
# fixed values: weights of the loss terms and the horizons of the directional one
WEIGHTS = {"quantile": 1.0, "huber": 1.0, "direction": 0.15, "stability": 0.35, "smooth": 0.02}
DIRECTIONS = (60, 300, 900, 1500)


def arrays(column: pa.Array, rows: int) -> np.ndarray:
    """A column of lists, of one length each, as an array with a row for each list."""
    while pa.types.is_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).reshape(rows, -1)


def pinned(batch: pa.RecordBatch, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """paths (rows x quantiles x horizon), truth (rows x horizon), and the scale of each row: the walk's deviation at the horizon."""
    truth = arrays(batch.column("truth"), len(batch))
    horizon = truth.shape[1]
    paths = arrays(batch.column("paths"), len(batch)).reshape(len(batch), -1, horizon)
    return paths, truth, np.maximum(batch.column("sig").to_numpy(zero_copy_only=False), floor) * math.sqrt(horizon)


#: Sums over a row's terms, and the counts that turn them into means.
SUMS = ("quantile", "huber", "turn", "bend", "square", "hit", "change", "points", "bends", "weight", "changes")


def term_sums(shift: int):
    """For mapInArrow over (model, sig, paths, truth, was): ``SUMS`` of each row. was: the paths of the cursor ``shift`` bars before."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            paths, truth, scale = pinned(batch, 1e-8)
            n, _, horizon = paths.shape
            tilt = (1.0 / np.sqrt(np.arange(1, horizon + 1))) ** 0.5
            tilt /= tilt.mean()
            e = (truth[:, None] - paths) / scale[:, None, None]
            q = np.array(QUANTILES)[:, None]
            middle, error = paths[:, MEDIAN], e[:, MEDIAN]
            size = np.abs(error)
            bend = np.diff(middle, 2, axis=1) / scale[:, None]
            # horizons beyond the path all fall on its end
            ends = np.array([min(h, horizon) - 1 for h in DIRECTIONS])
            turn = -4.0 * np.tanh(middle[:, ends] / (scale[:, None] * 0.5)) * np.sign(truth[:, ends])
            was = batch.column("was")
            known = ~was.is_null().to_numpy(zero_copy_only=False)
            change = np.zeros(n)
            if known.any() and shift < horizon:
                before = arrays(was.drop_null(), int(known.sum())).reshape(-1, paths.shape[1], horizon)
                moved = before[:, :, shift:] - before[:, :, shift - 1 : shift]
                change[known] = (((paths[known][:, :, : horizon - shift] - moved) / scale[known, None, None]) ** 2).sum(axis=(1, 2))
            sums = {
                "quantile": (np.maximum(q * e, (q - 1) * e) * tilt).sum(axis=(1, 2)), "huber": (np.where(size <= 1, 0.5 * error**2, size - 0.5) * tilt).sum(axis=1),
                "turn": (np.maximum(turn, 0) + np.log1p(np.exp(-np.abs(turn)))).sum(axis=1), "bend": (bend**2).sum(axis=1), "square": (error**2).sum(axis=1),
                "hit": (np.sign(middle[:, ends]) == np.sign(truth[:, ends])).sum(axis=1).astype(float), "change": change,
                "points": np.full(n, float(horizon)), "bends": np.full(n, float(max(horizon - 2, 0))), "weight": np.full(n, float(len(ends))), "changes": known * float(max(horizon - shift, 0) * paths.shape[1]),
            }
            yield pa.RecordBatch.from_arrays([batch.column("model"), *(pa.array(sums[k]) for k in SUMS)], names=["model", *SUMS])

    return run


def losses(forecasts: DataFrame, truth: DataFrame, horizon: int, shift: int) -> DataFrame:
    """One row for each model: quantile, huber, direction, stability, smooth, loss, nrmse, hit, reward.

    A cursor's predecessor is its symbol's cursor ``shift`` bars before it; where there is none, stability has no term.
    """
    before = forecasts.select("model", "symbol", (F.col("t") + shift).alias("t"), F.col("paths").alias("was"))
    met = forecasts.join(truth.select("symbol", "id", "truth"), ["symbol", "id"]).join(before, ["model", "symbol", "t"], "left").select("model", "sig", "paths", "truth", "was")
    sums = met.mapInArrow(term_sums(shift), "model string, " + ", ".join(f"{k} double" for k in SUMS)).groupBy("model").agg(*(F.sum(k).alias(k) for k in SUMS))
    c = F.col
    means = sums.select(
        "model", (c("quantile") / (c("points") * len(QUANTILES))).alias("quantile"), (c("huber") / c("points")).alias("huber"), (c("turn") / c("weight")).alias("direction"),
        F.when(c("changes") > 0, c("change") / F.greatest("changes", F.lit(1.0))).otherwise(0.0).alias("stability"), (c("bend") / F.greatest("bends", F.lit(1.0)) * horizon).alias("smooth"),
        F.sqrt(c("square") / c("points")).alias("nrmse"), (c("hit") / c("weight")).alias("hit"),
    )
    total = sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    return means.select("model", *WEIGHTS, total.alias("loss"), "nrmse", "hit", (-F.col("nrmse") + 0.5 * (F.col("hit") - 0.5)).alias("reward"))


def errors(batches):
    """For mapInArrow over (model, symbol, t, sig, paths, truth): the errors of the median path."""
    for batch in batches:
        if len(batch):
            paths, truth, scale = pinned(batch, 1e-9)
            middle = paths[:, MEDIAN]
            made = [np.sqrt((((middle - truth) / scale[:, None]) ** 2).mean(axis=1)), np.sqrt(((truth / scale[:, None]) ** 2).mean(axis=1)), middle[:, -1], truth[:, -1], scale]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "symbol", "t")), *map(pa.array, made)], names=["model", "symbol", "t", "nrmse", "flat_nrmse", "end", "true_end", "scale"])


def scores(forecasts: DataFrame, truth: DataFrame, horizon: int, window: int = 60) -> DataFrame:
    """model, symbol, t, nrmse, dir_hit, endpoint, jump, roll_hit, roll_nrmse, acc, roll_acc, skill and flat_nrmse.

    acc is 100 exp(-nrmse). flat_nrmse is what a forecast of no move gets, to compare with. What looks back does so over blocks
    of numbered rows, not over all rows of a model.
    """
    met = forecasts.join(truth.select("symbol", "id", "truth"), ["symbol", "id"]).select("model", "symbol", "t", "sig", "paths", "truth")
    each = numbered(met.mapInArrow(errors, "model string, symbol string, t long, nrmse double, flat_nrmse double, end double, true_end double, scale double"), "model", "symbol")
    found = each.withColumns({"dir_hit": (F.signum("end") == F.signum("true_end")).cast("double"), "endpoint": F.abs(F.col("end") - F.col("true_end")) / F.col("scale")})
    back = {"last_end": lambda order: F.lag("end").over(order), "roll_hit": trailing_mean("dir_hit", window), "roll_nrmse": trailing_mean("nrmse", window)}
    rolled = looking_back(found, max(window - 1, 1), back, "model", "symbol")
    jump = F.coalesce(F.abs(F.col("end") - F.col("last_end")) / F.col("scale"), F.lit(0.0))
    return rolled.select(
        "model", "symbol", "t", "nrmse", "flat_nrmse", "dir_hit", "endpoint", jump.alias("jump"), "roll_hit", "roll_nrmse",
        (100 * F.exp(-F.col("nrmse"))).alias("acc"), (100 * F.exp(-F.col("roll_nrmse"))).alias("roll_acc"), (100 * (1 - F.col("nrmse"))).alias("skill"),
    )


def hits_so_far(found: DataFrame, *keys: str) -> DataFrame:
    """model, t (and keys), n and hit_so_far: the share of hits in all scores of the model up to each."""
    counted = so_far(numbered(found.select("model", *keys, "t", "dir_hit"), "model", *keys), {"hits": "dir_hit"}, "model", *keys)
    return counted.select("model", *keys, "t", (F.col("n") + 1).alias("n"), (F.col("hits") / (F.col("n") + 1)).alias("hit_so_far"))


def scorecard(found: DataFrame) -> DataFrame:
    """One row for each model. The median is selected by counts, so that no task holds a model's column.

    The scores are made once and kept, as the selection reads them several times.
    """
    found = kept(found.select("model", "dir_hit", "nrmse", "endpoint", "acc", "jump"), "scored")
    means = found.groupBy("model").agg(
        F.round(F.avg("dir_hit") * 100, 2).alias("dir_hit_pct"), F.round(F.avg("nrmse"), 4).alias("path_nrmse"), F.round(F.avg("endpoint"), 4).alias("endpoint_nrmse"),
        F.round(F.avg("acc"), 2).alias("accuracy_pct"),
    )
    return means.join(median(found, "jump", "model").select("model", F.round("median", 5).alias("stability_jump_sigma")), "model")


def band(forecasts: DataFrame, lasts: DataFrame) -> DataFrame:
    """symbol, t, h, lower, upper: means over models of the outer quantiles' prices. lasts: symbol, t, price."""
    outer = forecasts.select("symbol", "t", F.posexplode(F.arrays_zip(F.element_at("paths", 1).alias("low"), F.element_at("paths", -1).alias("high"))).alias("h", "p"))
    priced = outer.join(lasts, ["symbol", "t"])
    price = lambda c: F.avg(prices(F.col(f"p.{c}"), F.col("price")))
    return priced.groupBy("symbol", "t", (F.col("h") + 1).cast("long").alias("h")).agg(price("low").alias("lower"), price("high").alias("upper"))


def frames(cursors: DataFrame, tape: DataFrame, forecasts: DataFrame, found: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """The whole record of each frame of a replay, one row a cursor.

    symbol, t, price; past and future (arrays of closes from ``lookback`` bars before, as far as there are, to the cursor, and of the next
    ``horizon``); models, an array by name of (model, path of prices, roll_hit, roll_nrmse, n, hit_so_far); lower and upper, the band as arrays;
    n_past, n_future, y_low, y_high, the bounds of the price axis. found: scores. The band and the models' paths are made in
    one grouped pass over a row a model, and cursors meet the tape once.
    """
    seen = slices(cursors.select("symbol", "t", "id"), tape, -lookback, horizon, ["close"], partial=True)
    # what lies before the cursor is as long as the tape allows
    ends = F.broadcast(tape.groupBy("symbol").agg(F.min("t").alias("first")))  # a row for each symbol
    n_past = F.least(F.col("t") - F.col("first"), F.lit(lookback)).cast("int") + 1
    shown = seen.join(ends, "symbol").withColumn("n_past", n_past).select(
        "symbol", "t", F.element_at("close", F.col("n_past")).alias("price"), F.slice("close", F.lit(1), F.col("n_past")).alias("past"), F.slice("close", F.col("n_past") + 1, F.greatest(F.size("close") - F.col("n_past"), F.lit(0))).alias("future"),
    )
    so_far = hits_so_far(found, "symbol").join(found.select("model", "symbol", "t", "roll_hit", "roll_nrmse"), ["model", "symbol", "t"])
    each = forecasts.select("model", "symbol", "t", F.element_at("paths", MEDIAN + 1).alias("middle"), F.element_at("paths", 1).alias("low"), F.element_at("paths", -1).alias("high")).join(so_far, ["model", "symbol", "t"])
    told = F.array_sort(F.collect_list(F.struct("model", "middle", "low", "high", "roll_hit", "roll_nrmse", "n", "hit_so_far")))  # a row for each model
    drawn = shown.join(each.groupBy("symbol", "t").agg(told.alias("all")), ["symbol", "t"])
    priced = lambda p: F.transform(p, lambda x: prices(x, F.col("price")))
    mean = lambda side: F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.aggregate("all", F.lit(0.0), lambda a, m: a + prices(F.get(m[side], h), F.col("price"))) / F.size("all"))
    models = F.transform("all", lambda m: F.struct(m["model"].alias("model"), priced(m["middle"]).alias("path"), m["roll_hit"].alias("roll_hit"), m["roll_nrmse"].alias("roll_nrmse"), m["n"].alias("n"), m["hit_so_far"].alias("hit_so_far")))
    whole = drawn.select("symbol", "t", "price", "past", "future", models.alias("models"), mean("low").alias("lower"), mean("high").alias("upper"))
    low = F.least(F.array_min("past"), F.array_min("lower"), F.array_min(F.transform("models", lambda m: F.array_min(m["path"]))))
    high = F.greatest(F.array_max("past"), F.array_max("upper"), F.array_max(F.transform("models", lambda m: F.array_max(m["path"]))))
    bounded = whole.withColumns({"__low": low, "__high": high})
    pad = F.greatest((F.col("__high") - F.col("__low")) * 0.10, F.col("price") * 2e-4)
    return bounded.select("symbol", "t", "price", "past", "future", "models", "lower", "upper", F.size("past").alias("n_past"), F.size("future").alias("n_future"), (F.col("__low") - pad).alias("y_low"), (F.col("__high") + pad).alias("y_high"))

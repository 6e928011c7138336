"""Sessions by date and by seed, and snapshots that make scores and frames without a model or the tape."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import context, forecast, grid, replays, score
from tests.tapes import tape

DAY, LENGTH, HORIZON = 1_440, 200, 40


@pytest.fixture(scope="module")
def bars(spark):
    """Five days of minutes for two symbols, and too few of them for a third."""
    frames = [tape(5 * DAY, t0=10 * DAY + 300).assign(symbol="X"), tape(3 * DAY, t0=11 * DAY).assign(symbol="Y"), tape(220, t0=10 * DAY).assign(symbol="Z")]
    return spark.createDataFrame(pd.concat(frames)).withColumn("big", F.floor(F.col("t") / grid.SPAN)).cache()


def bounds(found):
    return {r["symbol"]: (r["start"], r["stop"]) for r in found.collect()}


def test_sessions(bars):
    made = lambda **how: bounds(replays.session(bars, LENGTH, HORIZON, 60, **how))
    first, end = 10 * DAY + 300 + LENGTH + 1, 15 * DAY + 300 - HORIZON
    assert made(hours=2) == {"X": (first, first + 120), "Y": (11 * DAY + LENGTH + 1, 11 * DAY + LENGTH + 121)}
    assert made(day="1970-01-13") == {"X": (12 * DAY, 13 * DAY), "Y": (12 * DAY, 13 * DAY)}
    # a date before full context, and one whose end has no future
    assert made(day="1970-01-11")["X"] == (first, 11 * DAY) and made(day="1970-01-16")["X"] == (15 * DAY, end)
    assert "Y" not in made(day="1970-01-16") and made(day="1999-01-01") == {}
    drawn = [made(seed=s)["X"] for s in range(12)]
    assert drawn == [made(seed=s)["X"] for s in range(12)] and len(set(drawn)) > 2
    assert all(b - a == DAY and first <= a and b <= end and (a % DAY == 0 or a in (first, end - DAY)) for a, b in drawn)
    assert made(seed=1, hours=24 * 30)["X"] == (first, end)  # longer than the tape


@pytest.fixture(scope="module")
def made(spark, bars):
    at = replays.cursors(replays.session(bars, LENGTH, HORIZON, 60, hours=6, day="1970-01-13"), 7)
    models = spark.createDataFrame([("walk", 0.0), ("trend", 0.3)], "model string, drift double")
    seen = at.withColumns({"sig": F.lit(1e-4), "signal": F.pmod(F.col("t"), F.lit(3)) - 1.0})
    return at, bars, forecast.path_arrays(forecast.walk_arrays(seen, models, HORIZON, 4), HORIZON)


def test_snapshot_stands_for_models_and_tape(spark, bars, made, tmp_path):
    at, _, paths = made
    calls = []
    make = lambda: calls.append(1) or made
    for _ in range(2):
        snap = replays.snapshot(spark, str(tmp_path / "s"), make, HORIZON, 90)
    assert len(calls) == 1 and snap.horizon == HORIZON and snap.lookback == 90
    assert snap.bars.count() == 2 * (90 + 51 * 7 + 1 + HORIZON)  # 52 cursors of each symbol
    truth = context.futures(at, grid.projected(bars), HORIZON)
    want = score.scores(paths, truth, HORIZON, 10)
    assert sorted(map(tuple, snap.scores(10).collect())) == sorted(map(tuple, want.collect()))
    frames = score.frames(at, bars, paths, want, 90, HORIZON).orderBy("symbol", "t").toPandas()
    found = snap.frames(10).orderBy("symbol", "t").toPandas()
    assert len(found) == 104 and (found["t"] == frames["t"]).all()
    for c in ("price", "y_low", "y_high", "n_past"):
        assert np.allclose(found[c], frames[c])
    assert all(np.allclose(a, b) for c in ("past", "future", "lower", "upper") for a, b in zip(found[c], frames[c]))
    few = snap.frames(10, stride=5).orderBy("symbol", "t").toPandas()
    want = found[found.groupby("symbol").cumcount() % 5 == 0].reset_index(drop=True)
    assert (few["t"] == want["t"]).all() and [m[0]["n"] for m in few["models"]] == [m[0]["n"] for m in want["models"]]


def test_a_snapshot_cut_short_is_made_anew(spark, made, tmp_path):
    path = str(tmp_path / "s")
    at, bars, paths = made
    paths.limit(3).write.parquet(f"{path}/forecasts")  # no ``about``
    snap = replays.snapshot(spark, path, lambda: made, HORIZON, 90)
    assert snap.forecasts.count() == 208 and snap.truth.count() == 104

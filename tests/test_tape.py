import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import analyser, context, grid
from tapeworks.operators.recurrence import SHORT, Average, averages, lags
from tests.tapes import plain_average, tape


def placed(spark, frame):
    return spark.createDataFrame(frame).withColumn("big", F.floor(F.col("t") / grid.SPAN))


def ordered(df):
    return df.toPandas().sort_values("t").reset_index(drop=True)


@pytest.mark.parametrize(("halflife", "first"), [(10, 0.0), (60, None), (43200, 1.0)])
def test_average_is_the_plain_recursion(spark, halflife, first):
    frame = tape(2 * SHORT + 321, t0=SHORT - 5)
    found = ordered(averages(placed(spark, frame), [Average("y", "close", halflife, first)]))
    want = plain_average(frame["close"].to_numpy(), halflife, first)
    assert np.allclose(found["y"], want, rtol=1e-12)


def test_lags_clamp_to_the_first_price_and_cross_blocks(spark):
    frame = tape(4000, t0=grid.SPAN - 1500)
    found = ordered(lags(placed(spark, frame), "close", [1, 120, 3600]))
    x = frame["close"].to_numpy()
    for k in (1, 120, 3600):
        assert np.array_equal(found[f"lag_{k}"], x[np.maximum(np.arange(len(x)) - k, 0)])


def test_fill_crosses_blocks_and_reaches_back(spark):
    rows = [("A", grid.SPAN - 3, 10.0), ("A", grid.SPAN + 2, 12.0), ("B", grid.SPAN - 1, 5.0)]
    bars = spark.createDataFrame(rows, "symbol string, t long, close double").select("symbol", "t", *(F.col("close").alias(c) for c in grid.PRICES), *(F.lit(1.0).alias(c) for c in ("vol", "qvol", "takerfrac")), F.lit(1).cast("long").alias("ntrades"))
    found = grid.filled(grid.densify(bars, common=True)).orderBy("symbol", "t").toPandas()
    a, b = found[found.symbol == "A"], found[found.symbol == "B"]
    assert a["close"].tolist() == [10.0] * 5 + [12.0] and a["valid"].tolist() == [True] + [False] * 4 + [True]
    assert b["close"].tolist() == [5.0] * 6 and a["vol"].tolist() == [1, 0, 0, 0, 0, 1]


def test_codec_round_trip_and_guard(spark):
    frame = tape(3000, t0=grid.SPAN - 1000)
    for c in grid.PRICES:
        frame[c] = np.rint(frame[c] * 100) / 100
    whole = placed(spark, frame)
    found = ordered(grid.decoded(grid.encoded(whole)))
    for c in grid.PRICES:
        assert np.allclose(found[c], frame[c], atol=1e-9)
    assert np.allclose(found["vol"], frame["vol"], atol=1e-5) and (found["valid"] == frame["valid"]).all()
    with pytest.raises(Exception, match="32 bits"):
        grid.encoded(whole.withColumn("close", F.lit(1e9))).collect()


def test_units_are_told_apart(spark):
    rows = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (1_700_000_000_123_456_789,)], "s long")
    assert [r[0] for r in rows.select(grid.epoch_seconds(F.col("s"))).collect()] == [1_700_000_000] * 4


def test_breaks(spark):
    shards = spark.createDataFrame([("A", 0, 10), ("A", 10, 5), ("A", 16, 4)], "symbol string, t0 long, n long")
    assert [tuple(r) for r in grid.breaks(shards).collect()] == [("A", 10, 5, 16)]


@pytest.fixture(scope="module")
def features(spark):
    frame = tape()
    return frame, ordered(analyser.features(placed(spark, frame)))


def test_features_are_bounded_and_complete(features):
    frame, found = features
    block = found[list(analyser.NAMES)].to_numpy()
    assert block.shape == (len(frame), 59) and np.isfinite(block).all() and np.abs(block).max() <= 8


def test_features_against_plain_formulas(features):
    frame, found = features
    logp = np.log(frame["close"].to_numpy())
    r1 = np.diff(logp, prepend=logp[0])
    sig = np.maximum(np.sqrt(plain_average(r1 * r1, 300, 0.0)), 1e-7)
    assert np.allclose(found["ret_60s_z"], np.clip((logp - logp[np.maximum(np.arange(len(logp)) - 60, 0)]) / (sig * np.sqrt(60)), -8, 8), atol=1e-9)
    lv = np.log1p(frame["vol"].to_numpy())
    slow = plain_average(lv, 3600, 0.0)
    assert np.allclose(found["vol_z"], np.clip((lv - slow) / np.sqrt(np.maximum(plain_average((lv - slow) ** 2, 3600, 0.0), 1e-9)), -8, 8), atol=1e-9)
    assert np.allclose(found["trend_z_300s"], np.clip((logp - plain_average(logp, 300)) / (sig * np.sqrt(300)), -8, 8), atol=1e-7)
    assert np.allclose(found["valid_frac_300s"], plain_average(frame["valid"].to_numpy(float), 300, 1.0))


def test_features_are_causal(spark, features):
    frame, found = features
    later = frame.copy()
    later.loc[6000:, ["close", "high", "low", "qvol"]] *= 1.5
    moved = ordered(analyser.features(placed(spark, later)))
    names = list(analyser.NAMES)
    assert np.abs(moved.loc[:5999, names] - found.loc[:5999, names]).to_numpy().max() < 1e-9


def test_features_over_several_blocks_reach_the_longest_lag(spark):
    frame = tape(2 * grid.SPAN + 50_000, t0=grid.SPAN - 20_000)
    names = ("ret_43200s_tanh", "ret_1s_tanh", "vol_z", "trend_z_43200s", "valid_frac_300s", "signed_vol_3600s", "rsi_900s")
    found = ordered(analyser.features(placed(spark, frame), names=names))
    logp = np.log(frame["close"].to_numpy())
    back = lambda k: logp[np.maximum(np.arange(len(logp)) - k, 0)]
    r1, lv = logp - back(1), np.log1p(frame["vol"].to_numpy())
    sig, slow = np.maximum(np.sqrt(plain_average(r1 * r1, 300, 0.0)), 1e-7), plain_average(lv, 3600, 0.0)
    imb = np.where(frame["vol"] > 0, (frame["takerfrac"] - 0.5) * 2, 0.0)
    up, down = plain_average(np.maximum(r1, 0), 900, 0.0), plain_average(np.maximum(-r1, 0), 900, 0.0)
    want = {
        "ret_43200s_tanh": np.tanh(200 * (logp - back(43_200))), "ret_1s_tanh": np.tanh(200 * r1), "vol_z": (lv - slow) / np.sqrt(np.maximum(plain_average((lv - slow) ** 2, 3600, 0.0), 1e-9)),
        "trend_z_43200s": (logp - plain_average(logp, 43_200)) / (sig * np.sqrt(43_200)), "valid_frac_300s": plain_average(frame["valid"].to_numpy(float), 300, 1.0),
        "signed_vol_3600s": plain_average(imb * lv, 3600, 0.0) / np.sqrt(np.maximum(plain_average((imb * lv) ** 2, 3600, 0.0), 1e-9)), "rsi_900s": (up - down) / np.maximum(up + down, 1e-12),
    }
    for n, x in want.items():
        assert np.abs(found[n] - np.clip(x, -8, 8)).max() < 1e-7, n


def test_two_symbols_keep_apart(spark):
    one, two = tape(400, t0=1000), tape(400, t0=1000, seed=1).assign(symbol="Y")
    logs = grid.projected(placed(spark, pd.concat([one, two])))
    cursors = context.replay_times(logs, 50, 30, 40)
    both = {k: f(cursors, logs) for k, f in (("context", lambda c, x: context.context(c, x, 50)), ("settled", lambda c, x: context.settled(c, x, 30)))}
    for symbol in "XY":
        alone, mine = logs.where(f"symbol = '{symbol}'"), cursors.where(f"symbol = '{symbol}'")
        assert both["context"].where(f"symbol = '{symbol}'").exceptAll(context.context(mine, alone, 50)).count() == 0
        assert both["settled"].where(f"symbol = '{symbol}'").count() == context.settled(mine, alone, 30).count() == 8 * 30
    wide = context.normalised(both["context"], 50, F.lit(1e-4)).groupBy("symbol", "id").count().collect()
    assert len(wide) == 16 and all(r["count"] == 50 for r in wide)


@pytest.mark.parametrize("frame", [tape(1), tape(300).assign(vol=0.0, qvol=0.0), tape(300).assign(close=5.0, high=5.0, low=5.0), tape(50).assign(valid=False)])
def test_features_of_odd_tapes(spark, frame):
    block = ordered(analyser.features(placed(spark, frame)))[list(analyser.NAMES)].to_numpy()
    assert len(block) == len(frame) and np.isfinite(block).all()


def test_context_and_settlement(spark):
    frame = tape(400, t0=1000)
    logs = grid.projected(placed(spark, frame))
    cursors = context.replay_times(logs, 50, 30, 40)
    times = [r["t"] for r in cursors.orderBy("t").collect()]
    assert times == list(range(1051, 1399 - 30 + 1, 40))
    window = context.context(cursors, logs, 50).toPandas()
    logp = np.log(frame["close"].to_numpy())
    for t, rows in window.groupby("t"):
        i = t - 1000
        assert np.allclose(rows.sort_values("pos")["rel"], logp[i - 49 : i + 1] - logp[i]) and rows["pos"].max() == 50
    for t, rows in context.settled(cursors, logs, 30).toPandas().groupby("t"):
        i = t - 1000
        assert np.allclose(rows.sort_values("h")["truth"], logp[i + 1 : i + 31] - logp[i])


def test_a_context_never_sees_the_future(spark):
    frame = tape(300, t0=0)
    moved = frame.copy()
    moved.loc[151:, "close"] *= 2
    cursor = spark.createDataFrame([("X", 150, 1)], "symbol string, t long, id long")
    a, b = (context.context(cursor, grid.projected(placed(spark, f)), 100).orderBy("pos").toPandas() for f in (frame, moved))
    pd.testing.assert_frame_equal(a, b)


def test_pooling_drops_the_newest_remainder(spark):
    rows = spark.createDataFrame([(1, "X", 9, p, float(p)) for p in range(1, 11)], "id long, symbol string, t long, pos long, rel double")
    found = context.pooled(rows, 10, 10, 4, ["rel"]).orderBy("step").collect()
    assert [r["rel"] for r in found] == [2.5, 6.5]

"""What is made block by block against the same over the whole: order statistics, windows, slices and pyramids."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import around, forecast, recurrence, select


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [3.0, 1.0, 2.0], [1.0] * 7, [1.0] * 5 + [2.0] * 5, [float("-inf"), 1.0, 2.0, float("inf")], [0.0, 5e-324, 1e308, -1e308], [float("-inf"), *map(float, range(50))]])
def test_median_of_small_groups(spark, values):
    rows = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("a", float("nan")), ("b", 5.0)], "k string, x double")
    found = {r["k"]: r["median"] for r in select.median(rows, "x", "k", parts=4).collect()}
    assert found == {"a": pytest.approx(float(np.median(values))), "b": 5.0}


def test_median_narrows_to_ties_and_even_counts(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(0, 4, 20_000), np.full(15_001, 0.25)])
    rows = spark.createDataFrame(pd.DataFrame({"k": rng.choice(["a", "b", None], len(x), p=[0.7, 0.2, 0.1]), "x": x})).repartition(4)
    want = rows.groupBy("k").agg(F.median("x").alias("median"))
    assert {tuple(r) for r in select.median(rows, "x", "k", parts=16).collect()} == {tuple(r) for r in want.collect()}
    ranks = select.order_statistics(rows, "x", [F.lit(0), F.floor(F.col("n") * 0.9), F.col("n") - 1])
    assert [r["value"] for r in ranks.orderBy("i").collect()] == [x.min(), np.sort(x)[int(len(x) * 0.9)], x.max()]
    assert select.median(rows.limit(0), "x", "k").count() == 0


def test_windows_by_block_agree_with_windows_over_all(spark, monkeypatch):
    monkeypatch.setattr(recurrence, "ROWS", 50)
    monkeypatch.setattr(recurrence, "SPAN", 700)
    rng = np.random.default_rng(2)
    frame = pd.concat([pd.DataFrame({"m": m, "t": np.sort(rng.choice(5000, n, replace=False)), "x": rng.normal(size=n)}) for m, n in (("a", 730), ("b", 1), ("c", 260))])
    rows = recurrence.numbered(spark.createDataFrame(frame), "m")
    back = {"roll": recurrence.trailing_mean("x", 30), "last": lambda order: F.lag("x").over(order)}
    found = recurrence.so_far(recurrence.looking_back(rows, 29, back, "m"), {"sum": "x"}, "m").toPandas().sort_values(["m", "t"])
    assert len(found) == len(frame)
    for m, rows in found.groupby("m"):
        x = frame[frame.m == m]["x"].reset_index(drop=True)
        assert (rows["n"].to_numpy() == np.arange(len(x))).all()
        assert np.allclose(rows["roll"], x.rolling(30, min_periods=1).mean()) and np.allclose(rows["sum"], x.cumsum())
        assert np.allclose(rows["last"].to_numpy()[1:], x[:-1]) and pd.isna(rows["last"].to_numpy()[0])


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    frame = pd.concat([pd.DataFrame({"symbol": s, "t": np.arange(t0, t0 + n), "x": rng.normal(size=n).cumsum() + 1000, "y": rng.random(n)}) for s, t0, n in (("A", 7000, 9000), ("B", -300, 700))])
    return frame, spark.createDataFrame(frame).repartition(5)


def test_slices_cross_blocks_and_end_with_the_tape(spark, walk):
    frame, tape = walk
    asked = [("A", 7000, 1), ("A", 7199, 2), ("A", 7200, 3), ("A", 14_400, 4), ("A", 15_999, 5), ("A", 20_000, 6), ("B", 0, 7), ("B", 0, 8), ("C", 0, 9)]
    cursors = spark.createDataFrame(asked, "symbol string, t long, id long")
    found = {r["id"]: r for r in around.slices(cursors, tape, -50, 30, ["x", "y"]).collect()}
    assert set(found) == {2, 3, 4, 7, 8}
    partial = {r["id"]: r for r in around.slices(cursors, tape, -50, 30, ["x"], partial=True).collect()}
    for symbol, t, i in asked:
        of = frame[(frame.symbol == symbol) & frame.t.between(t - 50, t + 30)]
        if i in found:
            assert found[i]["x"] == of["x"].tolist() and found[i]["y"] == of["y"].tolist()
        if len(of) and i in partial:
            assert partial[i]["x"] == of["x"].tolist()
    assert {1, 5} <= set(partial)
    holes = tape.where("t != 7300")
    with pytest.raises(Exception, match="every bar once"):
        around.slices(cursors, holes, -50, 30, ["x"]).count()


def test_pyramid_against_means_of_the_laid_out_context(spark, walk):
    frame, tape = walk
    levels, length, patch = ((64, 1), (256, 4), (1000, 16), (5000, 64)), 3000, 4
    cursors = spark.createDataFrame([("A", t, t) for t in (9_998, 9_999, 12_345, 15_999)], "symbol string, t long, id long")
    found = around.pyramid(cursors, tape, length, levels, patch, ["x", "y"]).toPandas()
    assert set(found["id"]) == {9_999, 12_345, 15_999}
    a = frame[frame.symbol == "A"].set_index("t")
    for (i, level), rows in found.sort_values("token").groupby(["id", "level"]):
        span, stride = min(levels[level][0], length), levels[level][1]
        for c in ("x", "y"):
            window = a[c].loc[i - span + 1 : i].to_numpy()
            means = window[: span // stride * stride].reshape(-1, stride).mean(1)
            means = means[-(len(means) // patch * patch) :]
            assert np.allclose(np.concatenate(rows[c].tolist()), means, rtol=0, atol=1e-11) and len(rows) == len(means) // patch
    tokens = [min(span, 43_200) // stride // forecast.PATCH for span, stride in forecast.LEVELS]
    assert tokens == [64, 64, 64, 42]
    with pytest.raises(ValueError, match="no patch"):
        around.pyramid(cursors, tape, 10, ((64, 4),), 16, ["x"])

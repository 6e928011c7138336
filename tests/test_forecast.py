import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clipped, softplus, z_score
from tapeworks.operators import forecast, score


def test_clip_takes_nan_first(spark):
    rows = spark.createDataFrame([(math.nan,), (None,), (math.inf,), (-math.inf,), (9.0,), (1.5,)], "x double")
    assert [r[0] for r in rows.select(clipped(F.col("x"))).collect()] == [0, 0, 8, -8, 8, 1.5]


def test_softplus_does_not_overflow(spark):
    found = [r[0] for r in spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(softplus(F.col("x"))).collect()]
    assert found == pytest.approx([0.0, math.log(2), 800.0])


def test_basis(spark):
    found = forecast.basis(spark, 1500, 24).toPandas().pivot(index="h", columns="k", values="phi").to_numpy()
    assert np.abs(found[0]).max() < 1e-2
    gram = found.T @ found / 1500
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-3
    rough = (np.diff(found, 2, axis=0) ** 2).sum(0) / (found**2).sum(0)
    assert (np.diff(rough) > 0).all()
    assert found[-1].sum() == pytest.approx(forecast.unit(1500, 24))


@pytest.fixture(scope="module")
def walked(spark):
    cursors = spark.createDataFrame([("X", i, 100 + 10 * i, 1e-4 * (i + 1), 0.5) for i in range(4)], "symbol string, id long, t long, sig double, signal double")
    models = spark.createDataFrame([("walk", 0.0), ("lead", 0.3)], "model string, drift double")
    raw = forecast.ordered(forecast.walk(cursors, models, 300, 12), "model", "id")
    return forecast.paths(raw, forecast.basis(spark, 300, 12), 300, "model", "symbol", "id", "t", "sig").cache()


def test_arrays_agree_with_the_long_form(spark, walked):
    cursors = walked.where("q = 1 and h = 1 and model = 'walk'").select("symbol", "id", "t", "sig", F.lit(0.5).alias("signal"))
    models = spark.createDataFrame([("walk", 0.0), ("lead", 0.3)], "model string, drift double")
    wide = forecast.path_arrays(forecast.walk_arrays(cursors, models, 300, 12), 300)
    keys = ["model", "symbol", "id", "q", "h"]
    found = forecast.laid_out(wide).toPandas().sort_values(keys).reset_index(drop=True)
    want = walked.toPandas().sort_values(keys).reset_index(drop=True)
    assert len(found) == len(want) == 2 * 4 * 3 * 300 and np.allclose(found["path"], want["path"], rtol=0, atol=1e-15)
    back = forecast.gathered(walked, "model", "symbol", "id", "t", "sig").toPandas()
    assert all(len(p) == 3 and len(p[0]) == 300 for p in back["paths"])
    five = spark.createDataFrame([([0.3], [-1.0], [2.0], [0.5], [1.0])], "a array<double>, b array<double>, c array<double>, d array<double>, e array<double>")
    made = five.select(forecast.ordered_arrays([F.col(c) for c in "abcde"], (0.05, 0.25, 0.5, 0.75, 0.95)).alias("x")).first()["x"]
    sp = lambda x: math.log1p(math.exp(x))
    assert [x[0] for x in made] == pytest.approx([2 - sp(-1) - sp(0.3), 2 - sp(-1), 2.0, 2 + sp(0.5), 2 + sp(0.5) + sp(1.0)])


def test_walk_is_calibrated_and_anchored(walked):
    found = walked.where("model = 'walk'").toPandas()
    end = found[found.h == 300].pivot(index="id", columns="q", values="path")
    sig = found.groupby("id")["sig"].first()
    assert np.abs(end[1]).max() == 0
    assert np.allclose(end[2], z_score(0.9) * sig * math.sqrt(300)) and np.allclose(end[0], -end[2])
    start = found[found.h == 1].pivot(index="id", columns="q", values="path")
    assert (np.abs(start[2]) < 0.1 * end[2]).all()
    assert forecast.crossings(walked, "model", "id").count() == 0


def test_quantile_order_runs_outwards(spark):
    rows = spark.createDataFrame([(1, q, 1, float(r)) for q, r in enumerate([0.3, -1.0, 2.0, 0.5, 1.0])], "id long, q long, k long, raw double")
    found = [r["coef"] for r in forecast.ordered(rows, "id", quantiles=(0.05, 0.25, 0.5, 0.75, 0.95)).orderBy("q").collect()]
    sp = lambda x: math.log1p(math.exp(x))
    assert found == pytest.approx([2 - sp(-1) - sp(0.3), 2 - sp(-1), 2.0, 2 + sp(0.5), 2 + sp(0.5) + sp(1.0)])


def test_stability_is_zero_for_forecasts_that_agree(spark):
    rng, horizon, shift = np.random.default_rng(0), 60, 10
    tape = np.cumsum(rng.normal(0, 1e-4, 400))
    rows = [("m", s, i, 10 * i, 2e-4, q, h, float(tape[10 * i + h] - tape[10 * i]) * (1 + q)) for s in "AB" for i in range(20) for q in range(3) for h in range(1, horizon + 1)]
    paths = spark.createDataFrame(rows, "model string, symbol string, id long, t long, sig double, q long, h long, path double")
    wide = forecast.gathered(paths, "model", "symbol", "id", "t", "sig")
    truth = wide.select("symbol", "id", F.transform(F.element_at("paths", 2), lambda x: x / 2).alias("truth"))
    found = score.losses(wide, truth, horizon, shift).first()
    alone = score.losses(wide.where("id % 2 = 0"), truth, horizon, shift).first()  # no cursor has its predecessor
    assert alone["stability"] == 0
    assert found["stability"] == pytest.approx(0, abs=1e-20) and found["hit"] == 1.0
    assert found["reward"] == pytest.approx(-found["nrmse"] + 0.25)


def test_scores_against_numpy(spark, walked):
    rng = np.random.default_rng(3)
    paths = walked.toPandas()
    truth = pd.DataFrame([(i, h) for i in range(4) for h in range(1, 301)], columns=["id", "h"])
    truth["truth"] = rng.normal(0, 1e-3, len(truth))
    wide = forecast.gathered(walked, "model", "symbol", "id", "t", "sig")
    real = spark.createDataFrame([("X", i, [float(x) for x in rows["truth"]]) for i, rows in truth.groupby("id")], "symbol string, id long, truth array<double>")
    scored = score.scores(wide, real, 300, 3).cache()
    found = scored.toPandas().sort_values(["model", "t"])
    for model, rows in found.groupby("model"):
        med = paths[(paths.model == model) & (paths.q == 1)].pivot(index="id", columns="h", values="path").to_numpy()
        real = truth.pivot(index="id", columns="h", values="truth").to_numpy()
        scale = np.maximum(np.array([1e-4 * (i + 1) for i in range(4)]) * math.sqrt(300), 1e-9)
        nrmse = np.sqrt((((med - real) / scale[:, None]) ** 2).mean(1))
        assert np.allclose(rows["nrmse"], nrmse) and np.allclose(rows["acc"], 100 * np.exp(-nrmse))
        assert np.allclose(rows["dir_hit"], np.sign(med[:, -1]) == np.sign(real[:, -1]))
        jump = np.r_[0, np.abs(np.diff(med[:, -1])) / scale[1:]]
        assert np.allclose(rows["jump"], jump)
        assert np.allclose(rows["roll_nrmse"], [nrmse[max(0, i - 2) : i + 1].mean() for i in range(4)])
    card = {r["model"]: r for r in score.scorecard(scored).collect()}
    assert set(card) == {"walk", "lead"} and all(card[m]["stability_jump_sigma"] == pytest.approx(round(float(np.median(rows["jump"])), 5)) for m, rows in found.groupby("model"))


def test_losses_with_four_directions_against_numpy(spark):
    rng, horizon, shift = np.random.default_rng(5), 1500, 600
    paths, truth, sig = rng.normal(0, 1e-3, (6, 3, horizon)).cumsum(2), rng.normal(0, 1e-3, (6, horizon)).cumsum(1), rng.uniform(1e-4, 1e-3, 6)
    rows = [("m", "X", i, i * shift, float(sig[i]), paths[i].tolist()) for i in range(6)]
    wide = spark.createDataFrame(rows, "model string, symbol string, id long, t long, sig double, paths array<array<double>>")
    found = score.losses(wide, spark.createDataFrame([("X", i, truth[i].tolist()) for i in range(6)], "symbol string, id long, truth array<double>"), horizon, shift).first()
    scale = sig[:, None] * math.sqrt(horizon)
    e, mid, q = (truth[:, None] - paths) / scale[:, None], paths[:, 1], np.array([0.1, 0.5, 0.9])[:, None]
    hw = np.arange(1, horizon + 1) ** -0.25
    hw /= hw.mean()
    at = np.array([60, 300, 900, 1500]) - 1
    turn = np.logaddexp(0, -np.tanh(mid[:, at] / (0.5 * scale)) * np.sign(truth[:, at]) * 4)
    hit = (np.sign(mid[:, at]) == np.sign(truth[:, at])).mean()
    moved = paths[:-1, :, shift:] - paths[:-1, :, shift - 1 : shift]
    want = {
        "quantile": (np.maximum(q * e, (q - 1) * e) * hw).mean(), "huber": (np.where(abs(e[:, 1]) <= 1, e[:, 1] ** 2 / 2, abs(e[:, 1]) - 0.5) * hw).mean(), "direction": turn.mean(), "hit": hit,
        "smooth": ((np.diff(mid, 2, axis=1) / scale) ** 2).mean() * horizon, "nrmse": np.sqrt((e[:, 1] ** 2).mean()), "stability": (((paths[1:, :, :-shift] - moved) / scale[1:, None]) ** 2).mean(),
    }
    assert {k: found[k] for k in want} == pytest.approx(want)
    assert 0 < hit < 1 and found["loss"] == pytest.approx(want["quantile"] + want["huber"] + 0.15 * want["direction"] + 0.35 * want["stability"] + 0.02 * want["smooth"])


def test_population_names(spark):
    names = [r["name"] for r in forecast.population(spark, 6).orderBy("member").collect()]
    assert names == ["base", "deep", "wide", "agile", "base1", "deep1"]

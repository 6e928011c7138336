"""Whole runs: candles to shards to features, and a replay at the full horizon with all four directional ones."""

import pytest

from tapeworks import __main__ as runs
from tapeworks.operators import analyser, replays
from tapeworks.sources import shards, store


@pytest.fixture(scope="module")
def smoked(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("smoke")
    return folder, runs.smoke(spark, str(folder)).collect()


def test_smoke_packs_materialises_trains_and_replays(spark, smoked):
    tmp_path, card = smoked[0], {r["model"]: r for r in smoked[1]}
    assert set(card) == {"walk", "trend", "fade", "learnt"} and all(r["path_nrmse"] > 0 and 0 <= r["dir_hit_pct"] <= 100 for r in card.values())
    bars = shards.read(spark, f"{tmp_path}/shards")
    assert bars.count() == 20_000 and bars.where("not valid").count() == 400
    found = store.load(spark, f"{tmp_path}/features", 1, 1_700_010_000, 1_700_010_100)
    assert found.count() == 100 and set(analyser.NAMES) <= set(found.columns)
    frames = spark.read.parquet(f"{tmp_path}/shown/frames").orderBy("t").collect()
    assert [r["t"] for r in frames] == [1_700_004_001 + 2_000 * i for i in range(8)]  # 20 000 less a context of 4 001 and a future of 1 500
    assert all(r["n_past"] == 601 and r["n_future"] == 1_500 and [m["model"] for m in r["models"]] == ["fade", "learnt", "trend", "walk"] for r in frames)
    assert spark.read.json(f"{tmp_path}/shown/scorecard").count() == 4

    # learnt anew from the same shards: no example is new, no version follows
    again = runs.train(spark, f"{tmp_path}/shards", f"{tmp_path}/learnt", length=4_000, stride=500, batches=3)
    assert again.select("batch").distinct().count() == 3 and again.agg({"n": "max"}).first()[0] == 29


def test_a_snapshot_is_opened_without_shards_and_sessions_are_named(spark, smoked, monkeypatch):
    tmp_path = smoked[0]
    card = runs.replay(spark, "nowhere", f"{tmp_path}/replay")
    assert card.count() == 4
    drawn = [runs.replay(spark, f"{tmp_path}/shards", f"{tmp_path}/{n}", length=4_000, stride=600, hours=1, **how) for n, how in (("d", {"day": "2023-11-15"}), ("s", {"seed": 3}))]
    assert all(c.count() == 3 for c in drawn)
    at = [r["t"] for r in replays.load(spark, f"{tmp_path}/d").truth.where("symbol = 'ALL'").orderBy("t").collect()]
    assert at == [1_700_006_400 + 600 * i for i in range(6)]  # midnight in UTC, for an hour

    asked = {}
    monkeypatch.setattr("sys.argv", ["tapeworks", "replay", "a", "b", "--day", "2023-11-15", "--hours", "2", "--stride", "5"])

    def replay(spark, folder, snapshot, hours=24.0, day=None, seed=None, stride=20):
        asked.update(folder=folder, snapshot=snapshot, hours=hours, day=day, seed=seed, stride=stride)
        return spark.range(1)

    monkeypatch.setattr(runs, "replay", replay)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    runs.main()
    assert asked == {"folder": "a", "snapshot": "b", "hours": 2.0, "day": "2023-11-15", "seed": None, "stride": 5}

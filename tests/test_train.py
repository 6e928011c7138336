"""Learning as the stream goes, against NumPy, and a listener's counts against the rows."""

import numpy as np
import pandas as pd
import pytest

from tapeworks.streaming import train
from tapeworks.streaming.queries import drained


def test_coefficients_and_their_average_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(6)
    parts = [pd.DataFrame({"symbol": "X", "t": np.arange(i, i + n), "x": (x := rng.normal(size=n)), "y": 0.2 - 0.7 * x + rng.normal(0, 0.1, n)}) for i, n in enumerate((30, 1, 200, 77))]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts[:3]):
        part.to_parquet(tmp_path / "in" / f"{i}.parquet", index=False)
    stream = lambda: spark.readStream.schema("symbol string, t long, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    train.learnt(stream(), str(tmp_path / "run"))
    parts[3].to_parquet(tmp_path / "in" / "3.parquet", index=False)
    found = train.learnt(stream(), str(tmp_path / "run")).orderBy("batch").toPandas()  # goes on where it ended
    assert found["batch"].tolist() == [0, 1, 2, 3] and found["n"].iloc[-1] == 308
    # files of one trigger come in any order; a version's sums tell which it has seen
    seen, mean = set(), None
    for _, v in found.iterrows():
        new = next(i for i, p in enumerate(parts) if i not in seen and sum(len(parts[k]) for k in seen | {i}) == v["n"])
        seen.add(new)
        rows = pd.concat([parts[i] for i in seen])
        a = np.stack([np.ones(len(rows)), rows["x"]], axis=1)
        want = np.linalg.solve(a.T @ a + train.RIDGE * np.eye(2), a.T @ rows["y"])
        mean = want if mean is None else train.DECAY * mean + (1 - train.DECAY) * want
        assert [v["level"], v["drift"]] == pytest.approx(list(want)) and [v["mean_level"], v["mean_drift"]] == pytest.approx(list(mean))
    assert found["drift"].iloc[-1] == pytest.approx(-0.7, abs=0.05)


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    rows = spark.createDataFrame([("X", 1, 1.0, 2.0), ("X", 2, -1.0, 0.5)], "symbol string, t long, x double, y double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    first = train.learnt(stream(), str(tmp_path / "run")).collect()
    (tmp_path / "run" / "state" / "commits" / "0").unlink()  # the batch was lost before it was noted
    for crc in (tmp_path / "run" / "state" / "commits").glob(".*"):
        crc.unlink()
    assert train.learnt(stream(), str(tmp_path / "run")).collect() == first and first[0]["n"] == 2


def test_counters_add_up_to_the_rows(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10 + i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with train.Counters(spark, str(tmp_path / "counters")) as counters:
        drained(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    found = counters.rows().where("rows > 0").toPandas()
    assert sorted(found["rows"]) == [10, 11, 12] and (found["done"] > 0).all() and found["batch"].is_unique

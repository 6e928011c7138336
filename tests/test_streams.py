import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeworks.operators import analyser as batch
from tapeworks.operators import grid
from tapeworks.streaming import analyser
from tapeworks.streaming.queries import drained
from tests.tapes import tape


def test_stream_agrees_with_batch_over_several_batches_out_of_order(spark, tmp_path):
    frame = tape(1500, t0=5_000).assign(ntrades=lambda f: f.ntrades.astype(float))
    frame = frame.drop(index=[700, 701, 702]).drop(columns="valid")
    for i, part in enumerate(np.array_split(frame, 3)):
        part.sample(frac=1, random_state=i).to_parquet(tmp_path / f"{i}.parquet")
    late = frame.iloc[[3]].assign(close=1.0)
    late.to_parquet(tmp_path / "3.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = drained(analyser.features(stream, 1)).toPandas().sort_values("t").reset_index(drop=True)
    bars = spark.createDataFrame(frame).withColumn("ntrades", F.col("ntrades").cast("long"))
    want = batch.features(grid.filled(grid.densify(bars))).toPandas().sort_values("t").reset_index(drop=True)
    assert len(found) == 1500 and (found["t"] == want["t"]).all()
    assert (found["valid"] == want["valid"]).all() and (~found["valid"]).sum() == 3
    assert np.abs(found[list(batch.NAMES)] - want[list(batch.NAMES)]).to_numpy().max() < 1e-9


def test_gaps_and_repeats_in_order():
    bars = pd.DataFrame({"t": [5, 3, 3], "open": 1.0, "high": 1.0, "low": 1.0, "close": [2.0, 1.0, 1.5], "vol": 1.0, "qvol": 1.0, "ntrades": 1.0, "takerfrac": 0.5})
    found = analyser.dense(bars, None, None)
    assert found["t"].tolist() == [3, 4, 5] and found["close"].tolist() == [1.5, 1.5, 2.0] and found["valid"].tolist() == [True, False, True]
    assert analyser.dense(bars, 4, 1.5)["t"].tolist() == [5]


def test_panel_closes_bars_and_fills_gaps_over_several_batches(spark, tmp_path, monkeypatch):
    """Three symbols, one of which falls silent; ticks out of order in a batch; late ticks. Against the batch rows."""
    from tapeworks.streaming import panel
    from tapeworks.streaming.queries import stored_in_rocks

    rng = np.random.default_rng(4)
    n, t0 = 900, 1_700_000_000 - 1_700_000_000 % 60
    at = np.sort(rng.integers(0, 40 * 3600, n))
    kind = np.where(at > 20 * 3600, rng.choice(["view", "purchase"], n), rng.choice(["view", "purchase", "click"], n))
    frame = pd.DataFrame({"event_id": np.arange(n), "ts": pd.to_datetime((t0 + at) * 1_000_000 + rng.integers(0, 1_000_000, n), unit="us").astype("datetime64[us]"), "event_type": kind, "value": rng.random(n).round(2) * 100})
    for i, part in enumerate(np.array_split(frame, 4)):
        part.sample(frac=1, random_state=i).to_parquet(tmp_path / f"{i}.parquet", index=False)
    frame.iloc[:3].assign(value=9e3, event_id=[5000, 5001, 5002]).to_parquet(tmp_path / "4.parquet", index=False)  # far too late
    schema = spark.read.parquet(str(tmp_path)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    with stored_in_rocks(spark):
        found = drained(panel.features(panel.ticks(stream))).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    last = (int(t0 + at[-1]) - 600) // 60 - 1
    rows = spark.createDataFrame(frame).select(F.col("event_type").alias("symbol"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("t"), F.struct("ts", "event_id").alias("at"), (F.col("value") + 1000.0).alias("price"), F.col("value").alias("size"), F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("taker"))
    bars = grid.bars(rows.where(F.col("t") <= last))
    ends = bars.select("symbol").distinct().withColumn("t", F.lit(last).cast("long"))
    whole = grid.filled(grid.densify(bars.unionByName(ends.join(bars.select("symbol", "t"), ["symbol", "t"], "left_anti"), allowMissingColumns=True)))
    want = batch.features(whole, F.col("t") * 60).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    assert len(found) == len(want) and (found[["symbol", "t"]].to_numpy() == want[["symbol", "t"]].to_numpy()).all()
    assert set(found.groupby("symbol")["t"].max()) == {last} and (found["valid"] == want["valid"]).all()
    assert np.abs(found[list(batch.NAMES)] - want[list(batch.NAMES)]).to_numpy().max() < 1e-6


def test_panel_keeps_chunks_that_lags_reach_and_no_others(monkeypatch):
    from tapeworks.streaming import panel

    monkeypatch.setattr(panel, "KEPT", 300)
    monkeypatch.setattr(panel, "CHUNK", 100)

    class Value:
        def __init__(self):
            self.x = None

        def update(self, x):
            self.x = x

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    held = panel.Panel(60)
    held.last, held.logs = Value(), Map()
    x = np.arange(2000.0)
    for a, b in ((0, 10), (10, 450), (450, 451), (451, 1900), (1900, 2000)):
        held.keep(50 + a, x[a:b], (50 + b - 1, 1.0, [0.5], None))
        parts = np.concatenate([np.frombuffer(raw) for _, (_, raw) in sorted(held.logs.items())])
        assert (parts[-300:] == x[max(0, b - 300) : b]).all() and len(parts) <= 500


def test_ticks_become_bars_before_they_meet_by_symbol(spark, tmp_path):
    from tapeworks.streaming import panel
    from tapeworks.streaming.queries import stored_in_rocks

    n = 30_000
    at = np.sort(np.random.default_rng(5).integers(0, 3600, n))
    pd.DataFrame({"event_id": np.arange(n), "ts": pd.to_datetime(1_700_000_040 + at, unit="s").astype("datetime64[us]"), "event_type": "view", "value": 1.0}).to_parquet(tmp_path / "0.parquet", index=False)
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).parquet(str(tmp_path))
    with stored_in_rocks(spark):
        query = panel.features(panel.ticks(stream)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    # the panel is told first: it keeps the last bar and one chunk or two of log prices of the symbol, and met bars, not ticks
    most = [max(op["numRowsUpdated"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert len(most) and max(most) <= 61


def test_blocks_of_a_panel_give_the_features_of_the_whole(monkeypatch):
    """Bars out of order with gaps in several batches and small blocks, against one block."""
    import pyarrow as pa

    from tapeworks.streaming import panel

    monkeypatch.setattr(panel, "AT_ONCE", 70)

    class Value:
        x = None
        exists, get, update = lambda s: s.x is not None, lambda s: s.x, lambda s, x: setattr(s, "x", x)

    class Map(dict):
        containsKey, getValue, updateValue, removeKey, iterator = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__, dict.items

    class Clock:
        def __init__(self, t):
            self.getCurrentWatermarkInMs = lambda: (t + 1) * 60_000

        registered = []
        registerTimer = registered.append

    frame = tape(600, t0=1_000).drop(columns=["symbol", "valid"]).astype({"ntrades": float}).drop(index=[5, 6, 299, 300, 301, 599])
    held = panel.Panel(60)
    held.last, held.logs, held.handle = Value(), Map(), Clock
    out = []
    for a, b in ((0, 200), (200, 301), (301, 600)):
        part = frame[(frame["t"] >= 1_000 + a) & (frame["t"] < 1_000 + b)].sample(frac=1, random_state=1)
        out += list(held.handleInputRows(("X",), iter(np.array_split(part, 3)), Clock(999 + b)))
    assert Clock.registered == [(1_200 + 1) * 60_000 - 1] and len(out) == 3 + 2 + 5
    found = pd.concat(pa.Table.from_batches([x]).to_pandas() for x in panel.block_features(60)(pa.RecordBatch.from_pandas(x, preserve_index=False) for x in out))
    want, _ = analyser.advance(pd.concat([frame, frame.tail(1).assign(**dict.fromkeys(frame.columns.drop("t"), np.nan), t=1_599)]), None, 60)
    assert found["t"].tolist() == want["t"].tolist() == list(range(1_000, 1_600)) and (found["valid"].to_numpy() == want["valid"].to_numpy()).all()
    assert np.abs(found[list(batch.NAMES)].to_numpy() - want[list(batch.NAMES)].to_numpy()).max() < 1e-9

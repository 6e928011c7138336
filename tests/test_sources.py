import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import grid
from tapeworks.sources import klines, shards, store
from tests.tapes import tape

LINE = "{t},10.126,11.0,9.5,10.5,{v},0,21.0,4,{b},0,0\n"


def test_candles_from_csv_and_zip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("open_time,open,high,low,close,volume,x,qv,n,tb,y,z\n" + LINE.format(t=1_700_000_000_000, v=2.0, b=0.5) + LINE.format(t=1_700_000_001_000, v=0.0, b=0.0))
    (tmp_path / "b.csv").write_text(LINE.format(t=1_700_000_001_000_000, v=4.0, b=9.0))
    found = klines.read_csv(spark, str(tmp_path / "*.csv")).orderBy("t").collect()
    assert [(r["t"], r["vol"], r["takerfrac"]) for r in found] == [(1_700_000_000, 2.0, pytest.approx(0.25, abs=1e-5)), (1_700_000_001, 4.0, 1.0)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        out.write(tmp_path / "a.csv", "a.csv")
    zipped = klines.read_zip(spark, str(tmp_path / "a.zip")).orderBy("t").collect()
    assert [r["t"] for r in zipped] == [1_700_000_000, 1_700_000_001] and zipped[0]["open"] == 10.13


def test_a_file_has_one_unit_which_its_first_stamp_tells(spark, tmp_path):
    """Around the size that parts seconds from milliseconds, and in a folder that Spark partitions and names with a space."""
    line = lambda t: LINE.format(t=t, v=1.0, b=0.5)
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "ms.csv").write_text("\n" + line(100_000_001_000) + line(99_999_999_000) + line(99_999_998_999))
    (folder / "us.csv").write_text("open_time,open\n" + line(1_700_000_000_000_000))
    (folder / "ns.csv").write_text(line(1_700_000_001_000_000_000))
    (folder / "s.csv").write_text(line(1_700_000_002) + line(100_000_001_000))
    (folder / "none.csv").write_text("open_time,open\n")
    (folder / "empty.csv").write_text("")
    want = [99_999_998, 99_999_999, 100_000_001, 1_700_000_000, 1_700_000_001, 1_700_000_002, 100_000_001_000]
    for paths in (str(folder), str(folder / "*.csv"), [str(folder / f"{n}.csv") for n in ("ms", "us", "ns", "s", "none")]):
        assert [r["t"] for r in klines.read_csv(spark, paths).orderBy("t").collect()] == want
    assert {r["file"].rsplit("/", 1)[1]: r["unit"] for r in klines.units(spark, str(folder)).collect()} == {"ms.csv": 1000, "us.csv": 10**6, "ns.csv": 10**9, "s.csv": 1}
    with zipfile.ZipFile(tmp_path / "ms.zip", "w") as out:
        out.writestr("ms.csv", line(100_000_001_000) + line(99_999_999_000))
    assert [r["t"] for r in klines.read_zip(spark, str(tmp_path / "ms.zip")).orderBy("t").collect()] == [99_999_999, 100_000_001]


def test_shards_round_trip_range_and_columns(spark, tmp_path):
    frame = tape(5000, t0=7_000)
    for c in grid.PRICES:
        frame[c] = np.rint(frame[c] * 100) / 100
    made = shards.write(spark.createDataFrame(frame), str(tmp_path / "s"), 2000).orderBy("t0").toPandas()
    assert made["n"].tolist() == [1000, 2000, 2000] and (made["status"] == "ok").all()
    assert (shards.write(spark.createDataFrame(frame), str(tmp_path / "s"), 2000).toPandas()["status"] == "cached").all()
    back = shards.read(spark, str(tmp_path / "s")).orderBy("t").toPandas()
    assert np.allclose(back[list(grid.PRICES)], frame[list(grid.PRICES)]) and (back["valid"] == frame["valid"]).all()
    assert np.allclose(back["vol"], frame["vol"], atol=1e-5) and (back["ntrades"] == frame["ntrades"]).all()
    part = shards.read(spark, str(tmp_path / "s"), ["close", "valid"]).where("t >= 9500 and t < 9600")
    assert part.columns == ["symbol", "t", "close", "valid"] and part.count() == 100 and part.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="magic"):
        for f in (tmp_path / "s").glob("*.index.json"):
            f.unlink()
        shards.read(spark, str(tmp_path / "s"), magic="OTHERS").count()
    assert shards.totals(spark.createDataFrame(made)).first()["shards"] == 3


def whole_cents(frame):
    for c in grid.PRICES:
        frame[c] = np.rint(frame[c] * 100) / 100
    return frame


def test_filters_open_only_the_shards_they_meet(spark, tmp_path):
    """Shards outside the filter are spoilt: opening one would fail. Without an index, headers are read instead."""
    folder = tmp_path / "s"
    for symbol in ("X", "Y"):
        shards.write(spark.createDataFrame(whole_cents(tape(6000, t0=0)).assign(symbol=symbol)), str(folder), 1000)
    spoilt = [f for f in folder.glob("*.shard") if f.name not in ("X-000000000002.shard", "X-000000000003.shard")]
    assert len(spoilt) == 10
    for f in spoilt:
        f.write_bytes(b"?" * f.stat().st_size)
    found = shards.read(spark, str(folder)).where("symbol = 'X' and t >= 2900 and t < 3100")
    assert found.count() == 200 and found.rdd.getNumPartitions() == 2
    assert shards.read(spark, str(folder)).where("symbol in ('X') and t in (2000, 3999)").select("t", "close").count() == 2
    assert shards.read(spark, str(folder)).where("symbol = 'X' and t > 2999 and t <= 3000").count() == 1
    assert shards.read(spark, str(folder)).where("symbol = 'Z'").count() == 0
    with pytest.raises(Exception, match="magic"):
        shards.read(spark, str(folder)).where("t >= 2900 and t < 3100").count()  # Y's shards are met too


def test_headers_are_opened_only_where_no_index_knows_a_shard(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    folder = tmp_path / "s"
    shards.write(spark.createDataFrame(whole_cents(tape(3000, t0=0))), str(folder), 1000)
    (folder / "X-000000000009.shard").write_bytes(shards.encode(whole_cents(tape(1000, t0=9000))))  # by another writer
    opened, real = [], shards.read_header
    monkeypatch.setattr(shards, "read_header", lambda *a: opened.append(a) or real(*a))
    reader = shards.ShardReader({"path": str(folder)})
    left = reader.pushFilters([GreaterThanOrEqual(("t",), 1500), LessThan(("t",), 9500), EqualTo(("symbol",), "X")])
    assert len(list(left)) == 3 and (reader.start, reader.stop, reader.symbols) == (1500, 9500, {"X"})
    assert [p.path.rsplit("-", 1)[1] for p in reader.partitions()] == ["000000000001.shard", "000000000002.shard", "000000000009.shard"]
    assert len(opened) == 1


def test_a_task_that_fails_once_leaves_nothing(spark, tmp_path):
    """The first attempt of a task dies after it has staged shards; its second attempt's are the only ones kept."""
    from tapeworks.sources.shards import ShardSource, ShardWriter

    folder, mark = tmp_path / "s", tmp_path / "died"

    class Once(ShardWriter):
        def write(self, iterator):
            done = super().write(iterator)
            if not mark.exists():
                mark.touch()
                raise RuntimeError("lost")
            return done

    class Source(ShardSource):
        @classmethod
        def name(cls):
            return "tape_shards_once"

        def writer(self, schema, overwrite):
            return Once(self.options, overwrite)

    spark.dataSource.register(Source)
    rows = spark.createDataFrame(whole_cents(tape(4000, t0=0))).select(*shards.NAMES, F.format_string("%012d", F.floor(F.col("t") / 1000)).alias("stretch")).coalesce(1).sortWithinPartitions("t")
    write = lambda: rows.write.format("tape_shards_once").options(job="j").mode("append").save(str(folder))
    with pytest.raises(Exception, match="lost"):
        write()  # a local master gives a task one attempt: the job is aborted
    assert mark.exists() and list(folder.iterdir()) == []
    staged = Once({"path": str(folder), "job": "j"}, False)
    staged.write(iter([]))
    staged.shard(whole_cents(tape(1000, t0=0)), "000000000000")  # what a lost attempt leaves behind
    assert [f.name for f in folder.iterdir()] == ["_staged-j"]
    write()
    assert sorted(f.name for f in folder.iterdir() if not f.name.startswith(".")) == ["X-000000000000.shard", "X-000000000001.shard", "X-000000000002.shard", "X-000000000003.shard", "j.index.json"]
    assert len((folder / "j.index.json").read_text().splitlines()) == 4


def test_changed_bars_replace_a_shard_and_overwrite_takes_others_away(spark, tmp_path):
    folder, frame = str(tmp_path / "s"), whole_cents(tape(2000, t0=0))
    shards.write(spark.createDataFrame(frame), folder, 1000)
    frame.loc[1500, "vol"] += 1
    made = shards.write(spark.createDataFrame(frame), folder, 1000).orderBy("t0").toPandas()
    assert made["status"].tolist() == ["cached", "ok"]
    assert shards.read(spark, folder).where("t = 1500").first()["vol"] == pytest.approx(frame["vol"][1500], abs=1e-5)
    shards.write(spark.createDataFrame(frame.iloc[:500]), folder, 1000, mode="overwrite")
    assert shards.read(spark, folder).count() == 500 and len(list((tmp_path / "s").glob("*.index.json"))) == 1


def test_store_prunes_months(spark, tmp_path):
    rows = spark.range(0, 90 * 1440, 60).select(F.lit("X").alias("symbol"), F.col("id").alias("t"))
    store.save(rows, str(tmp_path / "f"), 60)
    part = store.load(spark, str(tmp_path / "f"), 60, 45 * 1440, 46 * 1440)
    assert part.count() == 24 and {r["month"] for r in part.collect()} == {"1970-02"}
    assert len({f.split("month=")[1][:7] for f in part.inputFiles()}) <= 3


def test_months_of_archives_end_with_a_status_each(spark, tmp_path):
    from tapeworks.sources import archives

    folder, target, day = tmp_path / "in", str(tmp_path / "out"), 86_400
    folder.mkdir()
    at = lambda text: int(np.datetime64(text, "s").astype(int))
    line = lambda t, c: LINE.format(t=t, v=2.0, b=0.5).replace("10.5", str(c))
    # a month's archive, in ms, with a candle of the next month that isn't its own; and a day's, which the month's makes needless
    (folder / "X-1m-2023-01.csv").write_text("".join(line((at("2023-01-03") + 60 * i) * 1000, 10 + i) for i in range(3)) + line(at("2023-02-01") * 1000, 99))
    (folder / "X-1m-2023-01-09.csv").write_text(line(at("2023-01-09"), 55))
    # days, zipped, in microseconds and in seconds
    for name, unit in (("2023-02-02", 10**6), ("2023-02-05", 1)):
        with zipfile.ZipFile(folder / f"X-1m-{name}.zip", "w") as out:
            out.writestr("a.csv", "open_time,a,b\n" + line(at(name) * unit, 20))
    (folder / "X-1m-2023-03.zip").write_bytes(b"no zip")
    (folder / "X-1m-2023-04.csv").write_text("open_time,open\n")
    (folder / "Y-1m-2023-05.csv").write_text(line(at("2023-05-01"), 1))
    run = lambda: {r["month"]: r for r in archives.packed(spark, str(folder), target, "X", "2023-01", "2023-05", 60, level=3).collect()}
    found = run()
    assert {m: r["status"] for m, r in found.items()} == {"2023-01": "ok", "2023-02": "ok", "2023-03": "error", "2023-04": "empty", "2023-05": "unavailable"}
    assert [(found[m]["source"], found[m]["archives"], found[m]["n"], found[m]["n_valid"]) for m in ("2023-01", "2023-02")] == [("monthly", 1, 31 * 1440, 3), ("daily", 2, 28 * 1440, 2)]
    assert "BadZipFile" in found["2023-03"]["error"] and found["2023-01"]["gap_pct"] == pytest.approx(100 * (1 - 3 / (31 * 1440)), abs=1e-4)
    bars = shards.read(spark, target).where(f"t < {at('2023-02-01') // 60}").orderBy("t").toPandas()
    assert bars["t"].iloc[0] == at("2023-01-01") // 60 and len(bars) == 31 * 1440 and set(bars["close"][: 2 * 1440 + 1]) == {10.0} and bars["close"].iloc[-1] == 12.0
    (folder / "X-1m-2023-03.zip").unlink()
    (folder / "X-1m-2023-03.csv").write_text(line(at("2023-03-31") + day - 60, 7))
    again = run()
    assert {m: r["status"] for m, r in again.items()} == {"2023-01": "cached", "2023-02": "cached", "2023-03": "ok", "2023-04": "empty", "2023-05": "unavailable"}

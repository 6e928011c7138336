"""Queries over what sinks have written: shards, candle files, the store, metrics, cached replays and side files.

Each writes to a new place in the shared folder and reads it again through the engine's own reader.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.scalars import r6
from tapeworks.operators import grid, replays, score
from tapeworks.plans import oracles as O
from tapeworks.plans import registry as R
from tapeworks.plans import settings as S
from tapeworks.sources import archives, klines, shards, store
from tapeworks.sources.events import ticks
from tapeworks.sources.files import kept, opened, scratch

DAY, WEEK = 1_440, 10_080


def place(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark, f'{tempfile.gettempdir()}/tapeworks')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, sf_dir: str) -> str:
    folder = place(spark, "shards")
    shards.write(R.tape(spark, sf_dir, True), folder, WEEK, level=3)
    return folder


@R.query(f"WITH {O.grid(True)} SELECT symbol, t, ntrades, valid, {R.R_FIELDS} FROM tape")
def shard_scan(spark, sf_dir):
    """A panel written as shards of a week, and read whole."""
    return R.rounded(shards.read(spark, written(spark, sf_dir)), *R.FIELDS)


@R.query(f"WITH {O.grid(True)}, e AS (SELECT max(t) AS b FROM tape) SELECT symbol, t, close, valid FROM tape, e WHERE t >= b - 2880 AND t < b - 1440")
def shard_range(spark, sf_dir):
    """Two columns of a day out of shards: the filter reaches the source, so other shards aren't opened, other columns' frames not read."""
    folder = written(spark, sf_dir)
    last = grid.bars(ticks(spark, sf_dir, panel=True)).agg(F.max("t")).first()[0]
    return shards.read(spark, folder, ["close", "valid"]).where((F.col("t") >= last - 2 * DAY) & (F.col("t") < last - DAY))


@R.query(f"""WITH {O.grid(True)}, s AS (SELECT symbol, t // {WEEK} AS w, min(t) AS t0, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid FROM tape GROUP BY ALL)
    SELECT symbol, t0, n, n_valid, round(100.0 * (n - n_valid) / n, 4) AS gap_pct, 'ok' AS status FROM s""")
def shard_manifest(spark, sf_dir):
    """What the sink's commit says of its shards."""
    return shards.write(R.tape(spark, sf_dir, True), place(spark, "shards"), WEEK, level=3).drop("file", "bytes")


@R.query(f"WITH {O.bars()} SELECT 'ALL' AS symbol, t * 60 AS t, ntrades, {R.R_FIELDS} FROM bars")
def csv_scan(spark, sf_dir):
    """Bars written as twelve-column candle files, stamps in milliseconds, and read back."""
    bars = grid.bars(ticks(spark, sf_dir))
    zero, stamp = F.lit(0), F.col("t") * 60_000
    text = bars.select(stamp.alias("open_time"), "open", "high", "low", "close", "vol", (stamp + 59_999).alias("close_time"), "qvol", "ntrades", (F.col("vol") * F.col("takerfrac")).alias("taker"), zero.alias("quote"), zero.alias("last"))
    folder = place(spark, "candles")
    text.write.option("header", True).csv(folder)
    return R.rounded(klines.read_csv(spark, f"{folder}/*.csv"), *R.FIELDS)


@R.query(f"WITH {O.bars()} SELECT 'ALL' AS symbol, t * 60 AS t, ntrades, {R.R_FIELDS} FROM bars")
def csv_units(spark, sf_dir):
    """Candles of four sets of files, each stamped in a unit of its own, which every file's first stamp tells."""
    bars, folder, zero = grid.bars(ticks(spark, sf_dir)), place(spark, "units"), F.lit(0)
    for i, unit in enumerate((1, 10**3, 10**6, 10**9)):
        stamp = F.col("t") * 60 * unit
        text = bars.where(F.pmod(F.floor(F.col("t") / DAY), F.lit(4)) == i).select(stamp.alias("open_time"), "open", "high", "low", "close", "vol", stamp.alias("close_time"), "qvol", "ntrades", (F.col("vol") * F.col("takerfrac")).alias("taker"), zero.alias("quote"), zero.alias("last"))
        text.write.option("header", True).csv(f"{folder}/{i}")
    return R.rounded(klines.read_csv(spark, f"{folder}/*/*.csv"), *R.FIELDS)


@R.query(f"WITH {O.logs()}, e AS (SELECT max(t) AS b FROM logs) SELECT symbol, t, {O.r6('logp', 'logp')}, valid FROM logs, e WHERE t >= b - 2880 AND t < b - 1440")
def store_range(spark, sf_dir):
    """A day out of a store partitioned by month; other months aren't listed."""
    folder, rows = place(spark, "store"), R.logs(spark, sf_dir).drop("big")
    store.save(rows, folder, 60)
    last = grid.bars(ticks(spark, sf_dir)).agg(F.max("t")).first()[0]
    return store.load(spark, folder, 60, last - 2 * DAY, last - DAY).select("symbol", "t", r6(F.col("logp")).alias("logp"), "valid")


@R.query("SELECT CASE WHEN i % 2 = 0 THEN 'nano' ELSE 'mini' END AS variant, i AS step, round(1.0 / (i + 1), 6) AS loss FROM generate_series(0, 199) a(i)")
def metrics_log(spark, sf_dir):
    """Metrics appended in two runs, a folder for each variant, and read together."""
    folder = place(spark, "metrics")
    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, "nano").otherwise("mini").alias("variant"), F.col("id").alias("step"), F.round(1.0 / (F.col("id") + 1), 6).alias("loss"))
    for part in (rows.where("step < 120"), rows.where("step >= 120")):
        store.append_metrics(part, folder)
    return store.metrics(spark, folder).select("variant", "step", "loss")


@R.query(R.ORACLE_SQL["scorecard"])
def score_sidecar(spark, sf_dir):
    """Replay scores computed once, kept, and read from the cache; the scorecard beside them as JSON."""
    folder, asked = place(spark, "replay"), []

    def compute():
        asked.append(1)
        return R.replay(spark, sf_dir)

    for _ in range(2):
        found = store.cached(spark, f"{folder}/scores", compute)
    if len(asked) != 1:
        raise RuntimeError("the second read must come from the cache")
    return store.sidecar(score.scorecard(found), f"{folder}/scorecard")


def replayed(spark: SparkSession, sf_dir: str, z=S) -> replays.Snapshot:
    """A snapshot made once and opened twice: what comes of the second is made without models or the tape."""
    folder, asked = place(spark, "snapshot"), []

    def make():
        asked.append(1)
        tape = kept(R.tape(spark, sf_dir, bar=z.BAR), "tape")
        bounds = replays.session(tape, z.CONTEXT, z.HORIZON, z.BAR, seed=z.SEED) if hasattr(z, "SEED") else None
        at = R.cursors(tape, z) if bounds is None else replays.cursors(bounds, z.STRIDE)
        return at, tape, R.forecasts(spark, tape, z, at)

    for _ in range(2):
        found = replays.snapshot(spark, folder, make, z.HORIZON, z.LOOKBACK)
    if len(asked) != 1:
        raise RuntimeError("the second opening must not make the snapshot again")
    return found


@R.query(R.ORACLE_SQL["scorecard"])
def snapshot_scorecard(spark, sf_dir):
    """The scorecard of a replay from its snapshot alone."""
    return replayed(spark, sf_dir).scorecard()


@R.query(R.ORACLE_SQL["frame_arrays"])
def snapshot_frames(spark, sf_dir):
    """Whole frames of a replay from its snapshot alone."""
    return R.listed_frames(replayed(spark, sf_dir).frames(S.ROLL))


@R.query(f"WITH RECURSIVE {O.scored(z=S.DRAWN)} SELECT model, symbol, t, {', '.join(O.r6(x, x) for x in R.SCORES)} FROM scores")
def session_scores(spark, sf_dir):
    """Scores over a day of the tape drawn by seed."""
    return R.rounded(replayed(spark, sf_dir, S.DRAWN).scores(S.DRAWN.ROLL), *R.SCORES).select("model", "symbol", "t", *R.SCORES)


@R.query(f"""WITH RECURSIVE {O.forecasts(z=S.DRAWN)}, {R.BAND}, {R.frames_sql(S.DRAWN)}""")
def session_frames(spark, sf_dir):
    """Frames over the same day: what they show of the past reaches before it."""
    return replayed(spark, sf_dir, S.DRAWN).frames(S.DRAWN.ROLL).select("symbol", "t", "price", "n_past", "n_future", *(F.round(c, 4).alias(c) for c in ("y_low", "y_high")))


_MONTHS = "SELECT strftime(unnest(generate_series(date_trunc('month', min(ts)) - INTERVAL 1 MONTH, date_trunc('month', max(ts)), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM events WHERE ts IS NOT NULL AND value IS NOT NULL"


@R.query(f"""WITH {O.bars()}, months AS ({_MONTHS}), held AS (SELECT strftime(make_timestamp(t * 60000000), '%Y-%m') AS month, count(*) AS n_valid, count(DISTINCT t // 1440) AS days FROM bars GROUP BY ALL)
    SELECT 'ALL' AS symbol, month, CASE WHEN days IS NULL THEN 'unavailable' ELSE 'ok' END AS status, CASE WHEN days IS NOT NULL THEN 'daily' END AS source, coalesce(days, 0) AS archives,
           CASE WHEN days IS NOT NULL THEN 1440 * day(last_day(strptime(month || '-01', '%Y-%m-%d')::DATE)) ELSE 0 END AS n, coalesce(n_valid, 0) AS n_valid FROM months LEFT JOIN held USING (month)""")
def archive_statuses(spark, sf_dir):
    """Bars laid down as an archive of candles a day, and packed by months: a status for each, one of them without archives."""
    bars = grid.bars(ticks(spark, sf_dir))
    day = F.date_format(F.timestamp_seconds(F.col("t") * 60), "yyyy-MM-dd")
    zero = F.lit(0)
    lines = bars.select((F.col("t") * 60).alias("open_time"), "open", "high", "low", "close", "vol", zero.alias("end"), "qvol", "ntrades", (F.col("vol") * F.col("takerfrac")).alias("taker"), zero.alias("quote"), zero.alias("last"), day.alias("day"))
    folder = place(spark, "archives")
    whole = lines.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", *lines.columns[:-1]))), "\n").alias("text"))  # a day's bars
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)

    def lay_down(batches):
        for batch in batches:
            fs, root = opened(folder)
            for name, text in zip(batch["day"], batch["text"]):
                with fs.open_output_stream(f"{root}/ALL-1m-{name}.csv") as out:
                    out.write(text.encode())
            yield batch[["day"]]

    days = whole.mapInPandas(lay_down, "day string").agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    before = spark.range(1).select(F.date_format(F.add_months(F.to_date(F.lit(days["a"])), -1), "yyyy-MM").alias("m")).first()["m"]
    found = archives.packed(spark, folder, place(spark, "packed"), "ALL", before, days["b"][:7], 60, level=3)
    return found.select("symbol", "month", "status", "source", "archives", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_valid")))

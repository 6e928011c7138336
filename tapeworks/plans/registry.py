"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import at_least, clipped, r6
from tapeworks.operators import analyser, around, context, forecast, grid, recurrence, score
from tapeworks.plans import oracles as O
from tapeworks.plans import settings as S
from tapeworks.sources.events import ticks
from tapeworks.sources.files import kept
from tapeworks.streaming import queries as streams
from tapeworks.streaming import train

QUERIES: dict = dict(streams.QUERIES)
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def tape(spark: SparkSession, sf_dir: str, panel: bool = False, bar: int = S.BAR) -> DataFrame:
    return grid.filled(grid.densify(grid.bars(ticks(spark, sf_dir, bar, panel)), common=panel))


def logs(spark: SparkSession, sf_dir: str, panel: bool = False) -> DataFrame:
    return grid.projected(tape(spark, sf_dir, panel))


FIELDS = ("open", "high", "low", "close", "vol", "qvol", "takerfrac")
R_FIELDS = ", ".join(O.r6(f, f) for f in FIELDS)


@query(f"WITH {O.bars(True)} SELECT symbol, t, ntrades, {R_FIELDS} FROM bars")
def bars_ohlcv(spark, sf_dir):
    return rounded(grid.bars(ticks(spark, sf_dir, panel=True)), *FIELDS)


@query(f"WITH {O.grid(True)} SELECT symbol, t, ntrades, valid, {R_FIELDS} FROM tape")
def dense_grid_fill(spark, sf_dir):
    """Forward fill, and back fill before a symbol's first bar."""
    return rounded(tape(spark, sf_dir, True), *FIELDS).drop("big")


@query(f"WITH {O.grid(True)} SELECT symbol, t // 1440 AS stretch, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, round(100.0 * (count(*) - count(*) FILTER (WHERE valid)) / count(*), 4) + 0.0 AS gap_pct FROM tape GROUP BY ALL")
def gap_report(spark, sf_dir):
    return grid.gaps(tape(spark, sf_dir, True), 1440).withColumn("gap_pct", F.col("gap_pct") + 0.0)


@query(f"""WITH {O.grid(True)}, s AS (SELECT symbol, t // 1440 AS d, min(t) AS t0, count(*) AS n FROM tape WHERE valid GROUP BY ALL), l AS (SELECT symbol, t0, n, lead(t0) OVER (PARTITION BY symbol ORDER BY t0) AS next_t0 FROM s)
    SELECT * FROM l WHERE next_t0 != t0 + n""")
def shard_breaks(spark, sf_dir):
    """Contiguity check, over days taken as shards."""
    days = grid.densify(grid.bars(ticks(spark, sf_dir, panel=True)), common=True).where("valid").groupBy("symbol", F.floor(F.col("t") / 1440).alias("d")).agg(F.min("t").alias("t0"), F.count("*").alias("n"))
    return grid.breaks(days.drop("d"))


@query(f"""WITH {O.grid(True)}, c AS (SELECT *, CAST(round_even(close * 100, 0) AS BIGINT) AS c FROM tape)
    SELECT symbol, t, c - coalesce(lag(c) OVER (PARTITION BY symbol, t // {grid.SPAN} ORDER BY t), 0) AS dclose, CAST(round_even(open * 100, 0) AS BIGINT) - c AS open_off,
           CAST(round_even(high * 100, 0) AS BIGINT) - c AS high_off, CAST(round_even(low * 100, 0) AS BIGINT) - c AS low_off, CAST(round_even(vol * 1e5, 0) AS BIGINT) AS vol_q,
           CAST(round_even(qvol, 0) AS BIGINT) AS qvol_q, ntrades, CAST(round_even(takerfrac * 65535, 0) AS INT) AS taker_q, valid FROM c""")
def codec_encoded(spark, sf_dir):
    return grid.encoded(tape(spark, sf_dir, True)).drop("big")


@query(f"WITH {O.grid(True)} SELECT symbol, t, ntrades, valid, {R_FIELDS} FROM tape")
def codec_roundtrip(spark, sf_dir):
    """Encoding and decoding give the tape back."""
    return rounded(grid.decoded(grid.encoded(tape(spark, sf_dir, True))), *FIELDS).drop("big")


LOGS = ("logp", "close", "hi_off", "lo_off", "lv", "lntr", "imb")


@query(f"WITH {O.logs()} SELECT symbol, t, valid, {', '.join(O.r6(x, x) for x in LOGS)} FROM logs")
def tape_projection(spark, sf_dir):
    return rounded(logs(spark, sf_dir), *LOGS).drop("big")


INVERSE = ("close", "high", "low", "vol", "ntrades", "takerfrac")


@query(f"""WITH {O.logs()} SELECT symbol, t, valid, {O.r6("close", "close")}, {O.r6("exp(logp + hi_off)", "high")}, {O.r6("exp(logp + lo_off)", "low")}, {O.r6("exp(lv) - 1", "vol")},
    round((exp(lv) - 1) * close, 5) + 0.0 AS qvol, {O.r6("round(exp(lntr) - 1)", "ntrades")}, {O.r6("imb / 2 + 0.5", "takerfrac")} FROM logs""")
def tape_inverse(spark, sf_dir):
    return rounded(grid.restored(logs(spark, sf_dir)), *INVERSE).withColumn("qvol", F.round("qvol", 5) + 0.0).drop("big")


@query(f"""WITH {O.logs()} SELECT symbol, t, {", ".join(O.r6(f"logp - coalesce(lag(logp, {k}) OVER o, first_value(logp) OVER o)", f"ret_{k}") for k in analyser.RETURNS)} FROM logs WINDOW o AS (PARTITION BY symbol ORDER BY t)""")
def lag_returns(spark, sf_dir):
    back = recurrence.lags(logs(spark, sf_dir), "logp", list(analyser.RETURNS))
    return back.select("symbol", "t", *(r6(F.col("logp") - F.col(f"lag_{k}")).alias(f"ret_{k}") for k in analyser.RETURNS))


LADDER = [recurrence.Average(f"var_{h}", "r2", h) for h in analyser.VOLATILITY]


@query(f"""WITH RECURSIVE {O.logs()}, inputs AS (SELECT *, power(logp - coalesce(lag(logp) OVER (PARTITION BY symbol ORDER BY t), logp), 2) AS r2 FROM logs){O.averages("inputs", LADDER, "one")}
    SELECT symbol, t, {", ".join(O.r6(f"ln(greatest(sqrt(greatest(var_{h}, 0.0)), 1e-9)) + 9.0", f"logvol_{h}") for h in analyser.VOLATILITY)} FROM one""")
def vol_ladder(spark, sf_dir):
    """Ticks to bars, gap fill, returns, and realised volatility at five half-lives."""
    back = recurrence.lags(logs(spark, sf_dir), "logp", [1])
    ladder = recurrence.averages(back.withColumn("r2", (F.col("logp") - F.col("lag_1")) ** 2), LADDER)
    return ladder.select("symbol", "t", *(r6(F.ln(at_least(F.sqrt(at_least(F.col(f"var_{h}"), 0.0)), 1e-9)) + 9.0).alias(f"logvol_{h}") for h in analyser.VOLATILITY))


GROUPS = {
    "squashed_returns": "_tanh", "scaled_returns": "s_z", "vol_term_structure": "volratio", "trend_distance": "trend_", "parkinson_range": "range_", "activity_z": ("vol_z", "logvol_ratio", "ntrades"),
    "flow_imbalance": "flow_imb", "signed_volume": "signed_vol", "vwap_deviation": "vwap_dev", "illiquidity": "amihud", "calendar": ("tod_", "dow_"), "data_quality": ("valid_frac", "gap_flag"), "momentum": ("accel", "rsi"),
}


def features_of(names):
    def run(spark, sf_dir):
        found = analyser.features(tape(spark, sf_dir), F.col("t") * 60, tuple(names))
        return found.select("symbol", "t", *(r6(F.col(n)).alias(n) for n in names))

    return run


for _group, _marks in GROUPS.items():
    _marks = (_marks,) if isinstance(_marks, str) else _marks
    _names = [n for n in analyser.NAMES if any(m in n for m in _marks) and not (_group == "scaled_returns" and not n.startswith("ret"))]
    QUERIES[_group], ORACLE_SQL[_group] = features_of(_names), O.features(*_names)
QUERIES["analyser_features"], ORACLE_SQL["analyser_features"] = features_of(analyser.NAMES), O.features(*analyser.NAMES)


# the stream gives out what the watermark has passed
ORACLE_SQL["stream_analyser"] = O.streamed_features()
ORACLE_SQL["stream_panel"] = O.panel_features()
ORACLE_SQL["stream_settlement"] = f"""WITH {O.grid()} SELECT c.symbol, c.t, x.t - c.t AS h, {O.r6("ln(greatest(x.close, 1e-9)) - ln(greatest(c.close, 1e-9))", "truth")}, x.close = c.close AS hit
    FROM tape c JOIN tape x ON x.symbol = c.symbol AND x.t > c.t AND x.t <= c.t + {S.HORIZON} WHERE c.t % {S.STRIDE} = 0"""


def cursors(tape_: DataFrame, z=S) -> DataFrame:
    return context.replay_times(tape_, z.CONTEXT, z.HORIZON, z.STRIDE)


WINDOW = ("rel", "hi_off", "lo_off", "lv", "lntr", "imb")


@query(f"WITH {O.window()} SELECT symbol, id, t, pos, valid, {', '.join(O.r6(x, x) for x in WINDOW)} FROM wide")
def context_window(spark, sf_dir, panel=False):
    found = logs(spark, sf_dir, panel)
    return rounded(context.context(cursors(found), found, S.CONTEXT), *WINDOW)


CHANNELS = ("path", "ret", "hi", "lo", "act", "ntr", "imb", "valid")
SIG = "2e-4"


@query(f"""WITH {O.window()}, x AS (SELECT id, symbol, t, pos, rel / ({SIG} * {S.CONTEXT ** 0.5!r}) AS path, coalesce(rel - lag(rel) OVER o, 0.0) / {SIG} AS ret, hi_off / {SIG} AS hi, lo_off / {SIG} AS lo,
    lv - avg(lv) OVER a AS act, lntr - avg(lntr) OVER a AS ntr, imb, valid::INT::DOUBLE AS valid FROM wide WINDOW o AS (PARTITION BY symbol, id ORDER BY pos), a AS (PARTITION BY symbol, id))
    SELECT id, symbol, t, pos, {", ".join(O.r6(f"greatest(least({c}, 10.0), -10.0)", c) for c in CHANNELS)} FROM x""")
def window_normalised(spark, sf_dir):
    found = logs(spark, sf_dir)
    return rounded(context.normalised(context.context(cursors(found), found, S.CONTEXT), S.CONTEXT, F.lit(float(SIG))), *CHANNELS)


@query(f"WITH {O.window()} " + " UNION ALL ".join(f"SELECT '{n}' AS level, id, symbol, t, (pos - {S.CONTEXT - span} - 1) // {stride} AS step, {O.r6('avg(rel)', 'rel')}, {O.r6('avg(lv)', 'lv')} FROM wide WHERE pos > {S.CONTEXT - span} GROUP BY ALL" for n, span, stride in S.POOL))
def pyramid_pool(spark, sf_dir):
    found = logs(spark, sf_dir)
    wide = context.context(cursors(found), found, S.CONTEXT)
    out = None
    for name, span, stride in S.POOL:
        level = rounded(context.pooled(wide, S.CONTEXT, span, stride, ["rel", "lv"]), "rel", "lv").withColumn("level", F.lit(name))
        out = level if out is None else out.unionByName(level)
    return out


@query(f"WITH {O.grid()}{O.cursors()}{O.truth()} SELECT id, symbol, t, h, {O.r6('truth', 'truth')} FROM truth")
def settle_paths(spark, sf_dir, panel=False):
    found = logs(spark, sf_dir, panel)
    return rounded(context.settled(cursors(found), found, S.HORIZON), "truth")


@query(f"WITH {O.basis_sql()} SELECT h, k, {O.r6('phi', 'phi')} FROM basis")
def kl_basis(spark, sf_dir):
    return rounded(forecast.basis(spark, S.HORIZON, S.MODES), "phi")


@query(f"WITH w AS (SELECT h, power(1.0 / sqrt(h), 0.5) AS w FROM generate_series(1, {S.HORIZON}) a(h)) SELECT h, {O.r6('w / avg(w) OVER ()', 'hw')} FROM w")
def horizon_tilt(spark, sf_dir):
    return rounded(forecast.tilt(spark, S.HORIZON), "hw")


def volatility(tape_: DataFrame) -> DataFrame:
    """symbol, t, logp, close, sig, signal of every bar."""
    return analyser.features(tape_, names=("logvol_300s", "ret_60s_z")).select("symbol", "t", "logp", "close", F.exp(F.col("logvol_300s") - 9.0).alias("sig"), F.col("ret_60s_z").alias("signal"))


def seen(tape_: DataFrame, z=S, at: DataFrame | None = None) -> DataFrame:
    """The cursors, each with the volatility and the signal it sees."""
    return (cursors(tape_, z) if at is None else at).join(volatility(tape_).select("symbol", "t", "sig", "signal"), ["symbol", "t"])


def forecasts(spark: SparkSession, tape_: DataFrame, z=S, at: DataFrame | None = None) -> DataFrame:
    """model, symbol, id, t, sig, paths (arrays) of every model at every cursor, or at those given."""
    models = spark.createDataFrame(list(z.MODELS), "model string, drift double")
    return forecast.path_arrays(forecast.walk_arrays(seen(tape_, z, at), models, z.HORIZON, z.MODES), z.HORIZON)


@query(f"WITH RECURSIVE {O.forecasts()} SELECT model, symbol, id, t, q, h, {O.r6('path', 'path')} FROM forecasts")
def path_synthesis(spark, sf_dir):
    return rounded(forecast.laid_out(forecasts(spark, tape(spark, sf_dir))), "path").drop("sig")


@query(f"WITH RECURSIVE {O.forecasts()} SELECT model, symbol, id, t, q, h, round(close * exp(greatest(least(path, 0.5), -0.5)), 4) + 0.0 AS price FROM forecasts JOIN vol USING (symbol, t)")
def price_band(spark, sf_dir):
    tape_ = kept(tape(spark, sf_dir), "tape")
    lasts = tape_.select("symbol", "t", "close")
    return forecast.laid_out(forecasts(spark, tape_).join(lasts, ["symbol", "t"])).select("model", "symbol", "id", "t", "q", "h", (F.round(forecast.prices(F.col("path"), F.col("close")), 4) + 0.0).alias("price"))


_E = "embeddings"


@query(f"""WITH e AS (SELECT vec_id AS id, (i - 1) % 3 AS q, (i - 1) // 3 AS k, embedding[i]::DOUBLE AS raw FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding) - len(embedding) % 3)) AS i FROM embeddings))
    SELECT id, q, k, {O.r6(f"CASE q WHEN 1 THEN m WHEN 0 THEN m - {O.softplus('lo')} ELSE m + {O.softplus('hi')} END", "coef")} FROM
    (SELECT *, max(raw) FILTER (WHERE q = 1) OVER w AS m, max(raw) FILTER (WHERE q = 0) OVER w AS lo, max(raw) FILTER (WHERE q = 2) OVER w AS hi FROM e WINDOW w AS (PARTITION BY id, k))""")
def quantile_order(spark, sf_dir):
    """Ordering of arbitrary raw coefficients, here all whole triples of each embedding."""
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").where("embedding is not null")
    raw = vectors.select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", F.lit(1), F.size("embedding") - F.size("embedding") % 3)).alias("i", "x")).select("id", (F.col("i") % 3).cast("long").alias("q"), F.floor(F.col("i") / 3).alias("k"), F.col("x").cast("double").alias("raw"))
    return rounded(forecast.ordered(raw, "id"), "coef").drop("raw")


SCORES = ("nrmse", "flat_nrmse", "dir_hit", "endpoint", "jump", "roll_hit", "roll_nrmse")


@query(f"WITH RECURSIVE {O.scored()} SELECT model, symbol, t, {', '.join(O.r6(x, x) for x in SCORES)}, {O.r6('100 * exp(-nrmse)', 'acc')}, {O.r6('100 * exp(-roll_nrmse)', 'roll_acc')}, {O.r6('100 * (1 - nrmse)', 'skill')} FROM scores")
def score_by_time(spark, sf_dir):
    return rounded(replay(spark, sf_dir), *SCORES, "acc", "roll_acc", "skill")


def replay(spark: SparkSession, sf_dir: str, panel: bool = False, z=S) -> DataFrame:
    tape_ = kept(tape(spark, sf_dir, panel, z.BAR), "tape")
    return score.scores(forecasts(spark, tape_, z), context.futures(cursors(tape_, z), grid.projected(tape_), z.HORIZON), z.HORIZON, z.ROLL)


@query(f"""WITH RECURSIVE {O.scored()} SELECT model, round(avg(dir_hit) * 100, 2) AS dir_hit_pct, round(avg(nrmse), 4) AS path_nrmse, round(avg(endpoint), 4) AS endpoint_nrmse, round(avg(100 * exp(-nrmse)), 2) AS accuracy_pct,
    round(median(jump), 5) AS stability_jump_sigma FROM scores GROUP BY model""")
def scorecard(spark, sf_dir):
    return score.scorecard(replay(spark, sf_dir))


def loss_sql(z) -> str:
    by = f"(greatest(sig, 1e-8) * {z.HORIZON ** 0.5!r})"
    ends = [min(h, z.HORIZON) for h in (60, 300, 900, 1500)]
    return f"""WITH RECURSIVE {O.forecasts(z=z)}{O.truth(z)}, hw AS (SELECT h, w / avg(w) OVER () AS hw FROM (SELECT h, power(1.0 / sqrt(h), 0.5) AS w FROM generate_series(1, {z.HORIZON}) a(h))), x AS (
        SELECT f.*, truth, hw, (truth - path) / {by} AS e, CASE q WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 ELSE 0.9 END AS p FROM forecasts f JOIN truth USING (symbol, id, h) JOIN hw USING (h)
    ), plain AS (
        SELECT model, avg(greatest(p * e, (p - 1) * e) * hw) AS quantile, avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END * hw) FILTER (WHERE q = 1) AS huber, sqrt(avg(e * e) FILTER (WHERE q = 1)) AS nrmse FROM x GROUP BY model
    ), turned AS (
        SELECT model, avg({O.softplus(f"(-tanh(path / ({by} * 0.5)) * sign(truth) * 4.0)")}) AS direction, avg((sign(path) = sign(truth))::INT) AS hit
        FROM x JOIN (SELECT unnest({ends}) AS h) d USING (h) WHERE q = 1 GROUP BY model
    ), bent AS (
        SELECT model, avg(power(bend, 2)) * {z.HORIZON} AS smooth
        FROM (SELECT model, (path - 2 * lag(path) OVER o + lag(path, 2) OVER o) / {by} AS bend FROM forecasts WHERE q = 1 WINDOW o AS (PARTITION BY model, symbol, id ORDER BY h)) GROUP BY model
    ), anchors AS MATERIALIZED (SELECT model, symbol, q, t, path AS anchor FROM forecasts WHERE h = {z.STRIDE}), earlier AS MATERIALIZED (
        SELECT model, symbol, q, t + {z.STRIDE} AS t, h - {z.STRIDE} AS h, path - anchor AS was FROM forecasts JOIN anchors USING (model, symbol, q, t) WHERE h > {z.STRIDE}
    ), steady AS (
        SELECT model, avg(power((path - was) / {by}, 2)) AS stability FROM forecasts JOIN earlier USING (model, symbol, q, t, h) GROUP BY model
    ) SELECT model, {", ".join(O.r6(x, x) for x in ("quantile", "huber", "direction", "stability", "smooth", "nrmse", "hit"))}, {O.r6("quantile + huber + 0.15 * direction + 0.35 * stability + 0.02 * smooth", "loss")}, {O.r6("-nrmse + 0.5 * (hit - 0.5)", "reward")}
    FROM plain JOIN turned USING (model) JOIN bent USING (model) JOIN steady USING (model)"""


def losses(spark: SparkSession, sf_dir: str, z=S) -> DataFrame:
    tape_ = kept(tape(spark, sf_dir, bar=z.BAR), "tape")
    found = score.losses(forecasts(spark, tape_, z), context.futures(cursors(tape_, z), grid.projected(tape_), z.HORIZON), z.HORIZON, z.STRIDE)
    return rounded(found, *(c for c in found.columns if c != "model"))


@query(loss_sql(S))
def loss_terms(spark, sf_dir):
    return losses(spark, sf_dir)


@query(loss_sql(S.FULL))
def loss_terms_full(spark, sf_dir):
    """The losses at full size: bars of a second, a horizon of 1 500 on 24 modes, and four directions apart."""
    return losses(spark, sf_dir, S.FULL)


@query(f"WITH RECURSIVE {O.scored(z=S.FULL)} SELECT model, symbol, t, {', '.join(O.r6(x, x) for x in SCORES)}, {O.r6('100 * exp(-nrmse)', 'acc')}, {O.r6('100 * exp(-roll_nrmse)', 'roll_acc')}, {O.r6('100 * (1 - nrmse)', 'skill')} FROM scores")
def scores_full(spark, sf_dir):
    """The scores at full size."""
    return rounded(replay(spark, sf_dir, z=S.FULL), *SCORES, "acc", "roll_acc", "skill")


LEVELS = tuple((min(span, S.FULL.CONTEXT), stride) for span, stride in forecast.LEVELS)
TOKENS = ("logp", "hi_off", "lo_off", "lv", "lntr", "imb", "valid")
_EDGES = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS level, k // {forecast.PATCH} AS token, {1 - span + (span // stride) % forecast.PATCH * stride} + k * {stride} AS first, {stride} AS stride FROM generate_series(0, {span // stride // forecast.PATCH * forecast.PATCH - 1}) a(k)"
    for i, (span, stride) in enumerate(LEVELS)
)


@query(f"""WITH {O.logs(bar=1)}{O.cursors(S.APART)}, edges AS ({_EDGES}), asked AS MATERIALIZED (
        SELECT symbol, id, t, level, token, first, t + first + unnest(generate_series(0, stride - 1)) AS bar FROM cursors, edges
    ), laid AS MATERIALIZED (SELECT symbol, t AS bar, logp, hi_off, lo_off, lv, lntr, imb, valid::INT AS valid FROM logs), owns AS MATERIALIZED (SELECT c.symbol, c.t, x.logp AS own FROM cursors c JOIN laid x ON x.symbol = c.symbol AND x.bar = c.t),
    steps AS (SELECT symbol, id, t, level, token, first, {", ".join(f"avg({c}) AS {c}" for c in TOKENS)} FROM asked JOIN laid USING (symbol, bar) GROUP BY ALL)
    SELECT symbol, id, t, level, token, {O.r6('min(logp - own)', 'low')}, {O.r6('max(logp - own)', 'high')}, {", ".join(O.r6(f"avg({c})", c) for c in TOKENS[1:])} FROM steps JOIN owns USING (symbol, t) GROUP BY symbol, id, t, level, token""")
def pyramid_full(spark, sf_dir):
    """The four levels of a context of 43 200 seconds: 64, 64, 64 and 42 patches of 16 means a cursor, each summed up in a row."""
    found = grid.projected(tape(spark, sf_dir, bar=1)).withColumn("valid", F.col("valid").cast("int"))
    found = kept(found.select("symbol", "t", *TOKENS), "logs")
    asked = cursors(found, S.APART).join(found.select("symbol", "t", F.col("logp").alias("own")), ["symbol", "t"])
    tokens = around.pyramid(asked, found, S.FULL.CONTEXT, LEVELS, forecast.PATCH, list(TOKENS))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / forecast.PATCH
    return tokens.select("symbol", "id", "t", *(F.col(c).cast("long").alias(c) for c in ("level", "token")), r6(F.array_min("logp") - F.col("own")).alias("low"), r6(F.array_max("logp") - F.col("own")).alias("high"), *(r6(mean(c)).alias(c) for c in TOKENS[1:]))


#: The forecaster learns from cursors in the first three quarters of the tape.
_LEARNT = f"""examples AS (
        SELECT v.signal AS x, f.truth / (greatest(v.sig, 1e-8) * {2 ** 0.5 / (0.5 * 3.141592653589793) * S.HORIZON ** 0.5!r}) AS y FROM truth f JOIN vol v ON v.symbol = f.symbol AND v.t = f.t
        WHERE h = {S.HORIZON} AND f.t < (SELECT min(t) + (max(t) - min(t)) * 3 // 4 FROM tape)
    ), products AS (SELECT count(*) + 1e-6 AS n, sum(x) AS x, sum(x * x) + 1e-6 AS xx, sum(y) AS y, sum(x * y) AS xy FROM examples), learnt AS (SELECT (xx * y - x * xy) / (n * xx - x * x) AS level, (n * xy - x * y) / (n * xx - x * x) AS drift FROM products)"""


def learnt(spark: SparkSession, tape_: DataFrame) -> DataFrame:
    """Versions of a forecaster that learns from a stream of settled cursors, a batch for each file of them."""
    path = streams.place(spark)
    ends = tape_.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    asked = context.replay_times(tape_, S.CONTEXT, S.HORIZON, S.STRIDE, stop=ends["a"] + (ends["b"] - ends["a"]) * 3 // 4)
    at = asked.join(volatility(tape_).select("symbol", "t", "sig", "signal"), ["symbol", "t"])
    rows = train.examples(at, context.futures(asked, grid.projected(tape_), S.HORIZON), S.HORIZON)
    rows.repartitionByRange(4, "t").write.parquet(f"{path}/examples")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/examples")
    return train.learnt(stream, path)


@query(f"WITH RECURSIVE {O.volatility()}{O.cursors()}{O.truth()}, {_LEARNT} SELECT (SELECT count(*) FROM examples) AS n, round(level, 6) + 0.0 AS level, round(drift, 6) + 0.0 AS drift FROM learnt")
def online_training(spark, sf_dir):
    """What a forecaster has learnt at the end of a stream of settled cursors."""
    last = learnt(spark, kept(tape(spark, sf_dir), "tape")).agg(F.max_by(F.struct("n", "level", "drift"), "batch").alias("v"))
    return last.select(F.col("v.n").cast("long").alias("n"), r6(F.col("v.level")).alias("level"), r6(F.col("v.drift")).alias("drift"))


@query(f"""WITH RECURSIVE {O.volatility()}{O.cursors()}{O.truth()}, {_LEARNT}, every AS (
        SELECT c.symbol, c.t, v.sig, v.signal, model, lead FROM cursors c JOIN vol v ON v.symbol = c.symbol AND v.t = c.t, LATERAL (SELECT unnest(['walk', 'trend', 'fade', 'learnt']) AS model, unnest([0.0, 0.1 * v.signal, -0.1 * v.signal, (SELECT level FROM learnt) + (SELECT drift FROM learnt) * v.signal]) AS lead)
    ), each AS (
        SELECT model, e.symbol, e.t, sqrt(avg(power((lead * {2 ** 0.5!r} * sin(h / {S.HORIZON}.0 * (0.5 * pi())) / (0.5 * pi()) * greatest(sig, 1e-8) - truth / {S.HORIZON ** 0.5!r}) / greatest(sig, 1e-9), 2))) AS nrmse, any_value(sign(lead)) AS s, arg_max(sign(truth), h) AS ts
        FROM every e JOIN truth f ON f.symbol = e.symbol AND f.t = e.t GROUP BY model, e.symbol, e.t
    ) SELECT model, round(avg((s = ts)::INT) * 100, 2) AS dir_hit_pct, round(avg(nrmse), 4) AS path_nrmse FROM each GROUP BY model""")
def learnt_scorecard(spark, sf_dir):
    """The forecaster that learnt from the first three quarters beside those that don't learn."""
    tape_ = kept(tape(spark, sf_dir), "tape")
    last = learnt(spark, tape_).agg(F.max_by(F.struct("level", "drift"), "batch").alias("v")).select(F.lit("learnt").alias("model"), "v.drift", "v.level")
    models = spark.createDataFrame([(m, d, 0.0) for m, d in S.MODELS], "model string, drift double, level double").unionByName(last)
    paths = forecast.path_arrays(forecast.walk_arrays(seen(tape_), models, S.HORIZON, S.MODES), S.HORIZON)
    found = score.scores(paths, context.futures(cursors(tape_), grid.projected(tape_), S.HORIZON), S.HORIZON, S.ROLL)
    return score.scorecard(found).select("model", "dir_hit_pct", "path_nrmse")


@query("SELECT count(*) AS rows, true AS every_batch_rated FROM events")
def stream_throughput(spark, sf_dir):
    """Rows that a listener counted, batch by batch, while the events streamed through."""
    path = f"{streams.place(spark)}/counters"
    with train.Counters(spark, path) as counters:
        streams.drained(streams.events(spark, sf_dir).select("event_id"))
    return counters.rows().agg(F.sum("rows").alias("rows"), F.bool_and((F.col("rows") == 0) | (F.col("done") > 0)).alias("every_batch_rated"))


BAND = "band AS (SELECT f.symbol, f.t, h, avg(close * exp(greatest(least(path, 0.5), -0.5))) FILTER (WHERE q = 0) AS lower, avg(close * exp(greatest(least(path, 0.5), -0.5))) FILTER (WHERE q = 2) AS upper FROM forecasts f JOIN vol v ON v.t = f.t AND v.symbol = f.symbol GROUP BY f.symbol, f.t, h)"


@query(f"WITH RECURSIVE {O.forecasts()}, {BAND} SELECT symbol, t, h, round(lower, 4) AS lower, round(upper, 4) AS upper FROM band")
def ensemble_band(spark, sf_dir):
    tape_ = kept(tape(spark, sf_dir), "tape")
    found = score.band(forecasts(spark, tape_), tape_.select("symbol", "t", F.col("close").alias("price")))
    return found.select("symbol", "t", "h", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


def frames_sql(z=S) -> str:
    return f"""shown AS (
        SELECT c.symbol, c.t, count(*) FILTER (WHERE x.t <= c.t) AS n_past, count(*) FILTER (WHERE x.t > c.t) AS n_future, min(x.close) FILTER (WHERE x.t <= c.t) AS lo, max(x.close) FILTER (WHERE x.t <= c.t) AS hi
        FROM cursors c JOIN tape x ON x.symbol = c.symbol AND x.t BETWEEN c.t - {z.LOOKBACK} AND c.t + {z.HORIZON} GROUP BY c.symbol, c.t
    ), drawn AS (SELECT f.symbol, f.t, any_value(close) AS price, min(close * exp(greatest(least(path, 0.5), -0.5))) AS pl, max(close * exp(greatest(least(path, 0.5), -0.5))) AS ph FROM forecasts f JOIN vol v ON v.t = f.t AND v.symbol = f.symbol WHERE q = 1 GROUP BY f.symbol, f.t),
    b AS (SELECT symbol, t, min(lower) AS bl, max(upper) AS bh FROM band GROUP BY symbol, t), y AS (SELECT symbol, t, price, n_past, n_future, least(lo, pl, bl) AS y0, greatest(hi, ph, bh) AS y1 FROM shown JOIN drawn USING (symbol, t) JOIN b USING (symbol, t))
    SELECT symbol, t, price, n_past, n_future, round(y0 - greatest((y1 - y0) * 0.1, price * 2e-4), 4) AS y_low, round(y1 + greatest((y1 - y0) * 0.1, price * 2e-4), 4) AS y_high FROM y"""


def framed(spark: SparkSession, sf_dir: str, panel: bool = False) -> DataFrame:
    tape_ = kept(tape(spark, sf_dir, panel), "tape")
    made = kept(forecasts(spark, tape_), "forecasts")
    found = kept(score.scores(made, context.futures(cursors(tape_), grid.projected(tape_), S.HORIZON), S.HORIZON, S.ROLL), "scores")
    return score.frames(cursors(tape_), tape_, made, found, S.LOOKBACK, S.HORIZON)


@query(f"WITH RECURSIVE {O.forecasts()}, {BAND}, {frames_sql()}")
def frame_records(spark, sf_dir, panel=False):
    return framed(spark, sf_dir, panel).select("symbol", "t", "price", "n_past", "n_future", *(F.round(c, 4).alias(c) for c in ("y_low", "y_high")))


def _listed(x: str, order: str, where: str = "") -> str:
    return f"string_agg((round({x} * 10000))::BIGINT::VARCHAR, ',' ORDER BY {order}){where}"


_PRICED = "close * exp(greatest(least(path, 0.5), -0.5))"


@query(f"""WITH RECURSIVE {O.scored()}, {BAND}, near AS (
        SELECT c.symbol, c.t, {_listed("x.close", "x.t", " FILTER (WHERE x.t <= c.t)")} AS past, {_listed("x.close", "x.t", " FILTER (WHERE x.t > c.t)")} AS future
        FROM (SELECT *, unnest(generate_series(t - {S.LOOKBACK}, t + {S.HORIZON})) AS at FROM cursors) c JOIN tape x ON x.symbol = c.symbol AND x.t = c.at GROUP BY ALL
    ), drawn AS (SELECT f.symbol, f.t, {_listed(_PRICED, "model, h")} AS paths FROM forecasts f JOIN vol v ON v.t = f.t AND v.symbol = f.symbol WHERE q = 1 GROUP BY ALL),
    edged AS (SELECT symbol, t, {_listed("lower", "h")} AS lower, {_listed("upper", "h")} AS upper FROM band GROUP BY ALL),
    counted AS (SELECT model, symbol, t, count(*) OVER o AS n, sum(dir_hit) OVER o AS hits, roll_hit FROM scores WINDOW o AS (PARTITION BY model, symbol ORDER BY t ROWS UNBOUNDED PRECEDING)),
    said AS (SELECT symbol, t, string_agg(model || ':' || n || ':' || hits::BIGINT || ':' || (round(roll_hit * 10000))::BIGINT, ',' ORDER BY model) AS hits FROM counted GROUP BY ALL)
    SELECT * FROM near JOIN drawn USING (symbol, t) JOIN edged USING (symbol, t) JOIN said USING (symbol, t)""")
def frame_arrays(spark, sf_dir):
    """The whole record of each frame, its arrays in hundredths of a cent: what is drawn of past and future, paths, band and hits."""
    return listed_frames(framed(spark, sf_dir))


def listed_frames(frames: DataFrame) -> DataFrame:
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 10000).cast("long")), ",")
    hits = F.transform("models", lambda m: F.concat_ws(":", m["model"], m["n"].cast("string"), F.round(m["hit_so_far"] * m["n"]).cast("long").cast("string"), F.round(m["roll_hit"] * 10000).cast("long").cast("string")))
    return frames.select("symbol", "t", *(listed(c).alias(c) for c in ("past", "future", "lower", "upper")), listed(F.flatten("models.path")).alias("paths"), F.array_join(hits, ",").alias("hits"))


@query(f"WITH RECURSIVE {O.forecasts(True)}, {BAND}, {frames_sql()}")
def panel_frames(spark, sf_dir):
    """Frames of every symbol."""
    return frame_records(spark, sf_dir, True)


@query(f"WITH {O.window(True)} SELECT symbol, id, t, pos, valid, {', '.join(O.r6(x, x) for x in WINDOW)} FROM wide")
def panel_context(spark, sf_dir):
    """Contexts of the cursors of every symbol."""
    return context_window(spark, sf_dir, True)


@query(f"WITH {O.grid(True)}{O.cursors()}{O.truth()} SELECT id, symbol, t, h, {O.r6('truth', 'truth')} FROM truth")
def panel_settlement(spark, sf_dir):
    """What followed the cursors of every symbol."""
    return settle_paths(spark, sf_dir, True)


@query(f"WITH RECURSIVE {O.scored(True)} SELECT model, symbol, t, {', '.join(O.r6(x, x) for x in SCORES)}, {O.r6('100 * exp(-nrmse)', 'acc')}, {O.r6('100 * exp(-roll_nrmse)', 'roll_acc')}, {O.r6('100 * (1 - nrmse)', 'skill')} FROM scores")
def panel_scores(spark, sf_dir):
    """Scores of every model on every symbol."""
    return rounded(replay(spark, sf_dir, True), *SCORES, "acc", "roll_acc", "skill")


@query(f"WITH {O.grid()}{O.cursors()} SELECT symbol, t, id FROM cursors")
def replay_cursors(spark, sf_dir):
    return cursors(tape(spark, sf_dir))


@query("""WITH e AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), c AS (SELECT i, greatest(least(lo + i * ((hi - lo) // 16) + (i * 7919) % greatest((hi - lo) // 16, 1), hi), lo) AS t, lo, hi FROM e, generate_series(0, 15) a(i))
    SELECT i, t, CASE WHEN t + 30 > hi THEN lo + (i * 104729) % greatest(hi - lo - 1, 1) ELSE t + 30 END AS next_t, t + 30 <= hi AS cont, 30 * 16 * (i + 1) AS seen FROM c""")
def cursor_batch(spark, sf_dir):
    """Sixteen cursors over a range of keys, their next place, whether they went on, and the bars seen."""
    ends = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    i, lo, hi = F.col("i"), F.col("lo"), F.col("hi")
    placed = spark.range(16).withColumnRenamed("id", "i").crossJoin(F.broadcast(ends)).withColumn("t", context.batch_cursors(lo, hi, 16, i * 7919, i))
    return placed.select("i", "t", context.advanced(F.col("t"), 30, lo, hi, i * 104729).alias("next_t"), (F.col("t") + 30 <= hi).alias("cont"), (30 * 16 * (i + 1)).alias("seen"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END * CAST(epoch(o_orderdate) AS BIGINT) AS stamp FROM orders)
    SELECT id, stamp // CASE WHEN stamp > 100000000000000000 THEN 1000000000 WHEN stamp > 100000000000000 THEN 1000000 WHEN stamp > 100000000000 THEN 1000 ELSE 1 END AS sec FROM s""")
def timestamp_units(spark, sf_dir):
    """Stamps in four units, told apart by size."""
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    unit = F.element_at(F.array(*(F.lit(10**k) for k in (0, 3, 6, 9))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    at = grid.seconds(F.col("o_orderdate").cast("timestamp_ntz"))
    return orders.select(F.col("o_orderkey").alias("id"), grid.epoch_seconds(unit * at).alias("sec"))


@query("""WITH r AS (SELECT l_suppkey AS symbol, l_partkey AS t, l_quantity AS q, l_extendedprice AS p, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem)
    SELECT symbol, t, q, p FROM r WHERE n = 1""")
def last_write_wins(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").select(F.col("l_suppkey").alias("symbol"), F.col("l_partkey").alias("t"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), "l_orderkey", "l_linenumber")
    return grid.last_wins(rows, "l_orderkey", "l_linenumber", "q", "p").select("symbol", "t", "q", "p")


@query(f"WITH RECURSIVE {O.scored()}, logged AS (SELECT t, nrmse FROM scores WHERE model = 'walk'), o AS (SELECT 'walk' AS symbol, row_number() OVER (ORDER BY t) AS t, t AS stamp, nrmse FROM logged){O.averages('o', [recurrence.Average('ema', 'nrmse', 34.30961849, None)], 'm')} SELECT stamp AS t, {O.r6('ema', 'ema')} FROM m")
def metric_ema(spark, sf_dir):
    """The running 0.98 / 0.02 average of a logged metric, begun at its first value."""
    logged = recurrence.numbered(replay(spark, sf_dir).where("model = 'walk'").select(F.lit("walk").alias("symbol"), "t", "nrmse"), "symbol")
    logged = logged.select("symbol", F.col("t").alias("at"), F.col("n").alias("t"), F.floor(F.col("n") / grid.SPAN).alias("big"), "nrmse")
    steps = recurrence.averages(logged, [recurrence.Average("ema", "nrmse", 34.30961849, None)])
    return steps.select(F.col("at").alias("t"), r6(F.col("ema")).alias("ema"))


@query(f"WITH RECURSIVE {O.scored()} SELECT model, count(*) AS steps, {O.r6('avg(nrmse)', 'nrmse')}, {O.r6('avg(dir_hit)', 'hit')}, {O.r6('-avg(nrmse) + 0.5 * (avg(dir_hit) - 0.5)', 'reward')}, t // 1440 AS day FROM scores GROUP BY model, t // 1440")
def training_curves(spark, sf_dir):
    """Metrics by model over days."""
    return replay(spark, sf_dir).groupBy("model", F.floor(F.col("t") / 1440).alias("day")).agg(F.count("*").alias("steps"), r6(F.avg("nrmse")).alias("nrmse"), r6(F.avg("dir_hit")).alias("hit"), r6(-F.avg("nrmse") + 0.5 * (F.avg("dir_hit") - 0.5)).alias("reward"))


@query("SELECT * FROM (VALUES " + ", ".join(str((k, *v)) for k, v in forecast.RECIPES.items()) + ") r(name, width, layers, heads, n_basis, dropout, rate, stability, tilt, weight_decay)")
def recipes(spark, sf_dir):
    return forecast.recipes(spark)


@query()
def learning_rates(spark, sf_dir):
    """Linear warm-up, then a cosine down to a tenth."""
    s = F.col("id")
    cosine = 0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * F.least((s - 100) / 900.0, F.lit(1.0))))
    return spark.range(1100).select(s.alias("step"), F.round(3e-4 * F.when(s < 100, (s + 1) / 100).otherwise(cosine), 9).alias("lr"))


ORACLE_SQL["learning_rates"] = "SELECT s AS step, round(3e-4 * CASE WHEN s < 100 THEN (s + 1) / 100 ELSE 0.1 + 0.45 * (1 + cos(pi() * least((s - 100) / 900.0, 1.0))) END, 9) AS lr FROM generate_series(0, 1099) a(s)"


@query(f"""WITH RECURSIVE {O.logs()}, inputs AS (SELECT *, power(logp - coalesce(lag(logp) OVER (PARTITION BY symbol ORDER BY t), logp), 2) AS r2 FROM logs){O.averages("inputs", [recurrence.Average("var", "r2", 60)], "one")},
    v AS (SELECT symbol, t, greatest(least(ln(greatest(sqrt(greatest(var, 0.0)), 1e-9)) + 9.0, 8.0), -8.0) AS v FROM one) SELECT symbol, t, {O.r6("v", "by_plan")}, {O.r6("v", "by_blocks")}, false AS apart FROM v""")
def seam_check(spark, sf_dir):
    """One volatility by both forms of the averages, which cut a tape at different places: they must agree at every bar."""
    found = kept(tape(spark, sf_dir), "tape")
    back = recurrence.lags(grid.projected(found), "logp", [1]).withColumn("r2", (F.col("logp") - F.col("lag_1")) ** 2)
    plan = recurrence.averages(back, [recurrence.Average("var", "r2", 60)]).select("symbol", "t", clipped(F.ln(at_least(F.sqrt(at_least(F.col("var"), 0.0)), 1e-9)) + 9.0).alias("plan"))
    blocks = analyser.features(found, names=("logvol_60s",)).select("symbol", "t", "logvol_60s").join(plan, ["symbol", "t"])
    return blocks.select("symbol", "t", r6(F.col("plan")).alias("by_plan"), r6(F.col("logvol_60s")).alias("by_blocks"), (F.abs(F.col("plan") - F.col("logvol_60s")) > 1e-9).alias("apart"))


@query(f"""WITH RECURSIVE {O.volatility()}{O.cursors()} SELECT c.id, c.t, {O.r6("sig", "sigref")}, close AS price, {O.r6("signal", "ret_60s_z")} FROM cursors c JOIN vol v ON v.t = c.t AND v.symbol = c.symbol""")
def observe(spark, sf_dir):
    """What a cursor sees beside its window: the volatility at hand, the last price, a feature."""
    tape_ = tape(spark, sf_dir)
    return cursors(tape_).join(volatility(tape_), ["symbol", "t"]).select("id", "t", r6(F.col("sig")).alias("sigref"), F.col("close").alias("price"), r6(F.col("signal")).alias("ret_60s_z"))


@query(f"WITH RECURSIVE {O.scored()} SELECT model, t, count(*) OVER o AS n, {O.r6('avg(dir_hit) OVER o', 'hit_so_far')} FROM scores WINDOW o AS (PARTITION BY model ORDER BY t ROWS UNBOUNDED PRECEDING)")
def hit_history(spark, sf_dir):
    """Hits so far, as a frame shows them."""
    return score.hits_so_far(replay(spark, sf_dir)).select("model", "t", "n", r6(F.col("hit_so_far")).alias("hit_so_far"))


@query(f"WITH {O.grid()}{O.cursors()} SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM cursors) WHERE k % 5 = 0")
def frame_stride(spark, sf_dir):
    """Every fifth cursor."""
    return recurrence.numbered(cursors(tape(spark, sf_dir)), "symbol").where("n % 5 = 0").select("t")


@query(f"WITH {O.grid()}, e AS (SELECT max(t) AS b FROM tape) SELECT t, close, strftime(make_timestamp(t * 60000000), '%Y-%m-%d %H:%M:%S') AS utc, t * 60 - (t * 60) % 86400 AS day_start FROM tape, e WHERE t >= b - 2880 AND t < b - 1440")
def range_scan(spark, sf_dir):
    """A half-open range of bars, with their times and the beginnings of their days."""
    found = tape(spark, sf_dir)
    last = found.agg(F.max("t").alias("b"))
    sec = F.col("t") * 60
    inside = found.join(F.broadcast(last), (F.col("t") >= F.col("b") - 2880) & (F.col("t") < F.col("b") - 1440))
    return inside.select("t", "close", F.date_format((F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=sec)), "yyyy-MM-dd HH:mm:ss").alias("utc"), (sec - F.pmod(sec, F.lit(86400))).alias("day_start"))


@query(f"WITH {O.grid()} SELECT t, open, high, low, close, valid FROM tape WHERE t IN ((SELECT min(t) FROM tape), (SELECT max(t) FROM tape), (SELECT min(t) + 777 FROM tape))")
def point_lookup(spark, sf_dir):
    """Bars by time: the first, the last, and one between."""
    found = tape(spark, sf_dir)
    ends = found.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.array("a", "b", F.col("a") + 777)).alias("t"))
    return found.join(F.broadcast(ends.distinct()), "t").select("t", "open", "high", "low", "close", "valid")


@query(f"""WITH {O.grid(True)}, s AS (SELECT symbol, t // 1440 AS d, min(t) AS t0, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, sum(ntrades) AS ntrades FROM tape GROUP BY ALL)
    SELECT symbol, count(*) AS shards, sum(n)::BIGINT AS n, sum(n_valid)::BIGINT AS n_valid, sum(ntrades)::BIGINT AS ntrades, count(*) FILTER (WHERE n_valid > 0) AS at_hand FROM s GROUP BY symbol""")
def manifest_totals(spark, sf_dir):
    """Totals over shards of a day."""
    shards = tape(spark, sf_dir, True).groupBy("symbol", F.floor(F.col("t") / 1440).alias("d")).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.sum("ntrades").alias("ntrades"))
    return shards.groupBy("symbol").agg(F.count("*").alias("shards"), F.sum("n").alias("n"), F.sum("n_valid").alias("n_valid"), F.sum("ntrades").alias("ntrades"), F.count_if(F.col("n_valid") > 0).alias("at_hand"))


@query(f"""WITH {O.grid(True)} SELECT * FROM (SELECT symbol, t // 1440 AS stretch, count(*) FILTER (WHERE NOT valid) AS gaps, row_number() OVER (ORDER BY count(*) FILTER (WHERE NOT valid) DESC, symbol, t // 1440) AS place FROM tape GROUP BY symbol, t // 1440) WHERE place <= 6""")
def worst_gaps(spark, sf_dir):
    """The six stretches with most gaps: a top-k report."""
    found = grid.gaps(tape(spark, sf_dir, True), 1440).select("symbol", "stretch", (F.col("n") - F.col("n_valid")).alias("gaps")).orderBy(F.desc("gaps"), "symbol", "stretch").limit(6)
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("gaps"), "symbol", "stretch")).cast("long"))


@query(f"WITH {O.grid(True)} SELECT symbol, t, {R_FIELDS} FROM tape WHERE t % 2 = 0 UNION ALL SELECT symbol, t, {R_FIELDS} FROM tape WHERE t % 2 = 1")
def shard_union(spark, sf_dir):
    """Two halves of a tape put together again."""
    found = rounded(tape(spark, sf_dir, True), *FIELDS).select("symbol", "t", *FIELDS)
    return found.where(F.pmod(F.col("t"), F.lit(2)) == 0).unionByName(found.where(F.pmod(F.col("t"), F.lit(2)) == 1))


@query("SELECT i AS member, ['base', 'deep', 'wide', 'agile'][i % 4 + 1] || CASE WHEN i < 4 THEN '' ELSE (i // 4)::VARCHAR END AS name, [24, 32, 32, 40][i % 4 + 1] AS n_basis FROM generate_series(0, 9) a(i)")
def population(spark, sf_dir):
    """Ten members of a population of forecasters."""
    return forecast.population(spark, 10).select(F.col("member").cast("long").alias("member"), "name", "n_basis")


@query(f"WITH {O.grid()}, e AS (SELECT min(t) AS a, max(t) AS b FROM tape), d AS (SELECT greatest((t * 60 - (t * 60) % 86400) // 60, (SELECT a FROM e) + {S.CONTEXT} + 1) AS t0, max(t) AS last, count(*) AS n FROM tape GROUP BY (t * 60 - (t * 60) % 86400) // 60, greatest((t * 60 - (t * 60) % 86400) // 60, (SELECT a FROM e) + {S.CONTEXT} + 1)) SELECT t0, least(last + 1, (SELECT b FROM e) - {S.HORIZON} + 1) AS t1, n FROM d")
def sessions(spark, sf_dir):
    """Days as replay sessions, held within what has full context and a full future."""
    found = tape(spark, sf_dir).select("t", (F.col("t") - F.pmod(F.col("t"), F.lit(1440))).alias("day"))
    ends = found.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    days = found.groupBy("day").agg(F.max("t").alias("last"), F.count("*").alias("n")).crossJoin(F.broadcast(ends))
    return days.select(F.greatest("day", F.col("a") + S.CONTEXT + 1).alias("t0"), F.least(F.col("last") + 1, F.col("b") - S.HORIZON + 1).alias("t1"), "n")

"""The 59 causal features of every bar.

``flows`` gives what averages are taken of, ``FORMULAS`` each feature from averages, lags and flows; both are over arrays, and are
shared by the batch plan and the stream. The batch plan cuts a tape into its blocks of ``SPAN`` bars, shows each block as many bars
of the block before as the longest lag needs, and goes over them twice: once for what a block hands on, a row for each block,
which is folded by symbol; once for the features.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scalars import EPS, decay
from tapeworks.operators.grid import SPAN
from tapeworks.operators.recurrence import Average, running

# fixed values: horizons and half-lives in bars
RETURNS = (1, 5, 15, 60, 300, 900, 3600, 10800, 43200)
VOLATILITY = (10, 60, 300, 1800, 7200)
TREND = (60, 300, 1800, 7200, 43200)
FLOW = (30, 300, 3600)
RANGE = (60, 900, 7200)
ILLIQUIDITY = (300, 3600)
DAY = 86_400
LAGS = tuple(sorted({*RETURNS, 120}))
BOUND = 8.0

FIRST = [
    *(Average(f"var_{h}", "r2", h) for h in VOLATILITY),
    *(Average(f"trend_{h}", "logp", h, None) for h in TREND),
    *(Average(f"range_{h}", "hl", h) for h in RANGE),
    *(Average(f"lv_{h}", "lv", h) for h in (60, 300, 3600, 43200)),
    *(Average(f"ln_{h}", "ln", h) for h in (60, 3600)),
    *(Average(f"imb_{h}", "imb", h) for h in FLOW),
    *(Average(f"sv_{h}", "sv", h) for h in FLOW),
    *(Average(f"sv2_{h}", "sv2", h) for h in FLOW),
    *(Average(f"qv_{h}", "qv", h) for h in RANGE),
    *(Average(f"bv_{h}", "bv", h) for h in RANGE),
    *(Average(f"ami_{h}", "ami", h) for h in ILLIQUIDITY),
    Average("ok_300", "ok", 300, 1.0),
    Average("up_900", "up", 900),
    Average("down_900", "down", 900),
]
#: Averages of squared deviations: name, the flow, and the average of it that it deviates from.
SECOND = [(Average("lv_dev", "lv", 3600), "lv_3600"), (Average("ln_dev", "ln", 3600), "ln_3600")]
INPUTS = ("close", "high", "low", "vol", "qvol", "ntrades", "takerfrac", "valid")

most = np.maximum


def flows(bar: dict, logp: np.ndarray, back: np.ndarray) -> dict[str, np.ndarray]:
    """What the averages are taken of. bar: the columns in INPUTS; back: the log price a bar ago."""
    vol, qv, r1 = bar["vol"], most(bar["qvol"], 0), logp - back
    lv, imb = np.log1p(most(vol, 0)), np.where(vol > 0, (bar["takerfrac"] - 0.5) * 2, 0.0)
    signed = imb * lv
    return {
        "logp": logp, "close": bar["close"], "r2": r1 * r1, "up": most(r1, 0), "down": most(-r1, 0), "ami": np.abs(r1) / most(qv, 1), "hl": np.log(most(bar["high"], EPS) / most(bar["low"], EPS)), "ok": bar["valid"],
        "lv": lv, "ln": np.log1p(most(bar["ntrades"], 0)), "imb": imb, "sv": signed, "sv2": signed * signed, "qv": qv, "bv": most(vol, 0),
    }


def sigma(v, h):
    return np.sqrt(most(v[f"var_{h}"], 0))


def walk(v, h):
    """How far a walk at the volatility at hand goes in h bars."""
    return most(sigma(v, 300), 1e-7) * math.sqrt(h)


def ret(v, k):
    return v["logp"] - v[f"lag_{k}"]


def log_of(x, floor):
    return np.log(most(x, floor))


def root(x):
    return np.sqrt(most(x, 1e-9))


def vwap_gap(v, h):
    volume, close = v[f"bv_{h}"], v["close"]
    vwap = np.where(volume > EPS, v[f"qv_{h}"] / most(volume, EPS), close)
    return np.log(most(close, EPS) / most(vwap, EPS)) / walk(v, h)


def turn(share, wave):
    return wave(2 * np.pi * share)


#: Each feature by name, in order, from logp, close, clock (seconds since 1970), lags, averages and flows.
FORMULAS: dict[str, Callable] = (
    {f"ret_{k}s_z": lambda v, k=k: ret(v, k) / walk(v, k) for k in RETURNS}
    | {f"ret_{k}s_tanh": lambda v, k=k: np.tanh(ret(v, k) * 200.0) for k in RETURNS}
    | {f"logvol_{h}s": lambda v, h=h: log_of(sigma(v, h), 1e-9) + 9.0 for h in VOLATILITY}
    | {f"volratio_{a}_{b}": lambda v, a=a, b=b: log_of(sigma(v, a), 1e-9) - log_of(sigma(v, b), 1e-9) for a, b in zip(VOLATILITY, VOLATILITY[1:])}
    | {f"trend_z_{h}s": lambda v, h=h: (v["logp"] - v[f"trend_{h}"]) / walk(v, h) for h in TREND}
    | {f"range_{h}s": lambda v, h=h: log_of(v[f"range_{h}"], 1e-9) + 9.0 for h in RANGE}
    | {
        "vol_z": lambda v: (v["lv"] - v["lv_3600"]) / root(v["lv_dev"]),
        "logvol_ratio_60_3600": lambda v: v["lv_60"] - v["lv_3600"],
        "logvol_ratio_300_43200": lambda v: v["lv_300"] - v["lv_43200"],
        "ntrades_z": lambda v: (v["ln"] - v["ln_3600"]) / root(v["ln_dev"]),
        "ntrades_ratio_60_3600": lambda v: v["ln_60"] - v["ln_3600"],
    }
    | {f"flow_imb_{h}s": lambda v, h=h: v[f"imb_{h}"] for h in FLOW}
    | {f"signed_vol_{h}s": lambda v, h=h: v[f"sv_{h}"] / root(v[f"sv2_{h}"]) for h in FLOW}
    | {f"vwap_dev_{h}s": lambda v, h=h: vwap_gap(v, h) for h in RANGE}
    | {f"amihud_{h}s": lambda v, h=h: log_of(v[f"ami_{h}"], 1e-15) + 18.0 for h in ILLIQUIDITY}
    | {
        "tod_sin": lambda v: turn(v["clock"] % DAY / DAY, np.sin),
        "tod_cos": lambda v: turn(v["clock"] % DAY / DAY, np.cos),
        "dow_sin": lambda v: turn(v["clock"] // DAY % 7 / 7.0, np.sin),
        "dow_cos": lambda v: turn(v["clock"] // DAY % 7 / 7.0, np.cos),
        "valid_frac_300s": lambda v: v["ok_300"],
        "gap_flag": lambda v: 1.0 - v["ok"],
        "accel_60s": lambda v: (2 * ret(v, 60) - ret(v, 120)) / walk(v, 60),
        "rsi_900s": lambda v: (v["up_900"] - v["down_900"]) / most(v["up_900"] + v["down_900"], 1e-12),
    }
)
NAMES = tuple(FORMULAS)


class Asked(dict):
    """Takes down which values a formula reads."""

    def __missing__(self, name):
        self[name] = np.ones(1)
        return self[name]


class Wanted:
    """The averages and lags that some features need."""

    def __init__(self, names: tuple[str, ...]):
        seen = Asked()
        for n in names:
            FORMULAS[n](seen)
        self.names, self.lags = names, [k for k in LAGS if f"lag_{k}" in seen]
        self.second = [(s, of) for s, of in SECOND if s.name in seen]
        self.first = [s for s in FIRST if s.name in seen or s.name in {of for _, of in self.second}]
        self.reach = max(self.lags, default=1)

    @property
    def start(self) -> np.ndarray:
        """The averages before the first bar; nan for those that begin at it."""
        return np.array([math.nan if s.first is None else s.first for s in (*self.first, *(s for s, _ in self.second))])

    def averages(self, x: dict, start: np.ndarray) -> dict[str, np.ndarray]:
        """All averages after each bar, from those before the first."""
        out = {s.name: running(x[s.of], s.halflife, x[s.of][0] if math.isnan(y) else y) for s, y in zip(self.first, start)}
        deviations = {s.name: running((x[s.of] - out[of]) ** 2, s.halflife, y) for (s, of), y in zip(self.second, start[len(self.first) :])}
        return out | deviations

    def after(self, x: dict, start: np.ndarray) -> np.ndarray:
        """All averages after the last bar, from those before the first."""
        found = self.averages(x, start)
        return np.array([found[s.name][-1] for s in (*self.first, *(s for s, _ in self.second))])

    def values(self, bar: dict, logs: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """All that formulas read but the clock. logs: log prices of the bars before these, then theirs; before them all, the first."""
        n = len(bar["close"])
        lag = {k: logs[np.maximum(np.arange(len(logs) - n, len(logs)) - k, 0)] for k in {1, *self.lags}}
        x = flows(bar, logs[len(logs) - n :], lag[1])
        return x | {f"lag_{k}": lag[k] for k in self.lags} | self.averages(x, start)

    def features(self, v: dict) -> dict[str, np.ndarray]:
        """nan becomes 0, the rest is held within BOUND."""
        with np.errstate(all="ignore"):
            return {n: np.clip(np.nan_to_num(FORMULAS[n](v), nan=0.0, posinf=BOUND, neginf=-BOUND), -BOUND, BOUND) for n in self.names}


def arrays(table: pa.Table) -> tuple[dict, np.ndarray]:
    """The columns of a block's own bars in order of time, and the log prices of the bars shown before them."""
    table = table.sort_by("t")
    home = table.column("home").to_numpy()
    columns = {c: table.column(c).to_numpy()[home].astype(np.float64) for c in INPUTS}
    return columns | {c: table.column(c).to_numpy()[home] for c in ("t", "clock")}, log_of(table.column("close").to_numpy()[~home], EPS)


def handed_on(wanted: Wanted):
    """For applyInArrow over a block: its averages as begun at nought, and sums by which a later fold finds those of deviations."""

    def run(rows: pa.Table) -> pa.Table:
        bar, before = arrays(rows)
        n, ends, rest = len(bar["t"]), [], []
        if n:
            own = log_of(bar["close"], EPS)
            x = flows(bar, own, np.append(before[-1:] if len(before) else own[:1], own[:-1]))
            local = {s.name: running(x[s.of], s.halflife, 0.0) for s in wanted.first}
            ends = [local[s.name][-1] for s in wanted.first]
            for s, of in wanted.second:
                # with c before the block, the average is local + fade * c, so its squared deviation is a quadratic of c
                apart, fade = x[s.of] - local[of], decay(s.halflife) ** np.arange(1, n + 1)
                rest += [running(y, s.halflife, 0.0)[-1] for y in (apart**2, -2 * apart * fade, fade**2)]
        first = [x[s.of][0] for s in wanted.first] if n else []
        return pa.table({"symbol": rows.column("symbol").slice(0, 1), "big": rows.column("big").slice(0, 1), "n": [n], "ends": [ends], "rest": pa.array([rest], pa.list_(pa.float64())), "first": [first]}, schema=HANDED)

    return run


HANDED = pa.schema([("symbol", pa.string()), ("big", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.float64())), ("rest", pa.list_(pa.float64())), ("first", pa.list_(pa.float64()))])


def fold(wanted: Wanted):
    """For applyInPandas over a symbol's blocks: the averages before each."""
    kept = np.array([decay(s.halflife) for s in (*wanted.first, *(s for s, _ in wanted.second))])
    of = [[s.name for s in wanted.first].index(name) for _, name in wanted.second]
    k = len(wanted.first)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, y, out = rows[rows["n"] > 0].sort_values("big"), wanted.start, []
        for n, ends, rest, first in zip(rows["n"], rows["ends"], rows["rest"], rows["first"]):
            y[:k] = np.where(np.isnan(y[:k]), first, y[:k])
            out.append(y.copy())
            sums = np.array(rest, float).reshape(-1, 3)
            c = y[of]
            y = y * kept**n + np.concatenate([ends, sums[:, 0] + sums[:, 1] * c + sums[:, 2] * c * c])
        return pd.DataFrame({"symbol": rows["symbol"], "big": rows["big"], "start": [x.tolist() for x in out]})

    return run


def block_features(wanted: Wanted, shape: pa.Schema):
    """For cogrouped blocks and their starts."""

    def run(rows: pa.Table, starts: pa.Table) -> pa.Table:
        bar, before = arrays(rows)
        n = len(bar["t"])
        if not n:
            return shape.empty_table()
        own = log_of(bar["close"], EPS)
        start = np.array(starts.column("start")[0].as_py()) if len(starts) else wanted.start
        v = wanted.values(bar, np.append(before, own), start) | {"clock": bar["clock"]}
        place = {c: pa.repeat(rows.column(c)[0], n) for c in ("symbol", "big")}
        found = place | {"t": bar["t"], "close": bar["close"], "logp": own, "valid": bar["valid"] > 0} | wanted.features(v)
        return pa.table([found[c] for c in shape.names], schema=shape)

    return run


def features(tape: DataFrame, clock: Column | None = None, names: tuple[str, ...] = NAMES) -> DataFrame:
    """symbol, big, t, close, logp, valid and the named features. tape: a filled grid (symbol, big, t, close, high, low, vol, ...).

    clock: seconds since 1970 of the bar, t if not given. Only averages and lags that these features use are made.
    """
    wanted = Wanted(tuple(names))
    if wanted.reach > SPAN:
        raise ValueError(f"lags look back {SPAN} bars at most")
    numbers = [F.col(c).cast("double").alias(c) for c in INPUTS if c != "valid"]
    own = tape.select(F.col("symbol").cast("string").alias("symbol"), F.col("big").cast("long").alias("big"), F.col("t").cast("long").alias("t"), (F.col("t") if clock is None else clock).cast("long").alias("clock"), *numbers, F.col("valid").cast("double").alias("valid"))
    late = F.col("t") >= (F.col("big") + 1) * SPAN - wanted.reach  # what the next block looks back on
    home = F.explode(F.when(late, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("home")
    shown = own.select("*", home).withColumn("big", F.when(F.col("home"), F.col("big")).otherwise(F.col("big") + 1)).repartition("symbol", "big")
    blocks = shown.groupBy("symbol", "big")
    shape = pa.schema([("symbol", pa.string()), ("big", pa.int64()), ("t", pa.int64()), ("close", pa.float64()), ("logp", pa.float64()), ("valid", pa.bool_()), *((n, pa.float64()) for n in wanted.names)])
    ends = blocks.applyInArrow(handed_on(wanted), "symbol string, big long, n long, ends array<double>, rest array<double>, first array<double>")
    starts = ends.groupBy("symbol").applyInPandas(fold(wanted), "symbol string, big long, start array<double>")
    made = ", ".join(["symbol string, big long, t long, close double, logp double, valid boolean", *(f"`{n}` double" for n in wanted.names)])
    return blocks.cogroup(starts.groupBy("symbol", "big")).applyInArrow(block_features(wanted, shape), made)

"""The 59 features as a stateful stream: one bar in, one row out, gaps filled, late bars dropped.

State for a symbol is its last bar, the running averages, and the log prices of the longest lag. A micro-batch is one more block to
the formulas of the batch plan, begun at the averages held, so that both agree to rounding. Bars of a micro-batch are put in order
first; a bar not later than the last one seen is late and dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeworks.functions.scalars import EPS
from tapeworks.operators import analyser as A
from tapeworks.operators.grid import seconds

WHOLE = A.Wanted(A.NAMES)
KEPT = max(A.LAGS)
STATE = "t long, close double, means array<double>, logs binary"
OUTPUT = "symbol string, t long, close double, valid boolean, " + ", ".join(f"`{n}` double" for n in A.NAMES)


def dense(bars: pd.DataFrame, t: int | None, close: float | None) -> pd.DataFrame:
    """Bars later than t in order, the last of each time, with flat candles in the gaps (from t on, if there is one)."""
    bars = bars.sort_values("t", kind="stable").drop_duplicates("t", keep="last")
    if t is not None:
        bars = bars[bars["t"] > t]
    if not len(bars):
        return bars
    whole = bars.set_index("t").reindex(np.arange(bars["t"].iloc[0] if t is None else t + 1, bars["t"].iloc[-1] + 1))
    whole["valid"] = whole["close"].notna()
    before = whole["close"].ffill()
    whole["close"] = before if close is None else before.fillna(close)
    for c in ("open", "high", "low"):
        whole[c] = whole[c].fillna(whole["close"])
    return whole.fillna({c: 0.0 for c in ("vol", "qvol", "ntrades", "takerfrac")}).reset_index(names="t")


def advance(bars: pd.DataFrame, state: tuple | None, bar: int) -> tuple[pd.DataFrame, tuple | None]:
    """Rows for the bars, and the next state (t, close, averages, log prices of the longest lag)."""
    t, close, means, logs = state or (None, None, WHOLE.start, np.empty(0))
    bars = dense(bars, t, close)
    if not len(bars):
        return pd.DataFrame(), state
    columns = {c: bars[c].to_numpy(float) for c in A.INPUTS}
    logs = np.append(logs, A.log_of(columns["close"], EPS))
    v = WHOLE.values(columns, logs, means) | {"clock": bars["t"].to_numpy() * bar}
    found = pd.DataFrame({"t": bars["t"], "close": bars["close"], "valid": bars["valid"], **WHOLE.features(v)})
    means = np.array([v[s.name][-1] for s in (*WHOLE.first, *(s for s, _ in WHOLE.second))])
    return found, (int(bars["t"].iloc[-1]), float(bars["close"].iloc[-1]), means, logs[-KEPT:])


def features(bars: DataFrame, bar: int = 60) -> DataFrame:
    """Features of a stream of bars (symbol, t, open, high, low, close, vol, qvol, ntrades, takerfrac)."""

    def step(key, batches, state: GroupState):
        found = None
        if state.exists:
            t, close, means, logs = state.get
            found = (t, close, np.array(means), np.frombuffer(logs))
        out, found = advance(pd.concat(list(batches)), found, bar)
        if found is not None:
            state.update((found[0], found[1], found[2].tolist(), found[3].tobytes()))
        if len(out):
            yield out.assign(symbol=key[0])[["symbol", "t", "close", "valid", *A.NAMES]]

    return bars.groupBy("symbol").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def bars(events: DataFrame, bar: int = 60, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of events (event_id, ts, event_type, value), each given out once no event can be added to it."""
    stamped = events.withColumn("at", F.timestamp_seconds(seconds(F.col("ts")))).withColumn("price", F.col("value") + 1000.0)
    order = F.struct("ts", "event_id")
    grouped = stamped.withWatermark("at", late).groupBy(F.window("at", f"{bar} seconds").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("value").alias("vol"), F.sum(F.col("value") * F.col("price")).alias("qvol"), F.count("*").cast("double").alias("ntrades"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("tb"),
    )
    share = F.rint(F.when(F.col("vol") > 0, F.least(F.greatest(F.col("tb") / F.greatest("vol", F.lit(EPS)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0) * 65535.0) / 65535.0
    return grouped.select(
        F.lit("ALL").alias("symbol"), F.floor(F.unix_seconds("w.start") / bar).alias("t"), *((F.rint(F.col(c) * 100) / 100).alias(c) for c in ("open", "high", "low", "close")),
        (F.rint(F.col("vol") * 1e5) / 1e5).alias("vol"), F.rint("qvol").alias("qvol"), "ntrades", share.alias("takerfrac"),
    )

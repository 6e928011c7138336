"""The 59 features of many symbols as one stream, from ticks: bars close by event time, and gaps fill when nothing arrives.

Three steps. Ticks become bars in a windowed aggregation with partial sums, so that they never meet by symbol, however many they
are; it gives out a bar once the watermark has passed its end. Closed bars meet by symbol in ``Panel``, which puts those of a batch
in order and fills gaps. Its state lies in RocksDB: the last bar with the running averages, and the log prices that lags look back
on, in chunks of ``CHUNK`` bars under their number, so that a batch writes the chunks it adds to and drops those no lag reaches, and
leaves the rest alone. A timer at the end of each symbol's next bar fires once the watermark has passed it, whether or not the
symbol has had ticks: every symbol's tape runs to the same bar. ``Panel`` carries averages only, and gives out blocks of ``AT_ONCE``
bars with what stood before them; the blocks are dealt out by symbol and time, and their features are made wherever they land.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeworks.functions.scalars import EPS
from tapeworks.operators import analyser as A
from tapeworks.operators import grid
from tapeworks.operators.grid import seconds
from tapeworks.sources.events import LIFT
from tapeworks.streaming.analyser import KEPT, OUTPUT, WHOLE, dense

CHUNK = 1_440
#: Bars in a block that is given out.
AT_ONCE = 20_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bars from ``first`` on, a row for each of INPUTS; the averages and log prices before them.
BLOCK = "symbol string, first long, bars binary, start binary, logs binary"
COLUMNS = ["t", *grid.PRICES, "vol", "qvol", "ntrades", "takerfrac"]


def until(bars: pd.DataFrame, last: int) -> pd.DataFrame:
    """The bars, with an empty place for the last one if there is none, so that the gap before it fills."""
    if not len(bars) or bars["t"].iloc[-1] < last:
        empty = pd.DataFrame([{"t": last} | dict.fromkeys(bars.columns.drop("t"), np.nan)])
        bars = pd.concat([bars, empty]) if len(bars) else empty
    return bars


class Panel(StatefulProcessor):
    def __init__(self, bar: int):
        self.bar = bar

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, close double, means array<double>")
        self.logs = handle.getMapState("logs", "chunk long", "first long, logs binary")

    def end_of(self, t: int) -> int:
        """A timer's time, in ms: it fires once the watermark has reached the end of bar t."""
        return (t + 1) * self.bar * 1000 - 1

    def ended(self, timerValues) -> int:
        """The last bar that has ended."""
        return timerValues.getCurrentWatermarkInMs() // (self.bar * 1000) - 1

    def handleInputRows(self, key, rows, timerValues):
        begun, last = self.last.exists(), self.ended(timerValues)
        bars = pd.concat([part[COLUMNS] for part in rows]).astype(dict.fromkeys(COLUMNS[1:], float)).sort_values("t", ignore_index=True)
        yield from self.closed(key[0], bars, max(last, int(bars["t"].iloc[-1])))
        if not begun:
            self.handle.registerTimer(self.end_of(self.last.get()[0] + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.ended(timerValues)
        yield from self.closed(key[0], pd.DataFrame(columns=COLUMNS), last)
        self.handle.registerTimer(self.end_of(max(last + 1, int(expiredTimerInfo.getExpiryTimeInMs() // (self.bar * 1000)))))

    def closed(self, symbol: str, bars: pd.DataFrame, last: int):
        """Blocks of the bars up to ``last``. bars: those that closed since, in order."""
        if self.last.exists() and self.last.get()[0] >= last:
            return
        t, close, means, logs = self.history() or (int(bars["t"].iloc[0]) - 1, None, WHOLE.start, np.empty(0))  # the tape begins with its first bar
        times, begun, made = bars["t"].to_numpy(np.int64), t + 1, []
        while t < last:
            to = min(last, t + AT_ONCE)
            own = dense(until(bars.iloc[slice(*np.searchsorted(times, [t, to], side="right"))], to), None if close is None else t, close)
            columns = {c: own[c].to_numpy(float) for c in A.INPUTS}
            yield pd.DataFrame({"symbol": [symbol], "first": [t + 1], "bars": [np.stack([columns[c] for c in A.INPUTS]).tobytes()], "start": [means.tobytes()], "logs": [logs.tobytes()]})
            new = A.log_of(columns["close"], EPS)
            means = WHOLE.after(A.flows(columns, new, np.append(logs[-1:] if len(logs) else new[:1], new[:-1])), means)
            t, close, logs = to, float(columns["close"][-1]), np.append(logs, new)[-KEPT:]
            made.append(new)
        self.keep(begun, np.concatenate(made), (t, close, means, logs))

    def history(self):
        """What ``advance`` goes on from: the last bar, the averages, and the log prices of the longest lag."""
        if not self.last.exists():
            return None
        t, close, means = self.last.get()
        parts = sorted((first, np.frombuffer(raw)) for _, (first, raw) in self.logs.iterator())
        return t, close, np.array(means), np.concatenate([x for _, x in parts])[-KEPT:]

    def keep(self, first: int, logs: np.ndarray, state: tuple) -> None:
        t, close, means, _ = state
        self.last.update((t, close, [float(x) for x in means]))
        at = first
        if len(logs) > KEPT + CHUNK:  # the rest is out of reach of every lag already
            at, logs = t - KEPT - CHUNK + 1, logs[-KEPT - CHUNK :]
        while len(logs):
            chunk = at // CHUNK
            size = min(len(logs), (chunk + 1) * CHUNK - at)
            held = self.logs.getValue((chunk,)) if self.logs.containsKey((chunk,)) else None
            begun, before = (held[0], np.frombuffer(held[1])) if held else (at, np.empty(0))
            self.logs.updateValue((chunk,), (begun, np.append(before, logs[:size]).tobytes()))
            at, logs = at + size, logs[size:]
        for (chunk,) in list(self.logs.keys()):
            if (chunk + 1) * CHUNK <= t - KEPT:
                self.logs.removeKey((chunk,))

    def close(self) -> None:
        pass


def ticks(events: DataFrame, bar: int = 60, late: str = "10 minutes") -> DataFrame:
    """A stream of events (event_id, ts, event_type, value) as ticks of a symbol for each type."""
    known = events.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("event_type").isNotNull())
    sec = seconds(F.col("ts"))
    taker = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    found = known.select(
        F.timestamp_seconds(sec).alias("stamp"), F.col("event_type").alias("symbol"), F.floor(sec / bar).cast("long").alias("t"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("event_id").cast("long").alias("event_id"), (F.col("value") + LIFT).alias("price"), F.col("value").alias("size"), taker.alias("taker"),
    )
    return found.withWatermark("stamp", late)


def bars(ticks: DataFrame, bar: int = 60) -> DataFrame:
    """Bars of every symbol, each given out once no tick can be added to it, with the time of its end."""
    found = grid.bars(ticks.withColumn("t", F.window("stamp", f"{bar} seconds")).withColumn("at", F.struct("at", "event_id")))
    return found.withColumn("stamp", F.window_time("t")).withColumn("t", F.floor(F.unix_seconds("t.start") / bar).cast("long"))


def block_features(bar: int):
    """For mapInArrow over blocks: the features of each bar."""
    kinds = pa.schema([("symbol", pa.string()), ("t", pa.int64()), ("close", pa.float64()), ("valid", pa.bool_()), *((n, pa.float64()) for n in A.NAMES)])

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                symbol, first, bars, start, logs = (batch.column(k)[row].as_py() for k in range(5))
                columns = dict(zip(A.INPUTS, np.frombuffer(bars).reshape(len(A.INPUTS), -1)))
                t = np.arange(first, first + len(columns["close"]))
                v = WHOLE.values(columns, np.append(np.frombuffer(logs), A.log_of(columns["close"], EPS)), np.frombuffer(start)) | {"clock": t * bar}
                found = {"symbol": pa.repeat(symbol, len(t)), "t": t, "close": columns["close"], "valid": columns["valid"] > 0} | WHOLE.features(v)
                yield pa.RecordBatch.from_arrays([pa.array(found[c], x) if isinstance(found[c], np.ndarray) else found[c] for c, x in zip(kinds.names, kinds.types)], schema=kinds)

    return run


def features(ticks: DataFrame, bar: int = 60) -> DataFrame:
    """Features of every symbol's closed bars. The session's state store must be RocksDB (``PROVIDER``) when the stream starts."""
    blocks = bars(ticks, bar).groupBy("symbol").transformWithStateInPandas(Panel(bar), BLOCK, "append", "EventTime")
    return blocks.repartition("symbol", "first").mapInArrow(block_features(bar), OUTPUT)

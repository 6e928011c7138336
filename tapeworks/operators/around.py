"""What lies around a cursor, as arrays: slices of the tape, and means of it at several scales.

Cursors and tape meet block by block: a block is shown as many bars of its neighbours as slices reach, so that each cursor's
slice lies in one array. A slice of any length is one index into that array, and a mean over any span the difference of two
of its running sums; no context is ever laid out a row a bar. Results leave a task some cursors at a time.

The tape is dense (symbol, t, ...), as ``grid.filled`` makes it. Cursors are (symbol, t, id) and whatever else is to be kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.grid import SPAN

#: Numbers of a result made at once.
AT_ONCE = 4_000_000
#: Bars in the smallest block.
LEAST = 7_200


def met(cursors: DataFrame, tape: DataFrame, before: int, after: int, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """``work`` on every block: (bars' first t, columns as arrays, cursors as a table) to record batches of ``schema``.

    A cursor's block holds ``before`` bars before and ``after`` bars after it, as far as the tape goes.
    """
    span = max(LEAST, min(SPAN, 4 * (before + after)), before, after)
    kept = [c for c in cursors.columns if c not in ("symbol", "t")]
    own = F.floor(F.col("t") / span)
    at = F.col("t") - own * span
    near = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= span - before, own + 1)))
    bars = tape.select("symbol", "t", F.explode(near).alias("__block"), *(F.col(c).cast("double").alias(f"__{c}") for c in columns)).withColumn("__bar", F.lit(True))
    asked = cursors.select("symbol", "t", own.alias("__block"), *kept).withColumn("__bar", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        is_bar = rows.column("__bar")
        tape = rows.filter(is_bar).select(["t", *(f"__{c}" for c in columns)]).sort_by("t")
        asking = rows.filter(pa.compute.invert(is_bar)).select(["symbol", "t", *kept])
        t = tape.column("t").to_numpy()
        if not len(t) or not len(asking):
            return
        if t[-1] - t[0] != len(t) - 1:
            raise ValueError("the tape must hold every bar once")
        yield from work(int(t[0]), {c: tape.column(f"__{c}").to_numpy() for c in columns}, asking)

    both = bars.unionByName(asked, allowMissingColumns=True)
    return both.groupBy("symbol", "__block").applyInArrow(run, schema)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def schema_of(cursors: DataFrame, columns: list[str]) -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cursors.schema)
    return f"{kept}, " + ", ".join(columns)


def slices(cursors: DataFrame, tape: DataFrame, first: int, last: int, columns: list[str], partial: bool = False) -> DataFrame:
    """The cursors with, for each column, an array of its values from ``first`` to ``last`` bars after the cursor.

    Cursors whose slice isn't whole are left out, or with ``partial`` have what there is of it. Null values are nan.
    """
    width, names = last - first + 1, [f.name for f in cursors.schema]

    def work(start: int, data: dict, asking: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(data.values())))
        at = asking.column("t").to_numpy() - start
        whole = (at + first >= 0) & (at + last < n)
        if not partial:
            asking, at = asking.filter(pa.array(whole)), at[whole]
        step = max(1, AT_ONCE // (width * len(columns)))
        for i in range(0, len(at), step):
            place = at[i : i + step, None] + np.arange(first, last + 1)
            there = (place >= 0) & (place < n)
            sizes, place = there.sum(axis=1), place[there]
            yield pa.RecordBatch.from_arrays([*(asking.slice(i, step).column(c).combine_chunks() for c in names), *(lists(data[c][place], sizes) for c in columns)], names=[*names, *columns])

    return met(cursors, tape, max(0, -first), max(0, last), columns, work, schema_of(cursors, [f"`{c}` array<double>" for c in columns]))


def pyramid(cursors: DataFrame, tape: DataFrame, length: int, levels: tuple, patch: int, columns: list[str]) -> DataFrame:
    """Tokens of a context at several scales: the cursors with level, token and, for each column, an array of ``patch`` means.

    levels: (span, stride) in bars. A level cuts the last ``span`` bars, at most ``length``, into means of ``stride`` bars, oldest
    first; what is left over at the newest end is dropped, and so are means before the last whole patches. Columns are
    taken as they are; subtract the cursor's own price from means of prices where they are to be relative to it.
    """
    names = [f.name for f in cursors.schema]
    plan = []
    for level, (span, stride) in enumerate(levels):
        span = min(span, length)
        tokens = span // stride // patch
        if tokens < 1:
            raise ValueError(f"level {level} (span {span}, stride {stride}) gives no patch of {patch}")
        plan.append((level, tokens, 1 - span + (span // stride - tokens * patch) * stride + np.arange(tokens * patch + 1) * stride, stride))
    every = sum(tokens for _, tokens, *_ in plan)

    def work(start: int, data: dict, asking: pa.Table) -> Iterator[pa.RecordBatch]:
        # sums of what a column is above its first value, in extended precision: differences of long sums keep their digits
        sums = {c: np.concatenate([[0.0], np.cumsum((x - x[0]).astype(np.longdouble))]) for c, x in data.items()}
        at = asking.column("t").to_numpy() - start
        whole = (at - length + 1 >= 0) & (at < len(sums[columns[0]]) - 1)
        asking, at = asking.filter(pa.array(whole)), at[whole]
        step = max(1, AT_ONCE // (every * patch * len(columns)))
        for i in range(0, len(at), step):
            here, some = at[i : i + step], asking.slice(i, step)
            for level, tokens, edges, stride in plan:
                means = {c: (np.diff(s[here[:, None] + edges], axis=1) / stride).astype(np.float64) + data[c][0] for c, s in sums.items()}
                repeated = np.repeat(np.arange(len(here)), tokens)
                kept = [some.column(c).combine_chunks().take(pa.array(repeated)) for c in names]
                place = [pa.array(np.full(len(repeated), level, np.int32)), pa.array(np.tile(np.arange(tokens, dtype=np.int32), len(here)))]
                yield pa.RecordBatch.from_arrays([*kept, *place, *(lists(means[c].ravel(), np.full(len(repeated), patch)) for c in columns)], names=[*names, "level", "token", *columns])

    return met(cursors, tape, length - 1, 0, columns, work, schema_of(cursors, ["level int", "token int", *(f"`{c}` array<double>" for c in columns)]))

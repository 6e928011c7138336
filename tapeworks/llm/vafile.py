"""Hard negatives by a vector-approximation file.

Each dimension is cut into at most ``CELLS`` cells at quantiles of about ``SAMPLE`` vectors; the outer cells end at the least
and largest component of all rows. The file holds for every row a byte a dimension, the number of its cell. For an anchor,
tables of the least and largest product of its component with what a cell can hold give, summed over the dimensions, a lower
and an upper bound of each row's score. A row is scored exactly only if these bounds let it enter what is asked for:

* positives: rows of the anchor's label whose upper bound reaches the k-th best lower bound or score;
* negatives of an (anchor, positive): rows of other labels whose bounds meet the window of scores, and whose upper bound
  reaches the k-th best score, or lower bound of rows that are surely inside the window.

Batches of anchors meet shards of the file in tasks of bounded size, twice: once for the positives, whose scores give the
windows, once for the negatives. Each task gives at most k rows an anchor, or an anchor and positive. The sample places
the cells' borders only; the result is exact whatever it holds.

Defined results: rows with a null label, id or vector, or with a null or non-finite component, take no part; zero and empty
vectors do; vectors meet those of their own length only; a row isn't its own positive, another row with its id can be; with
fewer than k positives or negatives all are given; an anchor without positives, or a positive without negatives in its
window (any positive of negative score), gives no row; ties go to the smaller id; an empty table gives an empty result;
other columns are ignored. See ``inner`` for numbers past 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.inner import LEAST, MOST, best, by_width, dealt, integers, products, reach, sample
from tapeworks.llm.util import stored, table

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 10, 100
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
CELLS, SAMPLE = 64, 8_192
#: Rows in a shard, anchors in a batch; rows and anchors whose bounds are held at once.
SHARD, BATCH = 8_192, 1_024
ROWS, ANCHORS = 4_096, 32


def borders(points: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """For each dimension the least integer of each cell but the first."""
    cuts = np.quantile(points, np.arange(1, cells) / cells, axis=0, method="lower") if len(points) else np.empty((0, points.shape[1]))
    return [np.unique(c).astype(np.int64) for c in cuts.T]


def extremes(batches):
    """For mapInArrow over (v): width, dim, least and most of a partition."""
    least: dict = {}
    most: dict = {}
    for batch in batches:
        for _, x in by_width(batch.column(0)):
            w = x.shape[1]
            least[w] = np.minimum(least[w], x.min(axis=0)) if w in least else x.min(axis=0)
            most[w] = np.maximum(most[w], x.max(axis=0)) if w in most else x.max(axis=0)
    for w in least:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(w, w)), pa.array(np.arange(w)), pa.array(least[w]), pa.array(most[w])], names=["width", "dim", "least", "most"])


def cells(rows: DataFrame, some: pa.Table, count: int = CELLS) -> dict:
    """For each width: least and most of what each cell of each dimension can hold (dims x cells), and the inner borders."""
    inner = {x.shape[1]: borders(x, count) for _, x in by_width(some.column("v"))}
    ends = rows.select("v").mapInArrow(extremes, "width long, dim long, least long, most long").groupBy("width", "dim").agg(F.min("least"), F.max("most"))
    found: dict = {}
    for w, d, low, high in ends.orderBy("width", "dim").collect():  # a row for each dimension
        cuts = inner[w][d] if w in inner else np.empty(0, np.int64)
        cuts = cuts[(cuts > low) & (cuts <= high)]
        least, most = np.full(count, low), np.full(count, high)
        least[1 : len(cuts) + 1], most[: len(cuts)] = cuts, cuts - 1
        found.setdefault(w, []).append((least, most, cuts))
    return {w: (np.stack([x[0] for x in dims]), np.stack([x[1] for x in dims]), [x[2] for x in dims]) for w, dims in found.items()}


def approximated(shared):
    """For mapInArrow over rows with v: the same with ``code``, a byte for each dimension."""

    def run(batches):
        for batch in batches:
            codes = np.empty(len(batch), object)
            for at, x in by_width(batch.column("v")):
                cuts = shared.value[x.shape[1]][2] if x.shape[1] else []
                code = np.stack([np.searchsorted(c, x[:, d], side="right") for d, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.empty((len(at), 0), np.uint8)
                codes[at] = [c.tobytes() for c in code]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "code"])

    return run


class Shard:
    """The rows of one width in a shard, by label."""

    def __init__(self, rows, ids, labels, x, codes, least, most):
        order = np.lexsort((rows, ids, labels))
        self.rows, self.ids, self.labels, self.x, self.codes = rows[order], ids[order], labels[order], x[order], np.ascontiguousarray(codes[order].T.astype(np.intp))
        self.least, self.most = least, most

    def bounds(self, q: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows x anchors) of the scores of the rows ``at``, from one table a dimension."""
        kind = np.int64 if reach(q, np.stack([self.least, self.most]).reshape(2, -1).T.reshape(-1, 1)) * max(q.shape[1], 1) < 2**62 else object
        lower, upper = (np.zeros((at.stop - at.start, len(q)), kind) for _ in range(2))
        for d in range(q.shape[1]):
            one, other = (np.multiply.outer(side[d].astype(kind), q[:, d].astype(kind)) for side in (self.least, self.most))
            lower += np.minimum(one, other).take(self.codes[d, at], axis=0)
            upper += np.maximum(one, other).take(self.codes[d, at], axis=0)
        return lower, upper


class Best:
    """The k best (score, id, row) so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.rows = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def kth(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else LEAST

    def add(self, scores, ids, rows) -> None:
        scores, ids, rows = (np.concatenate(p) for p in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, ~scores))[: self.k]  # ~x turns the order of integers around without overflow
        self.scores, self.ids, self.rows = scores[order], ids[order], rows[order]


def kth_largest(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else LEAST


def positives(shard: Shard, q, own, labels, k: int) -> list[Best]:
    """The k best other rows of each anchor's label."""
    found = [Best(k) for _ in own]
    for label in np.unique(labels):
        mine = np.flatnonzero(labels == label)
        start, stop = np.searchsorted(shard.labels, [label, label + 1])
        for r in range(start, stop, ROWS):
            at = slice(r, min(r + ROWS, stop))
            for i in range(0, len(mine), ANCHORS):
                some = mine[i : i + ANCHORS]
                lower, upper = shard.bounds(q[some], at)
                for j, a in enumerate(some):
                    other = shard.rows[at] != own[a]
                    least = max(found[a].kth, kth_largest(lower[other, j], k))
                    near = at.start + np.flatnonzero(other & (upper[:, j] >= least))
                    if len(near):
                        found[a].add(products(q[a][None], shard.x[near])[0], shard.ids[near], shard.rows[near])
    return found


def negatives(shard: Shard, q, labels, windows, k: int) -> list[list[Best]]:
    """For each anchor and each of its windows (low, high): the k best rows of other labels whose scores lie in it."""
    found = [[Best(k) for _ in w] for w in windows]
    for r in range(0, len(shard.rows), ROWS):
        at = slice(r, min(r + ROWS, len(shard.rows)))
        for i in range(0, len(q), ANCHORS):
            some = slice(i, min(i + ANCHORS, len(q)))
            lower, upper = shard.bounds(q[some], at)
            for j, a in enumerate(range(some.start, some.stop)):
                other = shard.labels[at] != labels[a]
                low, high = lower[:, j], upper[:, j]
                wanted = np.zeros(len(other), bool)
                for (first, last), so_far in zip(windows[a], found[a]):
                    inside = other & (low >= first) & (high <= last)
                    least = max(first, so_far.kth, kth_largest(low[inside], k))
                    wanted |= other & (high >= least) & (low <= last)
                near = at.start + np.flatnonzero(wanted)
                if not len(near):
                    continue
                scores = products(q[a][None], shard.x[near])[0]
                for (first, last), so_far in zip(windows[a], found[a]):
                    fit = (scores >= max(first, so_far.kth)) & (scores <= last)
                    if fit.any():
                        so_far.add(scores[fit], shard.ids[near[fit]], shard.rows[near[fit]])
    return found


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers s with low * score <= 100 * s <= high * score."""
    return min(-(-low * score // 100), MOST), max(high * score // 100, LEAST)


def shards(held: pa.Table, file: dict):
    for at, x in by_width(held.column("v")):
        least, most, _ = file.get(x.shape[1]) or (np.empty((0, 1), np.int64), np.empty((0, 1), np.int64), [])
        rows, ids, labels = (held.column(n).to_numpy()[at] for n in ("row", "vec_id", "label"))
        codes = np.frombuffer(b"".join(held.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) if x.shape[1] else np.empty((len(at), 0), np.uint8)
        yield x.shape[1], Shard(rows, ids, labels, x, codes, least, most)


def meet(shared, work, shape: pa.Schema):
    """For cogrouped batches of anchors and shards of the file: ``work`` on those of the same width."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = [shape.empty_table()]
        if len(asking) and len(held):
            anchors = {q.shape[1]: (asking.take(pa.array(at)), q) for at, q in by_width(asking.column("v"))}
            for width, shard in shards(held, shared.value):
                if width in anchors:
                    out.append(work(shard, *anchors[width]))
        return pa.concat_tables(out)

    return run


POSITIVE = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
NEGATIVE = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def of_label(k: int):
    def work(shard: Shard, asking: pa.Table, q) -> pa.Table:
        own = asking.column("row").to_numpy()
        found = positives(shard, q, own, asking.column("label").to_numpy(), k)
        sizes = [len(b.rows) for b in found]
        return pa.table([np.repeat(own, sizes), *(np.concatenate([getattr(b, n) for b in found]) for n in ("rows", "ids", "scores"))], schema=POSITIVE)

    return work


def of_others(k: int, low: int, high: int):
    def work(shard: Shard, asking: pa.Table, q) -> pa.Table:
        windows = [[window(s, low, high) for s in scores] for scores in asking.column("scores").to_pylist()]
        found = negatives(shard, q, asking.column("label").to_numpy(), windows, k)
        own = asking.column("row").to_numpy()
        parts = [(own[a], place, b) for a, bests in enumerate(found) for place, b in enumerate(bests) if len(b.rows)]
        if not parts:
            return NEGATIVE.empty_table()
        sizes = [len(b.rows) for *_, b in parts]
        return pa.table([np.repeat([p[0] for p in parts], sizes), np.repeat(np.array([p[1] for p in parts], np.int32), sizes), *(np.concatenate([getattr(b, n) for *_, b in parts]) for n in ("rows", "ids", "scores"))], schema=NEGATIVE)

    return work


def mined(vectors: DataFrame, label, every: int = EVERY, scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard: int = SHARD, batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``label`` is a column, an integer."""
    context = vectors.sparkSession.sparkContext
    rows = integers(vectors.where(label.isNotNull()), scale, label.cast("long").alias("label"))
    n = rows.count()
    file = context.broadcast(cells(rows, sample(rows, n, SAMPLE)))
    held = stored(rows.mapInArrow(approximated(file), "row long, vec_id long, label long, v array<long>, code binary"), "approximations")
    parts = -(-n // shard) or 1
    held = held.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    anchors = held.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v")
    batches = -(-anchors.count() // batch) or 1
    met = dealt(anchors, batches, held, parts).applyInArrow(meet(file, of_label(n_positives), POSITIVE), "anchor long, row long, vec_id long, score long")
    near = best(met, ["anchor"], [F.desc("score"), "vec_id", "row"], n_positives, "at")
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("at", F.col("vec_id").alias("id"), "score"))).alias("near"))  # n_positives at most
    near = stored(anchors.join(near, anchors["row"] == near["anchor"]).drop("anchor").withColumn("scores", F.col("near.score")), "positives")
    met = dealt(near.drop("near"), batches, held, parts).applyInArrow(meet(file, of_others(n_negatives, low, high), NEGATIVE), "anchor long, place int, row long, vec_id long, score long")
    found = best(met, ["anchor", "place"], [F.desc("score"), "vec_id", "row"], n_negatives, "rank").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    told = near.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("near").alias("place", "positive"))
    return found.join(told, ["anchor", "place"]).select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", "negative_id", F.col("positive.score").alias("positive_score"), "negative_score")


#: Where an id is divisible by 7, the label is moved on by one of ten.
MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def op12_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"), F.expr(MOVED))


#: Doubles hold these integers exactly.
SQL = f"""
WITH v AS (
    SELECT vec_id, row_number() OVER () AS row, {MOVED} AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS MATERIALIZED (
    SELECT q.row, q.vec_id AS anchor_id, c.vec_id, c.row AS other, q.label = c.label AS same, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.row != c.row AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0
), p AS (
    SELECT row, vec_id AS positive_id, other AS positive, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other) <= {POSITIVES}
), m AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY row, positive ORDER BY score DESC, vec_id, other)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (row) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
)
SELECT * FROM m WHERE rank <= {NEGATIVES}
"""
QUERIES = {"op12_vafile": op12_vafile}
ORACLE_SQL = {"op12_vafile": SQL}

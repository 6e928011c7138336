"""Exact top-k search by inner product, a block of documents at a time.

Dimensions are the terms, components their weights. Vectors are put in an order that keeps neighbours together (the leaves
of a tree of median cuts, fitted on about ``SAMPLE`` vectors; then signs against their leaf's middle), dealt by ranges of
that order to shards, and cut there into blocks of ``BLOCK``. A block keeps a forward index (its vectors, one after the
other) and each term's least and largest weight. For a query, the sum over terms of the larger product with these two is
a bound on every score in the block. Each query takes the blocks of a shard by falling bound, some at a time, scores them
through their forward indexes, and ends where no bound left reaches its k-th best score. It begins from the k-th best score
in the sample, so that the first blocks can be passed over too. Every vector is in the index: the sample only chooses the
order and where queries begin, and the result is exact whatever it holds.

Batches of queries meet shards of blocks in tasks of bounded size, each of which gives at most k rows a query.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part; zero and empty vectors
do (score 0); vectors meet those of their own length only; a query's own row is left out, another row with its id isn't; with
fewer than k candidates all are given; ties go to the smaller id; an empty table gives an empty result; other columns are
ignored. See ``inner`` for numbers past 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.inner import LEAST, MOST, best, by_width, dealt, integers, products, sample
from tapeworks.llm.util import stored, table

SCALE, K, EVERY = 1024, 10, 100
SAMPLE, LEAF = 8_192, 16
#: Documents in a block, documents in a shard, queries in a batch.
BLOCK, SHARD, BATCH = 128, 8_192, 2_048
#: Blocks that a query takes at first; each further round takes twice as many.
STRIDE = 4


class Order:
    """A place for every vector, such that near vectors get near places."""

    def __init__(self, points: np.ndarray):
        self.axis, self.cut, self.children, self.middle = [], [], [], []
        self.root = self.grow(points.astype(np.float64))

    def grow(self, x: np.ndarray) -> int:
        """A node as its number; leaf k is -1-k, in the order of places."""
        if len(x) > LEAF and x.shape[1]:
            axis = int(np.argmax(x.var(axis=0)))
            cut = float(np.median(x[:, axis]))
            side = x[:, axis] > cut
            if side.any():
                me = len(self.axis)
                self.axis.append(axis), self.cut.append(cut), self.children.append(None)
                self.children[me] = (self.grow(x[~side]), self.grow(x[side]))
                return me
        self.middle.append(np.median(x, axis=0))
        return -len(self.middle)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, and the signs of its first components against the leaf's middle as one number."""
        at, axis, cut, children = np.full(len(x), self.root), np.array(self.axis, np.int64), np.array(self.cut), np.array(self.children, np.int64).reshape(-1, 2)
        while (moving := np.flatnonzero(at >= 0)).size:
            here = at[moving]
            side = x[moving, axis[here]] > cut[here]
            at[moving] = children[here, side.astype(np.int64)]
        leaf = -1 - at
        signs = (x > np.array(self.middle)[leaf])[:, :62]
        return leaf, signs @ (1 << np.arange(signs.shape[1], dtype=np.int64)[::-1])


def placed(orders):
    """For mapInArrow over (row, vec_id, v): the same with width, leaf and signs."""

    def run(batches):
        for batch in batches:
            width, leaf, signs = (np.zeros(len(batch), np.int64) for _ in range(3))
            for at, x in by_width(batch.column("v")):
                width[at] = x.shape[1]
                if order := orders.value.get(x.shape[1]):
                    leaf[at], signs[at] = order.places(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width), pa.array(leaf), pa.array(signs)], names=[*batch.schema.names, "width", "leaf", "signs"])

    return run


BLOCKS = pa.schema([("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("forward", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("most", pa.list_(pa.int64()))])


def blocks(block: int):
    """For mapInArrow over sorted (row, vec_id, v, ...): blocks with forward index and bounds of each term; ids rise in a block."""

    def cut(rows: pa.Table):
        for at, x in by_width(rows.column("v")):
            ids, numbers = rows.column("vec_id").to_numpy()[at], rows.column("row").to_numpy()[at]
            for i in range(0, len(at), block):
                some = i + np.lexsort((numbers[i : i + block], ids[i : i + block]))
                y = x[some]
                yield numbers[some], ids[some], y.ravel(), y.min(axis=0), y.max(axis=0)

    def run(batches):
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]) if left is not None else rows
            whole = len(rows) // block * block  # a rest shorter than a block waits for the next batch
            left = rows.slice(whole)
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.int64())) for c in zip(*cut(rows.slice(0, whole)))], schema=BLOCKS)
        if left is not None and len(left):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.int64())) for c in zip(*cut(left))], schema=BLOCKS)

    return run


def begun(shared, k: int):
    """For mapInArrow over queries (row, vec_id, v): the same with ``least``, their k-th best score in the sample."""

    def run(batches):
        for batch in batches:
            start, rows = np.full(len(batch), LEAST), batch.column("row").to_numpy()
            for at, q in by_width(batch.column("v")):
                numbers, x = shared.value.get(q.shape[1], (None, None))
                for i in range(0, len(at), 256) if x is not None and len(x) > k else ():
                    some = at[i : i + 256]
                    scores = np.where(numbers == rows[some][:, None], LEAST, products(q[i : i + 256], x))
                    start[some] = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "start"])

    return run


FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search(q, own, start, index, k: int):
    """Scores, ids and rows (queries x k) of the best documents of ``index``, a list of (rows, ids, vectors, least, most).

    Places without a document hold the row -1.
    """
    scores, ids, rows = np.full((len(q), k), LEAST), np.full((len(q), k), MOST), np.full((len(q), k), -1)
    least, most = (np.stack([b[i] for b in index]) for i in (3, 4))
    # a sum of saturated parts could wrap; exact where no part is near 64 bits, else the largest number, which prunes nothing
    up, down = products(np.maximum(q, 0), most), products(np.minimum(q, 0), least)
    wide = np.abs(up.astype(np.float64)) + np.abs(down.astype(np.float64)) >= 2**62
    bounds = np.where(wide, MOST, np.where(wide, 0, up) + np.where(wide, 0, down))
    first = np.array([b[1][0] for b in index])
    order = np.lexsort((np.broadcast_to(first, bounds.shape), ~bounds), axis=1)  # ~x turns the order of integers around without overflow
    live, at, stride = np.arange(len(q)), 0, STRIDE
    while live.size and at < len(index):
        asked = order[live, at : at + stride]
        bound = np.take_along_axis(bounds[live], asked, 1)
        kth, last = scores[live, -1][:, None], ids[live, -1][:, None]
        needed = (bound >= start[live][:, None]) & ((bound > kth) | ((bound == kth) & (first[asked] <= last)))
        who, which = np.nonzero(needed)
        which = asked[who, which]
        by = np.argsort(which, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(which[by])) + 1) if len(by) else ():
            some, (numbers, names, x, _, _) = live[who[part]], index[which[part[0]]]
            got = products(q[some], x)
            mine = numbers == own[some][:, None]
            worth = ((got >= scores[some, -1][:, None]) & (got >= start[some][:, None]) & ~mine).any(axis=1)
            some, got, mine = some[worth], got[worth], mine[worth]
            if len(some):
                all_scores = np.hstack([scores[some], got])
                all_ids = np.hstack([ids[some], np.broadcast_to(names, got.shape)])
                all_rows = np.hstack([rows[some], np.where(mine, -1, numbers)])
                keep = np.lexsort((all_ids, ~all_scores, all_rows < 0), axis=1)[:, :k]  # an empty place comes last, whatever the scores
                rows[some] = np.take_along_axis(all_rows, keep, 1)
                empty = rows[some] < 0
                scores[some] = np.where(empty, LEAST, np.take_along_axis(all_scores, keep, 1))
                ids[some] = np.where(empty, MOST, np.take_along_axis(all_ids, keep, 1))
        at, stride = at + stride, stride * 2
        if at < len(index):
            ahead = bounds[live, order[live, at]]
            live = live[(ahead >= start[live]) & (ahead >= scores[live, -1])]
    return scores, ids, rows


def meet(k: int):
    """For cogrouped batches of queries and shards of blocks."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out = [FOUND.empty_table()]
        if len(queries) and len(index):
            lists = {n: index.column(n).combine_chunks() for n in BLOCKS.names}
            numpy = lambda n, i: lists[n][i].values.to_numpy(zero_copy_only=False)
            shards: dict = {}
            for i in range(len(index)):
                numbers, least = numpy("rows", i), numpy("least", i)
                shards.setdefault(len(least), []).append((numbers, numpy("ids", i), numpy("forward", i).reshape(len(numbers), len(least)), least, numpy("most", i)))
            own, names, start = (queries.column(n).to_numpy() for n in ("row", "vec_id", "start"))
            for at, q in by_width(queries.column("v")):
                if q.shape[1] in shards:
                    scores, ids, rows = search(q, own[at], start[at], shards[q.shape[1]], k)
                    some = rows >= 0
                    out.append(pa.table([np.repeat(own[at], some.sum(1)), np.repeat(names[at], some.sum(1)), rows[some], ids[some], scores[some]], schema=FOUND))
        return pa.concat_tables(out)

    return run


def ranked(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by ``every``."""
    context = vectors.sparkSession.sparkContext
    rows = integers(vectors, scale)
    n = rows.count()
    some = sample(rows, n, SAMPLE)
    parts = {x.shape[1]: (some.column("row").to_numpy()[at], x) for at, x in by_width(some.column("v"))}
    orders = context.broadcast({w: Order(x) for w, (_, x) in parts.items()})
    near = rows.mapInArrow(placed(orders), "row long, vec_id long, v array<long>, width long, leaf long, signs long")
    keys = ["width", "leaf", "signs", F.xxhash64("v"), "vec_id", "row"]
    near = near.repartitionByRange(-(-n // shard) or 1, *keys).sortWithinPartitions(*keys).select("row", "vec_id", "v")
    index = stored(near.mapInArrow(blocks(block), "rows array<long>, ids array<long>, forward array<long>, least array<long>, most array<long>").withColumn("b", F.spark_partition_id()), "blocks")
    asking = rows.where(F.col("vec_id") % every == 0).mapInArrow(begun(context.broadcast(parts), k), "row long, vec_id long, v array<long>, start long")
    asking = stored(asking, "queries")
    counts = asking.agg(F.count("*")).first()[0], index.agg(F.max("b")).first()[0]
    met = dealt(asking, -(-counts[0] // batch) or 1, index, (counts[1] or 0) + 1).applyInArrow(meet(k), "query long, query_id long, row long, vec_id long, score long")
    found = best(met, ["query"], [F.desc("score"), "vec_id", "row"], k, "rank")
    return found.select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "embeddings"))


#: Doubles hold these integers exactly.
SQL = f"""
WITH v AS (
    SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.row != c.row AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
QUERIES = {"op11_topk": op11_topk}
ORACLE_SQL = {"op11_topk": SQL}

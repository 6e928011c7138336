"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact reranking.

Nearness is the inner product; vectors are extended by sqrt(M^2 - |x|^2) so that it becomes an angle, and a node's plane
passes midway between two random points of its sample. The trees are fitted on about ``SAMPLE`` distinct vectors, those
that hash lowest; every vector is then sent down every tree. A query descends all trees at once from one queue ordered by
the margin to the planes passed on the wrong side, and takes leaves until these hold ``SHARE`` of the sample, counting a
vector once for each tree. Vectors spread evenly over a sphere, as the test tables' are, have no close neighbours that a
tree could keep together: there a recall of 0.9 takes about half of all vectors, at any size. All members of those leaves are reranked by their exact inner product in double precision.

Copies: equal vectors are one point of the index, with the ``k + 1`` smallest ids that share it; no more of them can be in
an answer. Leaves and the queries at a leaf are cut into blocks of at most ``BLOCK`` rows, which meet pairwise in tasks, so
that a hot leaf is no task's burden; each meeting of blocks gives at most k + 1 rows a query.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or non-finite component take no part; a query
without its own vector among these gives no row; with fewer than k candidates all are given; ties go to the smaller id;
rows that share an id and vector count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.util import stored, table

TREES, LEAF, SAMPLE, SEED = 16, 256, 20_000, 7
#: A query takes leaves until their members in the sample come to this share of the sample, and to LEAST members.
SHARE, LEAST = 0.9, 6000
BLOCK, K, EVERY = 4096, 20, 20


class Forest:
    def __init__(self, points: np.ndarray, seed: int = SEED):
        """points: distinct vectors, float64."""
        self.bound = float(np.sqrt((points**2).sum(1).max())) if len(points) else 1.0
        self.size = len(points)
        x, rng = self.extend(points), np.random.default_rng(seed)
        self.trees = [self.grow(x, rng) for _ in range(TREES)]

    def extend(self, points: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.bound**2 - (points**2).sum(1), 0))
        return np.hstack([points, rest[:, None]])

    def grow(self, x: np.ndarray, rng):
        """A tree as arrays: plane and offset of inner nodes, children (a leaf k is -1-k), leaf sizes in the sample."""
        planes, offsets, children, sizes = [], [], [], []

        def node(rows) -> int:
            if len(rows) > LEAF:
                for _ in range(5):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    plane = a - b
                    offset = plane @ (a + b) / 2
                    side = x[rows] @ plane > offset
                    if 0.1 < side.mean() < 0.9:
                        break
                else:
                    plane = rng.standard_normal(x.shape[1])
                    at = x[rows] @ plane
                    offset = float(np.median(at))
                    side = at > offset
                if 0 < side.sum() < len(rows):
                    me = len(planes)
                    scale = float(np.linalg.norm(plane)) or 1.0
                    planes.append(plane / scale)
                    offsets.append(offset / scale)
                    children.append(None)
                    children[me] = (node(rows[~side]), node(rows[side]))
                    return me
            sizes.append(len(rows))
            return -len(sizes)

        root = node(np.arange(len(x)))
        return np.array(planes).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(sizes), root

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        x, out = self.extend(points), np.empty((len(points), TREES), np.int32)
        for t, (planes, offsets, children, _, root) in enumerate(self.trees):
            at = np.full(len(x), root, np.int64)
            while (moving := np.flatnonzero(at >= 0)).size:
                here = at[moving]
                side = np.einsum("ij,ij->i", x[moving], planes[here]) > offsets[here]
                at[moving] = children[here, side.astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def search(self, query: np.ndarray) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) for one query, by one queue over all trees."""
        q = np.append(query / max(np.linalg.norm(query), 1e-300) * self.bound, 0.0)
        margins = [planes @ q - offsets for planes, offsets, *_ in self.trees]
        queue = [(0.0, t, tree[4]) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        found, members, wanted = [], 0, max(LEAST, SHARE * self.size)
        while queue and members < wanted:
            far, t, node = heapq.heappop(queue)
            _, _, children, sizes, _ = self.trees[t]
            while node >= 0:
                m = margins[t][node]
                near, other = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (max(far, abs(m)), t, int(children[node, other])))
                node = int(children[node, near])
            found.append((t, -1 - node))
            members += int(sizes[-1 - node])
        return found


def rows_of(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def index_leaves(shared):
    """For mapInArrow over (point, vector): point, vector, and the leaf in each tree."""

    def run(batches):
        for batch in batches:
            if len(batch):
                leaves = shared.value.leaves(rows_of(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(0, leaves.size + 1, TREES, dtype=np.int32), leaves.ravel())], names=["point", "vector", "leaves"])

    return run


def query_leaves(shared):
    """For mapInArrow over (point, vector): the same with the leaves that a search takes, as tree + TREES * leaf."""

    def run(batches):
        for batch in batches:
            if len(batch):
                found = [[t + TREES * leaf for t, leaf in shared.value.search(q)] for q in rows_of(batch.column(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=["point", "vector", "taken"])

    return run


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: larger scores first, ties to the smaller id."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)
    return order[:, :k]


def meet(k: int):
    """For cogrouped blocks of queries and index: the k + 1 best points of the block for each query."""
    shape = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not len(queries) or not len(index):
            return shape.empty_table()
        x, ids = rows_of(index.column("vector")), index.column("point").to_numpy()
        names, n, out = queries.column("point").to_numpy(), min(k + 1, len(index)), []
        reach = np.sqrt((x**2).sum(1).max())
        for i in range(0, len(queries), 256):
            q = rows_of(queries.column("vector").slice(i, 256))
            scores = q @ x.T
            least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
            # whatever rounding may have put below the last of the best takes part; then scores are summed one by one, so that
            # equal vectors get equal scores wherever they are met
            near = scores >= (least - 1e-12 * reach * np.sqrt((q**2).sum(1)))[:, None]
            width = int(near.sum(1).max())
            some = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < len(ids) else np.broadcast_to(np.arange(len(ids)), scores.shape)
            exact = np.stack([np.einsum("d,jd->j", a, x[at]) for a, at in zip(q, some)])
            best = best_of(exact, ids[some], n)
            out.append((np.repeat(names[i : i + 256], n), np.take_along_axis(ids[some], best, 1).ravel(), np.take_along_axis(exact, best, 1).ravel()))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=shape)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (floats as they are, other numbers as doubles) of the rows that take part."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding").cast(f"array<{kind if kind == 'float' else 'double'}>")
    good = F.size(v) > 0
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    found = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(good, F.lit(False))).select("vec_id", v.alias("vector"))
    width = found.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("vector") == (width["d"] if width else 0))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: k neighbours of every row whose id is divisible by ``every``."""
    context = vectors.sparkSession.sparkContext
    rows = stored(usable(vectors), "vectors")
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    # by hash of the vector first: a hot vector is reduced in its tasks to its few smallest ids
    small = rows.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(ids.alias("ids"))
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    points = stored(small.groupBy("vector").agg(merged.alias("ids")).select(F.element_at("ids", 1).alias("point"), "vector", "ids"), "points")
    many = points.count()
    place = F.pmod(F.xxhash64("point"), F.lit(1 << 40))
    sample = points.where(place <= F.lit(int((1 << 40) * min(1.0, SAMPLE / max(many, 1))))).select("point", "vector").toArrow().sort_by("point")  # about SAMPLE rows
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    forest = context.broadcast(Forest(rows_of(sample.column(1))))
    kind = points.schema["vector"].dataType.simpleString()
    index = stored(points.select("point", "vector").mapInArrow(index_leaves(forest), f"point long, vector {kind}, leaves array<int>"), "index")

    asking = rows.where(F.col("vec_id") % every == 0)
    owners = stored(asking.join(points.select("point", F.col("vector").alias("v")), F.col("vector") == F.col("v")).select("vec_id", "point").distinct(), "owners")
    searched = points.join(owners.select("point").distinct(), "point", "left_semi").select("point", "vector")
    searched = stored(searched.mapInArrow(query_leaves(forest), f"point long, vector {kind}, taken array<int>"), "searched")
    # a vector is written once; it goes to a leaf only when dealt out to it
    asked = searched.select("point", "vector", F.explode("taken").alias("leaf"))
    held = index.select("point", "vector", F.posexplode("leaves").alias("tree", "own")).withColumn("leaf", F.col("tree") + TREES * F.col("own"))
    blocks = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = F.broadcast(stored(blocks(held, "n_index").join(blocks(asked, "n_asking"), "leaf"), "blocks"))  # at most the sample's leaves
    salt = lambda n: F.pmod(F.xxhash64("point"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["leaf", "a", "b"]
    left = asked.join(counts, "leaf").withColumn("a", salt("n_asking")).withColumn("b", each("n_index")).select(*keys, "point", "vector")
    right = held.join(counts, "leaf").withColumn("b", salt("n_index")).withColumn("a", each("n_asking")).select(*keys, "point", "vector")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet(k), "query long, point long, score double")
    best = met.groupBy("query", "point").agg(F.max("score").alias("score"))
    top = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "point"))).where(F.col("place") <= k + 1)
    named = stored(top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id")), "named")
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    answers = owners.withColumnRenamed("vec_id", "query_id").join(first, owners["point"] == first["query"]).where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_forest": op7_forest}
ORACLE_SQL: dict = {}

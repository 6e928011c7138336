import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import inner, topk, vafile

SHAPE = "vec_id long, embedding array<double>, label int, v int, row string, score int, code int, b int, start int"
REST = (1, "x", 2, 3, 4, 5)  # further columns with clashing names


def clipped(x):
    return max(inner.LEAST, min(inner.MOST, x))


def kept(rows, scale, labelled=False):
    """(place, id, label, ints) of the rows that take part."""
    out = []
    for n, (i, v, label) in enumerate(rows):
        if i is None or v is None or labelled and label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((n, i, label, [clipped(math.floor(x * scale)) if abs(x) < 1e300 else (inner.MOST if x > 0 else inner.LEAST) for x in v]))
    return out


def score(a, b):
    return clipped(sum(x * y for x, y in zip(a, b)))


def brute_topk(rows, k, every):
    found, ints = [], kept(rows, topk.SCALE)
    for n, i, _, q in ints:
        if i % every == 0:
            best = sorted((-score(q, x), j) for m, j, _, x in ints if m != n and len(x) == len(q))[:k]
            found += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(found)


def brute_negatives(rows, every, moved=True):
    found = []
    ints = [(n, i, (l + 1) % 10 if moved and i % 7 == 0 else l, v) for n, i, l, v in kept(rows, vafile.SCALE, True)]
    for n, i, label, q in ints:
        if i % every:
            continue
        scored = [(-score(q, x), j, m, l) for m, j, l, x in ints if m != n and len(x) == len(q)]
        for p, j, *_ in sorted(s for s in scored if s[3] == label)[:5]:
            fit = sorted(s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            found += [(i, j, r, m, -p, -s) for r, (s, m, *_) in enumerate(fit, 1)]
    return sorted(found)


def table(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], SHAPE).repartition(3)


def vectors(n, seed, width=6, copies=0.3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    near = rng.random(n) < copies
    x[near] = x[0] + rng.standard_normal((near.sum(), width)) * 0.05
    x[rng.random(n) < 0.2] = x[1]  # equal vectors: ties
    return [(int(i), [float(c) for c in v], int(l)) for i, v, l in zip(rng.permutation(n) - 5, x, rng.integers(0, 4, n))]


ODD = [
    (0, None, 1), (100, [], 1), (200, [], 2), (300, [None, 1.0], 1), (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 2), (None, [1.0, 2.0], 1), (600, [0.0, 0.0], 1), (700, [1.0, -2.0], None), (800, [1.0, -2.0], 1), (800, [1.0, -2.0], 1),
    (801, [0.5, -2.0], 2), (-100, [-1.0, 2.0], 1), (802, [1e15, -1e15], 2), (900, [1e18, 1e18], 1), (1000, [-1e308, 1e308], 1), (803, [3e12, 2e12], 1), (7, [1.0, -2.0], 0), (804, [1.0, 2.0, 3.0], 1), (1100, [1.0, 2.0, 2.0], 1), (805, [0.9, 1.0, 1.0], 2),
]


def got(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


@pytest.mark.parametrize("rows, every, k", [(ODD, 100, 10), (ODD, 1, 3), (vectors(700, 1), 10, 10), (vectors(300, 2, 1), 3, 7), (vectors(400, 3, 70), 20, 10)])
def test_topk_against_brute_force(spark, rows, every, k):
    found = topk.ranked(table(spark, rows), k, every, shard=200, block=16, batch=20)
    assert got(found, "query_id", "rank", "vec_id", "score") == brute_topk(rows, k, every)


def test_topk_of_no_and_few_rows(spark):
    few = table(spark, [(0, [1.0], 1), (1, [2.0], 1)])
    assert got(topk.ranked(few), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1024 * 2048)]
    assert topk.ranked(few.limit(0)).count() == 0 == topk.ranked(few.where("vec_id = 1")).count()


def test_topk_passes_over_blocks(spark):
    """Vectors in far groups: a query scores few blocks, and finds the same."""
    rng = np.random.default_rng(5)
    x = (np.repeat(np.eye(16), 64, axis=0) * 1000 + rng.integers(0, 50, (1024, 16))).astype(np.int64)
    rows = np.arange(1024)
    index = [(rows[i : i + 32], rows[i : i + 32], x[i : i + 32], x[i : i + 32].min(0), x[i : i + 32].max(0)) for i in range(0, 1024, 32)]
    scored = []

    class Counted(list):
        def __getitem__(self, i):
            scored.append(i)
            return list.__getitem__(self, i)

    scores, ids, found = topk.search(x[:1], rows[:1], np.array([inner.LEAST]), Counted(index), 10)
    exact = x @ x[0]
    exact[0] = inner.LEAST
    want = np.lexsort((rows, ~exact))[:10]
    assert list(ids[0]) == list(want) and list(scores[0]) == list(exact[want]) and list(found[0]) == list(want)
    assert len(scored) <= 4


def test_order_keeps_neighbours_together():
    rng = np.random.default_rng(0)
    middles = rng.standard_normal((8, 5)) * 100
    x = (np.repeat(middles, 50, axis=0) + rng.standard_normal((400, 5))).astype(np.int64)
    leaf, signs = topk.Order(x[::3]).places(x)
    group = np.repeat(np.arange(8), 50)[np.lexsort((signs, leaf))]
    assert (np.diff(group) != 0).sum() < 60 and set(topk.Order(np.zeros((40, 3), np.int64)).places(x[:, :3])[0]) == {0}


@pytest.mark.parametrize("rows, every", [(ODD, 100), (ODD, 1), (vectors(700, 4), 10), (vectors(300, 5, 1), 3), (vectors(900, 6, 12, 0.6), 50)])
def test_negatives_against_brute_force(spark, rows, every):
    found = vafile.mined(table(spark, rows), F.expr(vafile.MOVED), every, shard=150, batch=7)
    assert got(found, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == brute_negatives(rows, every)


def test_negatives_of_no_rows(spark):
    few = table(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [0.5], 2)])
    found = got(vafile.mined(few, F.col("label")), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert found == [] and 100 * 256 * 128 < 30 * 256 * 512  # below the window
    few = table(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [0.6], 2), (3, [1.81], 3), (5, [1.8], 3)])
    found = got(vafile.mined(few, F.col("label")), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert found == [(0, 1, 1, 5, 256 * 512, 256 * 460)]  # floor(0.6 * 256) = 153 is just below 0.3 * 512
    assert vafile.mined(few.limit(0), F.col("label")).count() == 0


def test_bounds_hold_and_leave_rows_out(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-200, 200, (3000, 8))
    cuts = vafile.borders(x[:500], 16)
    least, most = np.full((8, 16), x.min(0)[:, None]), np.full((8, 16), x.max(0)[:, None])
    for d, c in enumerate(cuts):
        least[d, 1 : len(c) + 1], most[d, : len(c)] = c, c - 1
    codes = np.stack([np.searchsorted(c, x[:, d], side="right") for d, c in enumerate(cuts)], axis=1)
    n = np.arange(3000)
    shard = vafile.Shard(n, n, rng.integers(0, 3, 3000), x, codes, least, most)
    q = x[:5]
    lower, upper = shard.bounds(q, slice(0, 3000))
    exact = shard.x @ q.T
    assert (lower <= exact).all() and (exact <= upper).all()
    reached = upper >= np.sort(lower, axis=0)[-10]
    assert (reached.sum(0) < 1000).all()

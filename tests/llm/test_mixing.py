import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import mixing


def plain_targets(sizes):
    """sizes by source; the excess over three times the size is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s: weight[s] for s in names if s not in full}
        left = total - sum(full.values())
        now = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in now if now[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return full | now
        full |= {s: 3.0 * sizes[s] for s in over}


def corpus(spark, n=3000, seed=0):
    rng = random.Random(seed)
    names = ["hot"] * 6 + ["a", "b", "c", "é", "Z", None, "tiny"]
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1))), rng.choice(names)) for i in range(n)]
    rows = [(i, t, "a" if s == "tiny" and i % 10 else s) for i, t, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("leaf", [4000, 50])
def test_targets_sums_and_reruns(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", 4)
    docs = corpus(spark)
    sizes, largest = {}, {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    want = plain_targets(sizes)
    found = mixing.plan(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert len(found) == 3000 and (found["taken"] <= 3 * found["size"]).all()
    for source, rows in found.groupby("source", dropna=False):
        source = source if isinstance(source, str) else None
        assert rows["target"].iloc[0] == pytest.approx(want[source]) and rows["size"].sum() == sizes[source] == rows["source_size"].iloc[0]
        assert abs(rows["taken"].sum() - want[source]) <= largest[source]
    again = mixing.plan(docs.repartition(5)).toPandas()
    assert dict(zip(found["doc_id"], found["copies"])) == dict(zip(again["doc_id"], again["copies"]))


def test_pairs_keep_words_and_expectation():
    rng = np.random.default_rng(0)
    size, x = rng.integers(1, 50, 40).astype(float), rng.random(40)
    sums = np.zeros(40)
    for k in range(4000):
        draw = rng.random(40)
        out, left = mixing.settle(mixing.settle_large(x, size, draw), size, rng.random(40))
        assert abs((out * size).sum() - (x * size).sum()) < 1e-6
        whole = np.delete(out, left) if left >= 0 else out
        assert np.isin(whole, [0.0, 1.0]).all()
        sums += out
    assert np.abs(sums / 4000 - x).max() < 0.05


def test_mix_repeats_rows_as_planned(spark, edge):
    plan = mixing.plan(edge).collect()
    mixed = mixing.mix(edge)
    assert len(plan) == edge.count() and mixed.columns == edge.columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert all(r["taken"] == 0 for r in plan if r["size"] == 0)
    assert mixing.plan(edge.limit(0)).count() == 0 == mixing.mix(edge.limit(0)).count()


def test_rows_alike_but_for_their_source_keep_apart(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, "d " * 50, "x"), (3, "e " * 5, "y"), (4, "f", None)] + [(7, "same row", "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("k")).withColumn("copies", F.lit(9))
    plan, mixed = mixing.plan(docs), mixing.mix(docs)
    want = {(r["size"], r["source_size"]): 0 for r in plan.collect()}
    sizes = {"x": 113, "y": 8, None: 1}
    for r in plan.collect():
        want[r["size"], r["source_size"]] += r["copies"]
    found = {k: 0 for k in want}
    for r in mixed.collect():
        found[len(r["text"].split()), sizes[r["source"]]] += 1
    assert found == want and mixed.columns == docs.columns

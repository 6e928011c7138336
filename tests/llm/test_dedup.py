import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeworks.llm import exact_dedup, line_dedup, simhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal(text):
    return (text or "").encode().translate(LOWER)


# exact dedup


def test_exact_groups_of_edge_cases(edge):
    found, rows = exact_dedup.groups(edge).collect(), edge.collect()
    assert len(found) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(hashlib.sha256(normal(r["text"])).hexdigest(), []).append(r["doc_id"])
    for r in found:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(by)


def test_exact_dedup_keeps_columns_and_whole_rows(edge):
    found = exact_dedup.dedup(edge)
    assert found.columns == edge.columns
    rows = found.collect()
    assert len(rows) == len({normal(r["text"]) for r in edge.collect()})
    assert {r["doc_id"] for r in rows} >= {1, 4} and exact_dedup.dedup(edge.limit(0)).count() == 0 == exact_dedup.groups(edge.limit(0)).count()


def test_hot_digests_are_found_and_counted(spark):
    docs = spark.range(0, 6000, numPartitions=7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.col("id").cast("string")).alias("text"))
    digests = docs.select("doc_id", exact_dedup.digest(F.col("text")).alias("digest"))
    hot = exact_dedup.heavy(digests, F.col("doc_id"), 4).collect()
    assert [(r["n"], r["top"]) for r in hot] == [(2000, 5997)]
    found = exact_dedup.groups(docs).where("group_size > 1")
    assert found.count() == 2000 and found.where("kept").first()["doc_id"] == 5997


def test_misra_gries_keeps_every_frequent_key():
    rng = random.Random(0)
    keys = [rng.choice("ab") if rng.random() < 0.5 else str(rng.randrange(10_000)) for _ in range(5000)]
    from collections import Counter

    counts = Counter()
    for i in range(0, 5000, 37):
        counts = exact_dedup.shrink(counts + Counter(keys[i : i + 37]), 8)
    true = Counter(keys)
    assert len(counts) <= 8 and all(true[k] - counts[k] <= 5000 / 9 for k in "ab")


# SimHash


def plain_fingerprint(text):
    words = normal(text).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = simhash.masks(), random.Random(1)
    assert len(masks) == 15
    for n in range(4):
        for flips in (rng.sample(range(64), n) for _ in range(3000)):
            bits = sum(1 << i for i in flips)
            assert any(not bits & m for m in masks)


def test_fingerprints_and_components_of_edge_cases(edge):
    found, rows = simhash.groups(edge).collect(), edge.collect()
    assert sorted(r["fingerprint"] for r in found) == sorted(f"{plain_fingerprint(r['text']):016x}" for r in rows)
    roots = plain_components({plain_fingerprint(r["text"]) for r in rows})
    smallest = {}
    for r in rows:
        if r["doc_id"] is not None:
            k = roots[plain_fingerprint(r["text"])]
            smallest[k] = min(smallest.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == smallest.get(roots[int(r["fingerprint"], 16)]) for r in found)
    assert simhash.groups(edge.limit(0)).count() == 0


def clustered(n, seed):
    rng, out = random.Random(seed), set()
    while len(out) < n:
        x = rng.getrandbits(64) if not out or rng.random() < 0.3 else rng.choice(sorted(out))
        for i in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << i
        out.add(x)
    return out


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_links_and_components_against_brute_force(spark, bucket):
    fps = clustered(400, 5)
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = simhash.components(simhash.links(frame, bucket)).collect()
    roots = plain_components(fps)
    mine = {f: f for f in fps} | {r["node"] % 2**64: r["root"] % 2**64 for r in found}
    same = {}
    for f in fps:
        same.setdefault(mine[f], set()).add(f)
    want = {}
    for f in fps:
        want.setdefault(roots[f], set()).add(f)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 600).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = simhash.components(chain).collect()
    assert len(found) == 599 and {r["root"] for r in found} == {0}


def test_simhash_dedup_keeps_one_of_each_component(edge):
    kept = simhash.dedup(edge)
    assert kept.columns == edge.columns
    roots = plain_components({plain_fingerprint(r["text"]) for r in edge.collect()})
    rows = kept.collect()
    assert len(rows) == len(set(roots.values())) == len({roots[plain_fingerprint(r["text"])] for r in rows})


# line dedup


def plain_lines(rows):
    """rows: (doc_id, text) in order; a window seen before covers its lines."""
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out.append((doc_id, None, 0))
            continue
        lines, covered = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip():
                if seen.setdefault(window, (doc_id, i)) != (doc_id, i):
                    covered.update(range(i, i + 3))
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in covered), len(covered)))
    return out


def test_line_dedup_of_edge_cases(edge):
    found = line_dedup.dedup(edge).collect()
    want = plain_lines([(r["doc_id"], r["text"]) for r in edge.collect()])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2])
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in found), key=key) == sorted(want, key=key)
    assert set(edge.columns) <= set(found[0].asDict()) and line_dedup.dedup(edge.limit(0)).count() == 0


def test_line_dedup_keeps_columns_whatever_their_names(spark, edge):
    clashing = edge.select("doc_id", "text").withColumns({c: F.lit(1) for c in ("__row", "at", "lines", "cut", "left", "doc")})
    found = line_dedup.dedup(clashing)
    assert found.columns == [*clashing.columns, "n_lines", "n_removed"] and found.where("at = 1 and `left` = 1 and doc = 1").count() == edge.count()
    assert line_dedup.dedup(edge.withColumn("n_lines", F.lit(-1))).where("n_lines < 0").count() == 0
    four = line_dedup.dedup(spark.createDataFrame([(1, "a\na\na\na")], "doc_id long, text string")).first()
    assert four["text"] == "a" and four["n_removed"] == 3


def test_line_dedup_of_random_lines(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " "]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    found = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["n_removed"]) for r in found] == plain_lines(rows)


def test_line_dedup_plan_has_no_python(edge):
    plan = line_dedup.dedup(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

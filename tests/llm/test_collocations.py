import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, longest=3, least=10, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    key = tuple(words[i : i + n])
                    counts.setdefault(lang, Counter())[key] += 1
    out = []
    for lang, found in counts.items():
        wanted = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in wanted.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside.get(p[i : i + m], 0), a)
        scored = []
        for p, a in wanted.items():
            if 100 * inside.get(p, 0) >= 50 * a:
                continue
            score, k = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, totals[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def rows_of(seed, n=400, words=14):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "Äé", "日本", "x y", "\x1c", "THE", "the"][:words]
    copied = "the quick one, the quick two; the quick one"
    texts = []
    for _ in range(n):
        k = rng.randrange(6)
        text = copied if k == 0 else "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "?!"]) for _ in range(rng.randrange(40)))
        texts.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*texts, ("en", None), (None, ""), ("fr", " . , "), ("de", "long words " * 3000)]


def table(spark, rows):
    docs = spark.createDataFrame([(n, lang, text, 1, "p", 2, 3) for n, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, m int, piece string, f int, a int")
    return docs.repartition(5)


def got(df):
    return sorted(map(tuple, df.select(*NAMES).collect()))


@pytest.mark.parametrize("seed, longest, least, top", [(1, 3, 10, 2000), (2, 4, 5, 30), (3, 2, 2, 7)])
def test_against_brute_force(spark, seed, longest, least, top):
    rows = rows_of(seed)
    assert got(collocations.collocations(table(spark, rows), longest, least, top=top)) == brute(rows, longest, least, top)


def test_edge_cases_and_no_rows(spark, edge):
    rows = [(r["lang"], r["text"]) for r in edge.collect()]
    assert got(collocations.collocations(edge, least=2)) == brute(rows, least=2)
    assert collocations.collocations(edge.limit(0)).count() == 0 == collocations.collocations(edge.where("doc_id < 3")).count()


def test_bitmap_leaves_out_no_part(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.zipf(1.3, 4000) % 300]
    some = pa.table({"lang": ["en"] * 400, "piece": [" ".join(words[i : i + 10]) for i in range(0, 4000, 10)], "m": np.ones(400, np.int64)})
    two = collocations.added(some, 2, np.full(16, 2**64 - 1, np.uint64))
    held = spark.createDataFrame([(lang, p) for lang, p, f in zip(*(two.column(n).to_pylist() for n in two.column_names)) if f >= 3], "lang string, phrase string")
    three = collocations.added(some, 3, collocations.bitmap(held))
    whole = Counter(tuple(words[i + j : i + j + 3]) for i in range(0, 4000, 10) for j in range(8))
    found = dict(zip((tuple(p.split(" ")) for p in three.column("phrase").to_pylist()), three.column("f").to_pylist()))
    assert all(found[p] == whole[p] for p in found) and {p for p, f in whole.items() if f >= 3} <= set(found) and len(found) < len(whole)


def test_buckets_spill_and_sum(spark, monkeypatch):
    """A bucket far larger than duckdb's memory is summed all the same."""
    from pyspark import SparkFiles

    monkeypatch.setattr(collocations, "MEMORY", "24MB")  # summed here, not in a worker
    assert SparkFiles.getRootDirectory()
    batches = (pa.RecordBatch.from_pydict({"lang": ["en"] * 50_000, "phrase": [f"phrase number {i} of many" for i in range(k * 25_000, k * 25_000 + 50_000)], "f": [1] * 50_000}) for k in range(30))
    found = sum(len(b) for b in collocations.summed(2)(batches))
    assert found == 29 * 25_000


def test_scores_are_exact_past_64_bits(spark, monkeypatch):
    a, l, r = 3_000_000_007, 3_000_000_019, 3_000_000_037
    rounds = [spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, phrase string, f long"), spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, f long")]
    monkeypatch.setattr(collocations, "counted", lambda *_: rounds)
    found = collocations.collocations(table(spark, [("en", "x y")]), 2).first()
    assert found["score"] == 1_000_000 * a * a // (l * r) and found["l"] == l and found["r"] == r

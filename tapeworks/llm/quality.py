"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's evidence comes from its own features and those of its neighbours; two transition weights couple lines in a row.
Training takes every line of a labelled document to have the document's label. The document's score is the length-weighted
mean of the lines' forward-backward marginals, passed through a logistic curve fitted to the same training documents.

Only the fit is bounded: at most ``TRAIN_DOCS`` labelled documents of ``TRAIN_BYTES`` bytes each, those whose id hashes lowest, and
of these whole documents up to ``TRAIN_LINES`` lines. Scoring reads every whole text.

Defined results: null and empty texts are one empty line, scored like any other; a null label is no label; of several
labels of a document the highest counts; with no labelled rows every score is 0.5, with one class only that class's
smoothed share; repeated rows are scored alike; an empty table gives an empty result; other columns are kept as they are, but columns
named score or predicted are replaced by the result.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.util import crc_mod, table

TRAIN_DOCS, TRAIN_BYTES, TRAIN_LINES = 4000, 20_000, 400_000
FOLDS, THRESHOLD = 5, 0.3
ROUNDS, RATE, RIDGE = 120, 0.15, 1e-3

UPPER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
MARKS, SYMBOLS, HIGH = b".,;:'\"()-?", b"#$%&*+=<>@^_~/\\[]{}`", bytes(range(128, 256))
#: Features of one line.
OWN = 13


def line_features(text: bytes) -> tuple[list[tuple], list[int]]:
    """A row of features for each line of the text, and the lines' lengths in bytes plus one."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        n, words = len(line), line.split()
        share = 1.0 / max(n, 1)
        each = 1.0 / max(len(words), 1)
        kept = (n - len(line.translate(None, kind)) for kind in (UPPER, DIGIT, MARKS, SYMBOLS, HIGH))
        rows.append(
            (
                *(k * share for k in kept),
                line.count(b"!") * share,
                line.count(b"|") * share,
                min(sum(map(len, words)) * each, 40.0) / 10,
                sum(map(operator.eq, words, words[1:])) * each,
                len(set(words)) * each,
                float(line in seen and n > 0),
                float(n == 0),
                min(n, 2000) / 1000,
            )
        )
        sizes.append(n + 1)
        seen.add(line)
    return rows, sizes


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with those of the line before and after (zero at the ends), lengths, and first lines of texts."""
    rows, sizes, starts = [], [], [0]
    for text in texts:
        a, b = line_features(text)
        rows += a
        sizes += b
        starts.append(len(rows))
    own, starts = np.array(rows, np.float64).reshape(-1, OWN), np.array(starts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts[:-1]], after[starts[1:] - 1] = 0, 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), np.array(sizes, np.float64), starts


def marginals(scores: np.ndarray, stay: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of bad-bad and good-good neighbours of each text.

    scores: log odds of good by the line's own evidence; stay: log weights of bad-bad and good-good. All texts advance
    together, line by line, longest first.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[:-1][order], sizes[order]
    hop = np.exp(np.array([[stay[0], 0.0], [0.0, stay[1]]]))
    up = np.clip(scores, -60, 60)
    evidence = np.stack([np.where(up > 0, np.exp(-np.abs(up)), 1.0), np.where(up > 0, 1.0, np.exp(-np.abs(up)))], 1)
    forward, backward = np.empty_like(evidence), np.empty_like(evidence)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # texts with more than t lines
    for t in range(longest):
        at = first[: alive[t]] + t
        f = evidence[at] if t == 0 else evidence[at] * (forward[at - 1] @ hop)
        forward[at] = f / f.sum(1, keepdims=True)
    pairs = np.zeros((len(sizes), 2))
    for t in range(longest - 1, -1, -1):
        at, more = first[: alive[t]] + t, alive[t + 1]
        backward[at] = 1.0
        if more:
            here, there = at[:more], at[:more] + 1
            message = evidence[there] * backward[there]
            b = message @ hop.T
            both = forward[here][:, :, None] * hop[None] * message[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            pairs[:more] += both[:, [0, 1], [0, 1]]
            backward[here] = b / b.sum(1, keepdims=True)
    joint = forward * backward
    expected = np.empty_like(pairs)
    expected[order] = pairs
    return joint[:, 1] / joint.sum(1), expected


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def averages(good: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length-weighted means of the lines' marginals, as log odds."""
    mean = np.add.reduceat(good * sizes, starts[:-1]) / np.add.reduceat(sizes, starts[:-1])
    return np.log((mean + 1e-6) / (1 - mean + 1e-6))


def train(texts: list[bytes], labels: np.ndarray) -> dict:
    """Fits the field by Adam on the conditional likelihood, each document weighing the same, then the final curve."""
    if len(set(labels.tolist())) < 2:
        return {"constant": (float(labels.sum()) + 1) / (len(labels) + 2)}
    x, sizes, starts = features(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    x = (x - mean) / scale
    count = np.diff(starts)
    y, weight = np.repeat(labels, count), np.repeat(1.0 / count, count) / len(labels)
    pairs = np.stack([(1 - labels) * (count - 1), labels * (count - 1)], 1)
    w = np.zeros(x.shape[1] + 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        good, expected = marginals(x @ w[:-2], w[-2:], starts)
        gradient = np.concatenate([x.T @ ((y - good) * weight), (((pairs - expected) / count[:, None]).sum(0)) / len(labels)]) - RIDGE * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    doc = averages(marginals(x @ w[:-2], w[-2:], starts)[0], sizes, starts)
    slope, shift = 1.0, 0.0
    for _ in range(300):  # the final curve: two parameters
        p = sigmoid(slope * doc + shift)
        slope += 0.05 * (((labels - p) * doc).mean() - 1e-3 * (slope - 1))
        shift += 0.5 * (labels - p).mean()
    return {"w": w, "mean": mean, "scale": scale, "curve": (slope, shift)}


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    x, sizes, starts = features(texts)
    good, _ = marginals(((x - model["mean"]) / model["scale"]) @ model["w"][:-2], model["w"][-2:], starts)
    slope, shift = model["curve"]
    return sigmoid(slope * averages(good, sizes, starts) + shift)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from labelled rows outside the held-out fold. Only the bounded training sample reaches the driver: TRAIN_DOCS x TRAIN_BYTES at most."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != 0))
    chosen = marked.groupBy("doc_id").agg(F.max("quality").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), "__label"))  # TRAIN_DOCS rows at most
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    found = short.join(chosen, F.col("doc_id") == F.col("__id")).select("doc_id", "__label", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_DOCS).toArrow()
    texts, classes, lines = [], [], 0
    for text, label in zip(found.column("text").cast(pa.binary()).to_pylist(), found.column("__label").to_pylist()):
        lines += (text or b"").count(b"\n") + 1
        if lines > TRAIN_LINES and texts:
            break
        texts.append(text or b"")
        classes.append(label)
    return train(texts, np.array(classes, np.float64)) if texts else {"constant": 0.5}


def score(text: Column, model: dict) -> Column:
    """P(good) of each whole text."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        return pa.array(np.concatenate([score_texts(model, texts[i : i + 500]) for i in range(0, len(texts), 500)] or [np.empty(0)]))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the columns score and predicted."""
    scored = docs.withColumn("score", score(F.col("text"), fit(docs, labels)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict = {}

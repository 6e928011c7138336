"""HTML main text: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi.

The features of a leaf block (``html_blocks``) are its ancestors' tags and the kinds of words in their class, id and role attributes,
the share of the page's prose that stands in the same container, and measures of its text: length, links, marks, capitals, place on
the page. What a block's form tells against it (links, a line of rights, the first or last place) doesn't count inside an article or main
element. The field labels every block main text or not.

The tables hold no labels, so the field is trained on ``PAGES`` labelled pages that ``html_layouts`` lays out at random. The fit is the
same in every run.

Defined results: null and empty pages, and pages without main text, give the empty text; character references are decoded;
every run of white space in a block becomes one space; blocks of white space alone are no blocks; pages of any length are
read whole; repeated rows are treated alike; an empty table gives an empty result; other columns are kept;
columns named text or n_chars are replaced by the result.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.html_blocks import KINDS, TAGS, Node, blocks
from tapeworks.llm.html_layouts import labelled_page
from tapeworks.llm.quality import marginals
from tapeworks.llm.util import table

PAGES, SEED = 1200, 11
ROUNDS, RATE, RIDGE = 500, 0.1, 2e-4
TEXT_FEATURES = 12
PLACE_FEATURES = 8
#: How a line of rights begins.
SIGNED = re.compile(r"\W{0,3}(?:©|\(c\)|copyright\b)", re.I)
#: Characters of a block beyond which it counts as prose of its container.
PROSE = 40
#: Blocks of a page beyond which it is decoded by itself.
LONG = 2_000
FEATURES = len(TAGS) + 2 * len(KINDS) + PLACE_FEATURES + TEXT_FEATURES + 1


def block_features(found: list[tuple[str, Node, int]]) -> np.ndarray:
    """Of each block: its ancestors' tags and kinds, its place among them, its text."""
    x = np.zeros((len(found), FEATURES))
    bits = lambda values, n: np.array(values, np.int64)[:, None] >> np.arange(n) & 1
    at = len(TAGS) + 2 * len(KINDS)
    x[:, :at] = np.hstack([bits([n.tags for _, n, _ in found], len(TAGS)), bits([n.kinds for _, n, _ in found], len(KINDS)), bits([n.nearest for _, n, _ in found], len(KINDS))])
    prose: dict = {}
    for text, node, linked in found:
        if len(text) > PROSE and linked < 0.3 * len(text):
            prose[id(node.home)] = prose.get(id(node.home), 0) + len(text)
    whole, most = max(1, sum(prose.values())), max(prose.values(), default=0)
    core_page = any(n.core for _, n, _ in found)
    signed = [bool(SIGNED.match(text)) for text, _, _ in found]
    for i, (text, node, linked) in enumerate(found):
        words, n, here = text.count(" ") + 1, len(text), prose.get(id(node.home), 0)
        out = not node.core or node.off  # what a text's form tells against it doesn't count where its place tells for it
        x[i, at:-1] = (
            not out,
            node.core and node.off,
            not node.core and node.off,
            core_page and not node.core,
            here / whole,
            here > 0 and here == most,
            not core_page and signed[i] and i >= len(found) - 2,
            not core_page and here < most and i >= len(found) - 2,
            min(np.log1p(words), 6) / 3,
            out and min(1.0, linked / n),
            min(1.0, 10 * sum(map(text.count, ".,;:!?")) / n),
            text[-1] in ".!?\"'",
            text[0].isupper(),
            out and signed[i],
            words < 4,
            words > 20,
            out and linked > 0.8 * n,
            i / len(found),
            out and i == 0,
            out and i == len(found) - 1,
        )
    x[:, -1] = 1.0
    return x


def features(pages: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all pages' blocks with those of the neighbours' text, and the pages' first blocks."""
    starts = np.cumsum([0, *map(len, pages)])
    own = np.concatenate([block_features(p) for p in pages]) if starts[-1] else np.zeros((0, FEATURES))
    text = own[:, -1 - TEXT_FEATURES : -1]
    before, after = np.zeros_like(text), np.zeros_like(text)
    before[1:], after[:-1] = text[:-1], text[1:]
    edges = starts[:-1][np.diff(starts) > 0]
    before[edges] = 0
    after[starts[1:][np.diff(starts) > 0] - 1] = 0
    return np.hstack([before, after, own]), starts


def viterbi(scores: np.ndarray, stay: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The likeliest labels of each page's blocks; pages of up to ``LONG`` blocks advance together."""
    sizes = np.diff(starts)
    long = np.flatnonzero(sizes > LONG)
    sizes = np.where(sizes > LONG, 0, sizes)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[:-1][order], sizes[order]
    hop = np.array([[stay[0], 0.0], [0.0, stay[1]]])
    gain = np.stack([np.zeros(len(scores)), scores], 1)
    best, back = gain.copy(), np.zeros((len(scores), 2), np.int8)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]
    for t in range(1, longest):
        at = first[: alive[t]] + t
        paths = best[at - 1][:, :, None] + hop[None]
        back[at] = paths.argmax(1)
        best[at] = gain[at] + paths.max(1)
    labels = np.zeros(len(scores), np.int8)
    for t in range(longest - 1, -1, -1):
        at, more = first[: alive[t]] + t, alive[t + 1]
        labels[at] = best[at].argmax(1)
        if more:
            later = at[:more] + 1
            labels[at[:more]] = back[later, labels[later]]
    for page in long:
        labels[starts[page] : starts[page + 1]] = decoded(scores[starts[page] : starts[page + 1]].tolist(), float(stay[0]), float(stay[1]))
    return labels


def decoded(scores: list[float], bad_bad: float, good_good: float) -> list[int]:
    """The same of one page, block by block."""
    bad, good, back = 0.0, scores[0], []
    for gain in scores[1:]:
        back.append((int(good > bad + bad_bad), int(good + good_good > bad)))
        bad, good = max(bad + bad_bad, good), max(bad, good + good_good) + gain
    labels = [int(good > bad)]
    for came in reversed(back):
        labels.append(came[labels[-1]])
    return labels[::-1]


def labels_of(found: list, main: list[str]) -> list[int]:
    """1 for the blocks that are the main texts, met in order."""
    out, i = [], 0
    for text, *_ in found:
        hit = i < len(main) and text == main[i]
        out.append(int(hit))
        i += hit
    return out


@functools.lru_cache(maxsize=2)
def model(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of bad-bad and good-good neighbours, by Adam on the conditional likelihood."""
    rng, parsed, y = random.Random(seed), [], []
    for _ in range(pages):
        page, main = labelled_page(rng)
        found = blocks(page)
        if found:
            parsed.append(found)
            y += labels_of(found, main)
    x, starts = features(parsed)
    y, sizes = np.array(y, np.float64), np.diff(starts)
    pair = y[1:] * y[:-1], (1 - y[1:]) * (1 - y[:-1])
    cut = np.ones(len(y) - 1, bool)
    cut[starts[1:-1] - 1] = False
    seen = np.array([pair[1][cut].sum(), pair[0][cut].sum()])
    w = np.zeros(x.shape[1] + 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        good, expected = marginals(x @ w[:-2], w[-2:], starts)
        gradient = np.concatenate([x.T @ (y - good), seen - expected.sum(0)]) / len(sizes) - RIDGE * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-2], w[-2:]


def main_texts(pages: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    parsed = [blocks(p) for p in pages]
    x, starts = features(parsed)
    labels = viterbi(x @ weights[0], weights[1], starts)
    return ["\n\n".join(text for (text, *_), good in zip(found, labels[a:b]) if good) for found, a, b in zip(parsed, starts[:-1], starts[1:])]


def main_text(column: Column) -> Column:
    """The main text of each whole page."""
    weights = model()

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        texts = [p or "" for p in pages.to_pylist()]
        return pa.array([t for i in range(0, len(texts), 200) for t in main_texts(texts[i : i + 200], weights)], pa.string())

    return run(column)


def extract(pages: DataFrame) -> DataFrame:
    """pages with the columns text and n_chars."""
    return pages.withColumn("text", main_text(F.col("html"))).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op8_html_main": op8_html_main}
ORACLE_SQL: dict = {}

"""Classes of texts, found from the counts of their common words, as many as shorten the code."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.util import forget, stored

END = b"\n"
#: Texts that seed classes, which is also the most classes there can be; words that tell classes apart; and passes that refine them.
SEEDS, TELLING, STEPS = 32, 4096, 5
#: Bytes of text that are read together.
GROUP = 1 << 22


class Words:
    """Several texts as their lower-cased words, one end after each text's."""

    def __init__(self, texts: pa.Array):
        lowered = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), "")))
        lists = pc.ascii_split_whitespace(lowered)
        empty = pc.equal(pc.binary_length(lowered), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        #: All words but the ends.
        self.flat = flat.filter(pc.greater(pc.binary_length(flat), 0)) if empty.any() else flat
        self.sizes = np.where(empty, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes

    def numbers(self, value_set: pa.Array, end: int) -> np.ndarray:
        """Each token's place in the set, -1 for none; ``end`` for the ends."""
        out = np.empty(int(self.sizes.sum()), np.int64)
        ends = self.starts + self.sizes - 1
        words = np.ones(len(out), bool)
        words[ends] = False
        out[words] = pc.fill_null(pc.index_in(self.flat, value_set=value_set), -1).to_numpy(zero_copy_only=False)
        out[ends] = end
        return out

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The different words, the end last, and each token's place among them."""
        coded = self.flat.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        out = np.full(int(self.sizes.sum()), len(words), np.int64)
        inner = np.ones(len(out), bool)
        inner[self.starts + self.sizes - 1] = False
        out[inner] = coded.indices.to_numpy()
        return [*words, END], out

    def spelled(self, at: np.ndarray) -> list[bytes]:
        """The tokens at some places."""
        text = np.searchsorted(self.starts, at, side="right") - 1
        ends = self.starts + self.sizes - 1
        words = self.flat.take(pa.array(np.minimum(at - text, max(len(self.flat) - 1, 0)))).cast(pa.binary()).to_pylist() if len(self.flat) else [END] * len(at)
        return [END if end else w for w, end in zip(words, (ends[text] == at).tolist())]


def groups(batches, text: int):
    """Batches cut or joined to about GROUP bytes of text, never within a text."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < len(batch):
            done = int(sizes[at - 1]) if at else 0
            to = min(len(batch), int(np.searchsorted(sizes, done + GROUP - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(sizes[to - 1]) - done
            at = to
            if size >= GROUP:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def place_of(words: list[bytes], word: bytes) -> int:
    return words.index(word) if word in words else -1


class Classes:
    """Tells the class of a text from its common words, as the likeliest of a mixture of word distributions."""

    def __init__(self, words: list[bytes], odds: np.ndarray):
        self.words, self.odds = words, odds
        self.padded = np.hstack([np.zeros((len(odds), 1)), odds]).astype(np.float32).T.copy()  # the first row is for other words

    def best(self, telling: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The class of each of several texts, whose words' places among the telling ones (-1: none) follow one another."""
        width, out, first = len(self.padded), [], 0
        for i in range(0, len(sizes), 256):
            part = sizes[i : i + 256]
            last = first + int(part.sum())
            counts = np.bincount(np.repeat(np.arange(len(part)) * width, part) + telling[first:last] + 1, minlength=len(part) * width)
            out.append(np.argmax(counts.reshape(-1, width).astype(np.float32) @ self.padded, axis=1))
            first = last
        return np.concatenate(out)

    def of(self, texts: list[str]) -> np.ndarray:
        found = Words(pa.array(texts, pa.string()))
        return self.best(found.numbers(pa.array(self.words, pa.binary()).cast(pa.string()), place_of(self.words, END)), found.sizes)


def telling_words(shared):
    """For mapInArrow over (key, text): key, how many telling words, which ones (at) and how often each (n)."""

    def run(batches):
        words = shared.value
        among, end, width = pa.array(words, pa.binary()).cast(pa.string()), place_of(words, END), len(words) + 1
        for batch in groups(batches, 1):
            read = Words(batch.column(1))
            found = read.numbers(among, end) + 1
            pairs, times = np.unique(np.repeat(np.arange(len(batch)) * width, read.sizes) + found, return_counts=True)
            text, at = np.divmod(pairs, width)
            kept = at > 0
            text, at, times = text[kept], at[kept] - 1, times[kept]
            edges = np.searchsorted(text, np.arange(len(batch) + 1)).tolist()
            at, n, sums = at.astype(np.uint16), times.astype(np.uint32), np.append(0, np.cumsum(times))
            known = sums[edges[1:]] - sums[edges[:-1]]
            columns = ([x[a:b].tobytes() for a, b in zip(edges, edges[1:])] for x in (at, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], names=["key", "known", "at", "n"])

    return run


def classed(at, n, odds: np.ndarray):
    """Of several texts' telling words: the text, place and count of each, and the texts' classes and fit to them."""
    places = [np.frombuffer(x, np.uint16) for x in at]
    texts = np.repeat(np.arange(len(places)), [*map(len, places)])
    flat, times = np.concatenate(places).astype(np.int64), np.concatenate([np.frombuffer(x, np.uint32) for x in n]).astype(np.int64)
    dense = np.zeros((len(places), odds.shape[1]), np.float32)
    dense[texts, flat] = times
    fit = dense @ odds.T.astype(np.float32)
    return texts, flat, times, np.argmax(fit, axis=1), fit.max(axis=1)


def class_sums(shared):
    """For mapInArrow over (key, known, at, n): class, telling word (-1: texts) and its count, summed over the task."""

    def run(batches):
        odds = shared.value
        width = odds.shape[1] + 1
        sums = np.zeros(len(odds) * width, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 256):
                at, n = (batch.column(k).slice(i, 256).to_pylist() for k in (2, 3))
                texts, flat, times, kinds, _ = classed(at, n, odds)
                np.add.at(sums, kinds[texts] * width + flat, times)
                np.add.at(sums, kinds * width + width - 1, 1)
        used = np.flatnonzero(sums)
        at = np.where(used % width == width - 1, -1, used % width)
        yield pa.RecordBatch.from_arrays([pa.array((used // width).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[used])], names=["cls", "at", "n"])

    return run


def spread(sums: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log share of each telling word in each class."""
    return np.log((sums + 20 * prior) / (sums.sum(axis=-1, keepdims=True) + 20))


def code_lengths(sums: np.ndarray, many: np.ndarray, texts: int, prior: np.ndarray) -> np.ndarray:
    """Nats of each class: its words, its name for each of its texts, and its shares."""
    words = -(sums * spread(sums, prior)).sum(axis=-1)
    return words - many * np.log(np.maximum(many, 1) / texts) + 0.5 * (sums > 0).sum(axis=-1) * math.log(texts + 1)


def joined(sums: np.ndarray, many: np.ndarray, prior: np.ndarray):
    """Joins the two classes that gain most by it, as long as that shortens the code."""
    texts, sums, many = int(many.sum()), list(sums), list(many)
    cost = [float(code_lengths(r, m, texts, prior)) for r, m in zip(sums, many)]
    gain = lambda i, j: cost[i] + cost[j] - float(code_lengths(sums[i] + sums[j], many[i] + many[j], texts, prior))
    gains = {(i, j): gain(i, j) for i in range(len(sums)) for j in range(i)}
    while gains and max(gains.values()) > 0:
        i, j = max(gains, key=gains.get)
        sums.append(sums[i] + sums[j])
        many.append(many[i] + many[j])
        cost.append(cost[i] + cost[j] - gains[i, j])
        gains = {p: g for p, g in gains.items() if not {i, j} & set(p)}
        gone = {i, j} | {k for k in range(len(sums) - 1) if sums[k] is None}
        for k in (i, j):
            sums[k] = None
        gains |= {(len(sums) - 1, k): gain(len(sums) - 1, k) for k in range(len(sums) - 1) if k not in gone}
    left = [k for k, r in enumerate(sums) if r is not None]
    return np.stack([sums[k] for k in left]), np.array([many[k] for k in left])


def find_classes(train: DataFrame, words: list[bytes], whole: np.ndarray) -> Classes:
    """Classes of all training texts. words: the telling ones, by falling count; whole: how often training texts hold them."""
    context = train.sparkSession.sparkContext
    if not words:
        return Classes([], np.zeros((1, 0)))
    prior = (whole + 0.5) / (whole.sum() + 0.5 * len(whole))
    shared = context.broadcast(words)
    rows = stored(train.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(telling_words(shared), "key long, known long, at binary, n binary"), "telling")

    def refined(odds: np.ndarray, steps: int):
        last = math.inf
        for _ in range(steps):
            shared = context.broadcast(odds)
            found = rows.mapInArrow(class_sums(shared), "cls int, at int, n long").groupBy("cls", "at").agg(F.sum("n").alias("n")).toArrow()  # SEEDS x TELLING rows at most
            shared.destroy()
            cls, at, n = (found.column(x).to_numpy() for x in ("cls", "at", "n"))
            all_ = np.zeros((len(odds), len(words) + 1))
            all_[cls, at] = n  # texts are last
            all_ = all_[all_[:, -1] > 0]
            sums, many = all_[:, :-1], all_[:, -1]
            odds, now = spread(sums, prior), float(code_lengths(sums, many, int(many.sum()), prior).sum())
            if now > 0.999 * last:
                break
            last = now
        return sums, many

    first = rows.orderBy(F.desc(F.least("known", F.lit(100))), "key", "at", "n").limit(SEEDS).toArrow()  # rows of at most 6 bytes a telling word
    dense = np.zeros((len(first), len(words)))
    for k, (at, n) in enumerate(zip(first.column("at").to_pylist(), first.column("n").to_pylist())):
        dense[k, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    sums, many = joined(*refined(spread(dense, prior), STEPS), prior)
    found = Classes(words, spread(refined(spread(sums, prior), 2)[0], prior))
    forget(rows)
    return found

"""Logistic mixing of hashed-context bit predictors, learnt online.

A symbol is coded as the bits of its path in a binary tree. For each bit, each predictor looks up how often 0 and 1 followed
in its context at that node; the log odds of all predictors are summed with weights chosen by a gate (how often the two
longest contexts were seen, and whether a guessed symbol still agrees), and the sum is refined by an adaptive map for each
gate. Weights and maps learn after every batch of ``CHUNK`` symbols and level of the tree, from training symbols only. A training
symbol's own occurrence is taken out of every count that it is coded with, so all symbols are coded by what others say.
"""

from __future__ import annotations

import math

import numpy as np

CHUNK = 1 << 15
#: Counts are kept in one byte: exact up to EXACT, then in steps of GROWTH; above the last step both counts of a slot shrink alike.
EXACT, GROWTH = 32, 1.07
LARGEST = EXACT * GROWTH ** (255 - EXACT)
KEPT = np.concatenate([np.arange(EXACT + 1), EXACT * GROWTH ** np.arange(1, 256 - EXACT)])
BUCKETS, LEVELS = 33, 8
GATES = LEVELS * LEVELS * 2
RIDGE, RATE = 1e3, 0.05
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def log_codes(counts: np.ndarray) -> np.ndarray:
    steps = np.floor(np.log(np.maximum(counts, 1.0) / EXACT) / math.log(GROWTH) + 0.5) + EXACT
    return np.where(counts <= EXACT, np.floor(counts + 0.5), np.minimum(steps, 255)).astype(np.uint16)


SMALL = log_codes(np.arange(1 << 16, dtype=np.float64))


def pair_codes(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """zeros' code * 256 + ones' code; counts over the largest code keep their ratio."""
    out = SMALL[np.minimum(zeros, 65535)] * np.uint16(256) + SMALL[np.minimum(ones, 65535)]
    if len(big := np.flatnonzero((zeros > 65535) | (ones > 65535))):
        z, o = zeros[big].astype(np.float64), ones[big].astype(np.float64)
        shrink = np.maximum(np.maximum(z, o) / LARGEST, 1.0)
        out[big] = log_codes(z / shrink) * np.uint16(256) + log_codes(o / shrink)
    return out


def log_odds(zeros, ones):
    return (np.log(ones + 0.08) - np.log(zeros + 0.08)).astype(np.float32)


class Lookups:
    """By a slot's two codes: log odds of a one and how often it was seen; less one zero, less one one, and as they are."""

    def __init__(self):
        zeros, ones = np.repeat(KEPT, 256), np.tile(KEPT, 256)
        less = [(np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0)), (zeros, ones)]
        self.odds = np.concatenate([log_odds(z, o) for z, o in less])
        steps = [1, 2, 3, 6, 15, 60, 400]
        self.seen = np.concatenate([np.searchsorted(steps, z + o, side="right") for z, o in less]).astype(np.int16)
        self.seen_first = self.seen * np.int16(LEVELS)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tree:
    """A binary prefix code. child[2 * node + bit] is the next node, or -1 - symbol; node 0 is the root."""

    def __init__(self, child: np.ndarray, code: np.ndarray, depth: np.ndarray):
        self.child, self.code, self.depth = child.astype(np.int64), code, depth

    @classmethod
    def bytes(cls) -> Tree:
        """The 256 bytes, highest bit first."""
        node = np.arange(1, 256)
        child = np.stack([2 * node, 2 * node + 1], 1).ravel()
        child = np.where(child < 256, child - 1, -1 - (child - 256))
        return cls(child, np.arange(256, dtype=np.uint64), np.full(256, 8, np.int8))

    @classmethod
    def huffman(cls, counts: np.ndarray) -> Tree:
        """The shortest code by counts (at least one symbol), with paths of fewer than 64 bits."""
        n = len(counts)
        weights = np.maximum(counts.astype(np.float64), max(counts.sum(), 1) / 2.0**40)
        order = np.argsort(weights, kind="stable")
        leaves, made, pairs, a = weights[order].tolist() + [math.inf], [], [], 0
        names, b = order.tolist(), 0
        for _ in range(n - 1):
            two = []
            for _ in range(2):
                if b >= len(made) or leaves[a] <= made[b]:
                    two.append((leaves[a], -1 - names[a]))
                    a += 1
                else:
                    two.append((made[b], b))
                    b += 1
            made.append(two[0][0] + two[1][0])
            pairs.append((two[0][1], two[1][1]))
        inner = np.array(pairs, np.int64).reshape(-1, 2)[::-1]  # the root first
        child = np.where(inner >= 0, n - 2 - inner, inner).ravel()
        code, depth = np.zeros(n, np.uint64), np.zeros(n, np.int8)
        level, path, d = np.zeros(min(n - 1, 1), np.int64), np.zeros(min(n - 1, 1), np.uint64), 0
        while len(level):
            d += 1
            both = np.stack([child[2 * level], child[2 * level + 1]], 1).ravel().astype(np.int64)
            paths = (np.repeat(path, 2) << np.uint64(1)) | np.tile(np.array([0, 1], np.uint64), len(level))
            ends = both < 0
            code[-1 - both[ends]], depth[-1 - both[ends]] = paths[ends], d
            level, path = both[~ends], paths[~ends]
        return cls(child, code, depth)

    def node_counts(self, counts: np.ndarray) -> np.ndarray:
        """Zeros and ones of every node from counts of the symbols."""
        nodes = len(self.child) // 2
        total = np.zeros(nodes, np.int64)
        sides = self.child.reshape(-1, 2).astype(np.int64)
        out = np.zeros((nodes, 2), np.int64)
        levels, level = [], np.zeros(min(nodes, 1), np.int64)
        while len(level):
            levels.append(level)
            both = sides[level].ravel()
            level = both[both >= 0]
        for level in reversed(levels):
            both = sides[level]
            out[level] = np.where(both < 0, counts[np.maximum(-1 - both, 0)], total[np.maximum(both, 0)])
            total[level] = out[level].sum(1)
        return out

    def paths(self, symbols: np.ndarray) -> np.ndarray:
        """The bits of the symbols, the first one highest."""
        return self.code[symbols] << (64 - np.maximum(self.depth[symbols], 1)).astype(np.uint64)

    def levels(self, symbols: np.ndarray, depth: np.ndarray | None = None):
        """For symbols ordered by falling depth (how many of their bits are asked for; None: all): how many have a bit at each level, nodes, and bits."""
        depth = self.depth[symbols] if depth is None else depth
        path = self.paths(symbols)  # the next bit comes first
        ends = np.searchsorted(-depth, -np.arange(int(depth[0]) if len(depth) else 0), side="left").tolist()
        node = np.zeros(len(symbols), np.int64)
        for d, m in enumerate(ends):
            path, node = path[:m], node[:m]
            bit = (path >> np.uint64(63)).view(np.int64)
            yield d, m, node, bit
            path = path << np.uint64(1)
            node = 2 * node
            node += bit
            node = self.child.take(node)


class Fixed:
    """A predictor whose slots are nodes, or (row, node); codes come ready."""

    def __init__(self, codes: np.ndarray, row: np.ndarray | None = None, nodes: int = 0):
        self.codes, self.first = codes, None if row is None else row.astype(np.int64) * nodes

    def begin(self, at: np.ndarray) -> None:
        self.here = None if self.first is None else self.first[at]

    def slots(self, d: int, node: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        return node if self.here is None else self.here[: len(node)] + node


def reaches(context: np.ndarray, symbols: np.ndarray, tree: Tree) -> np.ndarray:
    """At how many nodes of its path each symbol meets other symbols of the same context; beyond, its counts would tell nobody else."""
    key = (context * K1 >> np.uint64(32) << np.uint64(32)) | tree.paths(symbols) >> np.uint64(32)
    order = np.argsort(key)
    key = key[order]
    apart = np.frexp((key[1:] ^ key[:-1]).astype(np.float64))[1]  # bits from the first that differs on; neighbours share most
    differ = np.minimum(np.append(64, apart), np.append(apart, 64))
    found = np.empty(len(key), np.int8)
    found[order] = np.where(differ, np.maximum(33 - differ, 0), 127)  # 127: alike as far as they were compared
    return np.minimum(found, tree.depth[symbols])


class Hashed:
    """A predictor in a table of hashed (context, node); symbols see nothing there beyond the first ``reach`` nodes of their paths."""

    def __init__(self, context: np.ndarray, bits: int, reach: np.ndarray | None = None):
        self.context, self.shift, self.reach, self.bits = context, np.uint64(64 - bits), reach, bits
        self.codes: np.ndarray | None = None

    def begin(self, at: np.ndarray) -> None:
        self.here = self.context[at]
        self.ends = None if self.reach is None else self.reach[at]

    def slots(self, d: int, node: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        slot = self.here[: len(node)] + mixed
        slot *= K1
        slot >>= self.shift
        slot = slot.view(np.int64)
        if self.ends is not None:
            np.putmask(slot, self.ends[: len(node)] <= d, 1 << self.bits)  # the last slot stays empty
        return slot


def count(contexts: list[Hashed], symbols: np.ndarray, train: np.ndarray, tree: Tree) -> None:
    """Fills the contexts' tables with counts of the training symbols, each as far as it reaches."""
    for c in contexts:
        held = np.zeros((1 << c.bits) * 2 + 2, np.int32)
        reach = tree.depth[symbols] if c.reach is None else c.reach
        counted = np.flatnonzero(train & (reach > 0))
        for i in range(0, len(counted), CHUNK):
            at = counted[i : i + CHUNK]
            at = at[np.argsort(-reach[at], kind="stable")]
            c.begin(at)
            for d, _, node, bit in tree.levels(symbols[at], reach[at]):
                slot = c.slots(d, node, node.view(np.uint64) * K2)
                slot *= 2
                slot += bit
                np.add.at(held, slot, np.int32(1))
        used = np.flatnonzero(held.view(np.int64))  # most slots hold nothing
        c.codes = np.zeros(len(held) // 2, np.uint16)
        c.codes[used] = pair_codes(held[::2][used], held[1::2][used])


class Mixer:
    """Gated weights, the adaptive maps behind them, and what a guess that still agrees is worth."""

    def __init__(self, first: list[float]):
        start = np.array([[*first, 0.3]]).T
        self.weights = np.tile(start, (1, GATES)).astype(np.float32)
        self.met = np.full(self.weights.shape, RIDGE)
        self.centre = np.tile(sigmoid((np.arange(BUCKETS) - BUCKETS // 2) / 2.0), GATES)
        self.maps = np.zeros((2, GATES * BUCKETS))  # ones, all
        self.guesses = np.tile(np.array([[3.0], [4.0]]), (1, 64))  # agreed, all; by level

    def refine(self) -> None:
        """Takes over what the maps have learnt."""
        self.map = ((self.maps[0] + 30 * self.centre) / (self.maps[1] + 30)).astype(np.float32)
        kept = np.clip(self.guesses[0] / self.guesses[1], 0.01, 0.9999)
        self.worth = np.log(kept / (1 - kept)).astype(np.float32)

    def predict(self, inputs, gate):
        """Even before the maps, after them, and the maps' places."""
        z = self.weights[0].take(gate) * inputs[0]
        for k, x in enumerate(inputs[1:], 1):
            z += self.weights[k].take(gate) * x
        np.clip(z, -14, 14, out=z)
        bucket = np.clip(z * 2, -(BUCKETS // 2), BUCKETS // 2)
        bucket = gate * BUCKETS + (np.rint(bucket, out=bucket) + BUCKETS // 2).astype(np.int64)
        p = sigmoid(z)
        return p, np.clip(0.5 * (p + self.map.take(bucket)), 1e-6, 1 - 1e-6), bucket

    def learn(self, inputs, gate, bit, p, bucket, known) -> None:
        """One online step of each gate's weights, shorter the more slope it has met; symbols that aren't known teach nothing."""
        error = (bit - p).astype(np.float32) * known
        for k, x in enumerate(inputs):
            slope = np.bincount(gate, error * x, GATES)
            self.met[k] += slope * slope
            self.weights[k] += (RATE * slope / np.sqrt(self.met[k])).astype(np.float32)
        met = np.bincount(2 * bucket + bit, known, 2 * GATES * BUCKETS).reshape(-1, 2)
        self.maps[0] += met[:, 1]
        self.maps[1] += met[:, 0] + met[:, 1]


def coded(symbols: np.ndarray, train: np.ndarray, tree: Tree, predictors: list, mixer: Mixer, look: Lookups, guess: np.ndarray | None = None) -> np.ndarray:
    """Log10 probability of each symbol, in order; what one chunk teaches serves the next. The first chunk is read twice."""
    out = np.zeros(len(symbols))
    starts = list(range(0, len(symbols), CHUNK))
    for turn, i in enumerate([*starts[:1], *starts]):
        at = np.arange(i, min(i + CHUNK, len(symbols)))
        at = at[np.argsort(-tree.depth[symbols[at]], kind="stable")]
        total, known = np.ones(len(at)), train[at]
        less = np.where(known, 0, 2 << 16)  # a training symbol's own occurrence doesn't count
        step, known = np.where(known, 1 << 16, 0), known.astype(np.float32)
        for p in predictors:
            p.begin(at)
        if guess is not None:
            hoping = np.flatnonzero(guess[at] >= 0)
            hope = guess[at[hoping]]
            hope_code, hope_depth = tree.code[hope], tree.depth[hope].astype(np.int64)
        mixer.refine()
        for d, m, node, bit in tree.levels(symbols[at]):
            own, mixed = less[:m] + bit * step[:m], node.view(np.uint64) * K2
            codes = [p.codes.take(p.slots(d, node, mixed)) + own for p in predictors]
            inputs = [look.odds.take(c) for c in codes]
            gate = (look.seen_first.take(codes[-1]) + look.seen.take(codes[-2])).astype(np.int64)
            if guess is not None:
                on = (hoping < m) & (hope_depth > d)
                hoping, hope_code, hope_depth = hoping[on], hope_code[on], hope_depth[on]
                hoped = (hope_code >> (hope_depth - d - 1).astype(np.uint64) & np.uint64(1)).astype(np.int64)
                gate[hoping] += LEVELS * LEVELS
                extra = np.zeros(m, np.float32)
                extra[hoping] = mixer.worth[d] * (2 * hoped - 1)
                inputs.append(extra)
            p, fine, bucket = mixer.predict(inputs, gate)
            wave = bit.astype(np.float32)
            total[:m] *= np.abs(1 - wave - fine)
            mixer.learn(inputs, gate, bit, p, bucket, known[:m])
            if guess is not None:
                right, learnt = hoped == bit[hoping], known[hoping]
                mixer.guesses[:, d] += (right * learnt).sum(), learnt.sum()
                hoping, hope_code, hope_depth = hoping[right], hope_code[right], hope_depth[right]
        if turn:
            out[at] = np.log10(total)
    return out

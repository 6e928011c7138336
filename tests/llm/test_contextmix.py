import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import bitmix, contextmix, textclass

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_base(rows):
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows}
    words = [(t or "").encode().translate(LOWER).split() + [b"\n"] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, words) if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((held[i], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, words))


def shown(found):
    return sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)


def test_base_scores_of_edge_cases(edge):
    found = contextmix.scores(edge).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert shown(found) == plain_base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert all((r["bits_per_byte"] is None) == (not t) for r, t in zip(sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"])), [t for _, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))]) if r["doc_id"] not in (3, 9))
    assert contextmix.scores(edge.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_few_words_in_the_code_many_parts_and_hot_words(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, value in (("COMMON", 300), ("PART", 6000), ("HOT", 1500), ("SPELLED", 800), ("HELD_TOKENS", 5000), ("PIECE", 64), ("ROWS", 32)):
        monkeypatch.setattr(contextmix, name, value)
    found = contextmix.scores(docs, reread=True).collect()
    assert shown(found) == plain_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA.replace("0.001", "0.01")), reason="no tables")
def test_held_out_texts_score_well_above_the_base_and_the_order_of_words_counts(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    # each held-out text twice: as it is, and with its words sorted
    both = docs.select("doc_id", "text").union(docs.where(held).select("doc_id", F.array_join(F.array_sort(F.split("text", "\\s+")), " ").alias("text")).where("text != ''"))
    found = contextmix.scores(docs).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert found["score"] > 0.87 * found["base"]
    rows = contextmix.scores(both).where("held_out").groupBy("doc_id").agg(F.collect_list("score").alias("s"), F.collect_set("n_tokens").alias("n")).where("size(s) = 2 and size(n) = 1").collect()
    assert len(rows) > 50 and sum(abs(r["s"][0] - r["s"][1]) > 1 for r in rows) > 0.8 * len(rows)


def test_probabilities_of_all_symbols_sum_to_one():
    rng = np.random.default_rng(0)
    tree = bitmix.Tree.huffman(rng.integers(1, 1000, 300))
    symbols = np.arange(300)
    p = [bitmix.Fixed(rng.integers(0, 65536, len(tree.child) // 2).astype(np.uint16)) for _ in range(3)]
    found = bitmix.coded(symbols, np.zeros(300, bool), tree, p, bitmix.Mixer([0.3, 0.2, 0.4]), bitmix.Lookups(), np.full(300, 17))
    assert (10.0**found).sum() == pytest.approx(1, abs=1e-4)


def test_huffman_is_a_prefix_code_of_the_shortest_length():
    counts = np.array([1, 1, 2, 3, 5, 8, 0])
    tree = bitmix.Tree.huffman(counts)
    paths = [format(int(c), "b").zfill(d) for c, d in zip(tree.code, tree.depth)]
    assert not any(a != b and b.startswith(a) for a in paths for b in paths)
    assert (counts * tree.depth).sum() == 46
    assert tree.node_counts(counts)[0].sum() == 20 and bitmix.Tree.huffman(np.array([5])).depth.tolist() == [0]
    full = bitmix.Tree.bytes()
    _, _, node, bit = list(full.levels(np.array([200, 3])))[-1]
    assert [-1 - full.child[2 * n + b] for n, b in zip(node, bit)] == [200, 3]


def plain_coded(symbols, train, tree, contexts, mixer, guess):
    """Symbol by symbol, with counts by context as they are kept."""
    path = lambda s: [int(tree.code[s]) >> (int(tree.depth[s]) - d - 1) & 1 for d in range(tree.depth[s])]
    counts = [defaultdict(lambda: [0, 0]) for _ in contexts]
    for i, s in enumerate(symbols):
        bits = path(s)
        for d, b in enumerate(bits):
            for c, table in zip(contexts, counts):
                if train[i]:
                    table[c[i], tuple(bits[:d])][b] += 1
    weights, guesses = mixer.weights.astype(float).copy(), mixer.guesses.copy()
    met, maps, first = mixer.met.copy(), mixer.maps.copy(), mixer.centre
    levels = lambda n: int(np.searchsorted([1, 2, 3, 6, 15, 60, 400], n, side="right"))
    out = np.zeros(len(symbols))
    for turn in range(2):
        table = (maps[0] + 30 * first) / (maps[1] + 30)
        worth = np.log(np.clip(guesses[0] / guesses[1], 0.01, 0.9999) / (1 - np.clip(guesses[0] / guesses[1], 0.01, 0.9999)))
        out[:] = 0
        for d in range(max(tree.depth)):
            slope, changes = np.zeros_like(weights), []
            for i, s in enumerate(symbols):
                bits = path(s)
                if d >= len(bits):
                    continue
                b, seen, xs = bits[d], [], []
                for c, t in zip(contexts, counts):
                    pair = [float(bitmix.KEPT[int(bitmix.log_codes(np.array([x]))[0])]) for x in t[c[i], tuple(bits[:d])]]
                    pair[b] = max(0.0, pair[b] - bool(train[i]))
                    xs.append(math.log((pair[1] + 0.08) / (pair[0] + 0.08)))
                    seen.append(levels(sum(pair)))
                gate, hope = seen[-1] * 8 + seen[-2], path(guess[i]) if guess[i] >= 0 else []
                on = len(hope) > d and hope[:d] == bits[:d]
                gate += 64 * on
                xs.append(worth[d] * (2 * hope[d] - 1) if on else 0.0)
                z = max(-14, min(14, sum(w * x for w, x in zip(weights[:, gate], xs))))
                p = 1 / (1 + math.exp(-z))
                at = gate * 33 + round(max(-16, min(16, z * 2))) + 16
                fine = min(1 - 1e-6, max(1e-6, 0.5 * (p + table[at])))
                out[i] += math.log10(fine if b else 1 - fine)
                if train[i]:
                    slope[:, gate] += [(b - p) * x for x in xs]
                    changes.append((at, b, on, on and hope[d] == b))
            met += slope**2
            weights += bitmix.RATE * slope / np.sqrt(met)
            for at, b, on, right in changes:
                maps[0, at] += b
                maps[1, at] += 1
                guesses[:, d] += right, on
    return out


def test_mixing_against_a_plain_form():
    rng = np.random.default_rng(1)
    tree = bitmix.Tree.huffman(rng.integers(1, 50, 12))
    n = 400
    symbols, train = rng.integers(0, 12, n), rng.random(n) < 0.8
    one, two = np.append(0, symbols[:-1]), np.append([0, 0], symbols[:-2])
    guess = np.where(rng.random(n) < 0.5, symbols, np.where(rng.random(n) < 0.5, rng.integers(0, 12, n), -1))
    plain = [np.zeros(n, int), one, one * 12 + two]
    hashed = [bitmix.Hashed((c.astype(np.uint64) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15), 18) for k, c in enumerate(plain)]
    bitmix.count(hashed, symbols, train, tree)
    want = plain_coded(symbols, train, tree, plain, bitmix.Mixer([0.2, 0.3, 0.4]), guess)
    found = bitmix.coded(symbols, train, tree, hashed, bitmix.Mixer([0.2, 0.3, 0.4]), bitmix.Lookups(), guess)
    assert found == pytest.approx(want, abs=2e-3)


def test_counts_over_the_largest_code_keep_their_ratio():
    pairs = np.array([(10**9, 10**8), (10**8, 10**9), (4 * 10**9, 4 * 10**9), (10**11, 3 * 10**7), (7, 0), (10**9, 0)])
    codes, odds = bitmix.pair_codes(pairs[:, 0], pairs[:, 1]), bitmix.Lookups().odds[2 << 16 :]
    for (z, o), c in zip(pairs.tolist(), codes.tolist()):
        if z and o:
            assert odds[c] == pytest.approx(math.log(o / z), abs=0.07)
    assert codes[4] == 7 * 256 and odds[codes[5]] < -20


def test_classes_come_from_all_texts_and_a_rare_language_gets_its_own(spark):
    rng = random.Random(3)
    common = [[f"{x}{i}" for i in range(60)] for x in "ab"]
    rare = [f"r{i}" for i in range(30)]
    n = 4000
    texts = [" ".join(rng.choices(rare if i % 40 == 7 else common[i % 2], k=60)) for i in range(n)]
    counts = Counter(w.encode() for t in texts for w in t.split()).most_common()
    found = textclass.find_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [w for w, _ in counts], np.array([c for _, c in counts], float))
    kinds = [int(found.of([t])[0]) for t in texts]
    groups = [{k for i, k in enumerate(kinds) if (2 if i % 40 == 7 else i % 2) == g} for g in range(3)]
    assert groups[0].isdisjoint(groups[1] | groups[2]) and groups[1].isdisjoint(groups[2])


def test_words_and_groups_against_plain_ones():
    texts = ["", None, "  a\tB\n c\x1cd é\u00a0x ", "\x0b\x0c", "One one ONE", " lead", "trail \r\n"]
    read = textclass.Words(pa.array(texts))
    plain = [(t or "").encode().translate(LOWER).split() + [b"\n"] for t in texts]
    flat = [w for ws in plain for w in ws]
    assert read.sizes.tolist() == [*map(len, plain)] and read.spelled(np.arange(len(flat))) == flat
    among = sorted({w for w in flat if w != b"\n"})[1:]
    number = {w: i for i, w in enumerate(among)} | {b"\n": 77}
    assert read.numbers(pa.array(among, pa.binary()).cast(pa.string()), 77).tolist() == [number.get(w, -1) for w in flat]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["x" * (k % 50) for k in range(n)], pa.string())], names=["i", "text"]) for n in (3, 0, 200, 1)]
    old, textclass.GROUP = textclass.GROUP, 100
    try:
        found = list(textclass.groups(batches, 1))
    finally:
        textclass.GROUP = old
    assert [x for b in found for x in b.column(1).to_pylist()] == [x for b in batches for x in b.column(1).to_pylist()] and len(found) > 20


def test_packed_arrays_come_back():
    rng = np.random.default_rng(4)
    kept = [rng.integers(0, 2**32, 9).astype(np.uint32), rng.integers(-(2**60), 2**60, 5), rng.random(4) > 0.5, rng.normal(size=3).astype(np.float32), np.zeros(0, np.uint8)]
    back = contextmix.unpacked(contextmix.packed(*kept), *((x.dtype, len(x)) for x in kept))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(kept, back))


def test_different_words_are_looked_up_once_for_several_texts():
    texts = ["", None, "b a\tB\n c é x a", "One one ONE", "\x0b"]
    plain = [w for t in texts for w in (t or "").encode().translate(LOWER).split() + [b"\n"]]
    words, at = textclass.Words(pa.array(texts)).distinct()
    assert [words[i] for i in at] == plain and len(words) == len(set(plain)) and words[-1] == b"\n"
    words, at = textclass.Words(pa.array(["", None])).distinct()
    assert words == [b"\n"] and at.tolist() == [0, 0]

    class Once(dict):
        asked = 0

        def get(self, *x):
            Once.asked += 1
            return super().get(*x)

    kinds = textclass.Classes([b"one", b"a"], np.array([[0.0, -9.0], [-9.0, 0.0]]))
    lexicon = contextmix.Lexicon([b"one", b"a", b"\n"], np.array([3, 2, 5]), kinds, {})
    lexicon.place = Once(lexicon.place)
    _, words, at, number, cls = lexicon.read(pa.array(texts))
    assert Once.asked == len(set(plain)) and number[at].tolist() == [{b"one": 0, b"a": 1, b"\n": 2}.get(w, -1) for w in plain] and cls.tolist()[2:4] == [1, 0]


def test_symbols_reach_as_far_as_others_go_and_are_counted_so_far():
    rng = np.random.default_rng(5)
    tree = bitmix.Tree.huffman(rng.integers(1, 200, 40))
    n = 600
    symbols, train, kinds = rng.integers(0, 40, n), rng.random(n) < 0.7, rng.integers(0, 90, n)
    kinds[:3] = 1000, 1001, 1002  # alone
    context = (kinds.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    path = [format(int(tree.code[s]), "b").zfill(tree.depth[s]) for s in symbols]
    met = lambda i, d: any(j != i and kinds[j] == kinds[i] and path[j].startswith(path[i][:d]) for j in range(n))
    reach = bitmix.reaches(context, symbols, tree)
    assert reach.tolist() == [sum(met(i, d) for d in range(len(path[i]))) for i in range(n)] and not reach[:3].any()
    whole, short = bitmix.Hashed(context, 20), bitmix.Hashed(context, 20, reach)
    bitmix.count([whole], symbols, train, tree)
    bitmix.count([short], symbols, train, tree)
    assert 0 < np.count_nonzero(short.codes) < 0.9 * np.count_nonzero(whole.codes)
    node = bitmix.Fixed(bitmix.pair_codes(*tree.node_counts(np.bincount(symbols[train], minlength=40)).T))
    a, b = (bitmix.coded(symbols, train, tree, [node, p], bitmix.Mixer([0.3, 0.4]), bitmix.Lookups()) for p in (whole, short))
    assert a == pytest.approx(b, abs=1e-6)


def test_tokens_are_sent_from_what_reading_found():
    texts, ids, held = ["b a b a", None, "a new word b", "new b"], [4, 5, 6, None], [False, False, True, False]
    kinds = textclass.Classes([b"a", b"b"], np.array([[0.0, -9.0], [-9.0, 0.0]]))

    class Shared:
        value = ([b"a", b"b", b"\n"], np.array([3, 4, 3]), kinds, {})

    batch = pa.RecordBatch.from_pydict({"row": pa.array([7, 8, 9, 12]), "doc_id": pa.array(ids, pa.int64()), "held_out": held, "text": pa.array(texts)})
    read = pa.Table.from_batches(contextmix.read_documents(Shared, "sent", 10, 3)([batch])).to_pylist()
    kept = [(r["n"], r["known"], r["tokens"]) for r in read if r["tokens"]]
    sent = list(contextmix.send_tokens(Shared, "sent", 1)([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*kept)], names=["n", "known", "tokens"])]))
    (part, first, n, many, data), = [tuple(r.values()) for b in sent for r in b.to_pylist()]
    u4 = (np.uint32, n)
    word, prev, before, guess, new, rows, cls, train = contextmix.unpacked(data, u4, u4, u4, u4, (np.uint8, (n + 7) // 8), (np.int64, many), (np.uint8, many), (np.bool_, many))
    number = {b"a": 0, b"b": 1, b"\n": 2} | {w: 5 + zlib.crc32(w) % (1 << 26) for w in (b"new", b"word")}
    plain = [[number[w] for w in (t or "").encode().split() + [b"\n"]] for t in texts]
    assert (part, first, n, many) == (0, 7, 14, 4) and word.tolist() == sum(plain, [])
    assert prev.tolist() == [x for ws in plain for x in [4, *ws[:-1]]] and before.tolist() == [x for ws in plain for x in [4, 4, *ws[:-2]][: len(ws)]]
    assert np.cumsum(rows).tolist() == [7, 8, 9, 12] and (~train).tolist() == held and np.flatnonzero(np.unpackbits(new)[:n]).tolist() == [0, 5, 6, 11]
    assert guess.tolist() == [0] * 4 + [number[b"b"] + 1] + [0] * 9  # after the second "b a"


def test_words_of_training_and_other_texts_are_counted_in_one_row_each():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b a", "b c", None, ""]), "train": [True, False, True, False]})
    rows = [tuple(r.values()) for b in contextmix.count_words([batch]) for r in b.to_pylist()]
    assert sorted(rows) == [(b"\n", 2, 4), (b"a", 2, 2), (b"b", 1, 2), (b"c", 0, 1)]

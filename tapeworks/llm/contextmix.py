"""Language-model scores by online logistic context mixing over running text.

A text is the sequence of its lower-cased words and one end token. It has a class, found from its common words; the class is
coded first, at the cost of its share of the training texts. Each word is then coded bit by bit along its path in a binary
prefix code of the ``COMMON`` most frequent training words that occur twice at least; other words are an escape, which is
followed by their spelling. For each bit, hashed-context predictors look up how often 0 and 1 followed at that node of the
code: at all, in texts of the class, after the word before, after the two words before. A fifth one guesses the word that
followed the same two words earlier in the text. Their log odds are mixed by gated weights and refined by adaptive maps
(``bitmix``), which learn as the text is read. The bits sum to the bits of the text.

What is learnt comes from all training documents, and what a training token is coded with leaves its own occurrence out.
Words are counted exactly. Tokens are sent to the task that keeps the contexts of the word before them, about
``PART`` tokens to a task: there the task counts the contexts of all its training tokens in tables of its own (along each token's path as far as
another token of the context goes, as nobody else asks for more), then codes its tokens in order of their texts with a mixer of its own. So tables grow with the corpus, and no table is broadcast but the code,
the counts of its nodes and those by class (32 classes of 2^19 words at most). A word that more than ``HOT`` tokens follow
is dealt out by the word before it, and two such words in a row by text also; each part counts for itself.

Words outside the code are spelled byte by byte along a Huffman code, each distinct one once, by the same mixing of the contexts of the last 2, 3
and 5 bytes and of the word so far. They are dealt to tasks by hash, ``SPELLED`` to a task, which learns from the
training words among them.

Defined results: null, empty and white-space texts are the end token alone; with no training document N and V are 0 and words
are spelled by even odds, and the base score uses its formula with c = N = V = 0; a null doc_id hashes as empty text; repeated rows
are scored each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.bitmix import Fixed, Hashed, Lookups, Mixer, Tree, coded, count, pair_codes, reaches
from tapeworks.llm.textclass import END, TELLING, Classes, Words, find_classes, groups
from tapeworks.llm.util import crc_mod, stored, table

FOLDS = 10
COMMON, LONG = 1 << 19, 256
#: Tokens, and distinct words outside the code, that meet in one task; tokens after one word beyond which they are dealt out.
PART, SPELLED = 1_000_000, 200_000
HOT = PART // 4
#: Tokens that a task holds before it passes them on.
HELD_TOKENS = 400_000
#: Words of the code that are counted by class in one piece.
PIECE = 1 << 15
#: Rows whose scores travel together.
ROWS = 1 << 12
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, the like bytes of their numbers together, compressed."""
    raw = []
    for a in arrays:
        wide = a.dtype.itemsize
        whole = a.view(f"u{wide}")
        raw += [whole if wide == 1 else (whole >> whole.dtype.type(8 * k)).astype(np.uint8) for k in range(wide)]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(raw))


def unpacked(data: bytes, *shapes: tuple) -> list[np.ndarray]:
    """What ``packed`` held, given each array's kind and length (-1: all there is)."""
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind, n in shapes:
        wide = np.dtype(kind).itemsize
        n = (len(raw) - at) // wide if n < 0 else n
        whole = np.zeros(n, f"u{wide}")
        for k in range(wide):
            whole |= raw[at : at + n].astype(whole.dtype) << whole.dtype.type(8 * k)
            at += n
        out.append(whole.view(kind))
    return out


def count_words(batches):
    """For mapInArrow over (text, train): word, how often training texts hold it (c), and how often all do (m)."""
    for batch in groups(batches, 0):
        train = batch.column(1).to_numpy(zero_copy_only=False)
        read = Words(batch.column(0))
        found = read.flat.dictionary_encode()
        words, at = pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), found.indices.to_numpy()
        c, m = (np.append(np.bincount(x, minlength=len(words) - 1), n) for x, n in ((at[np.repeat(train, read.sizes - 1)], train.sum()), (at, len(train))))
        yield batch_of(word=words, c=pa.array(c), m=pa.array(m))


class Lexicon:
    """The words of the code, by falling count, their classes' tellers, and who is hot. Word n is any other, n + 1 the start of a text."""

    def __init__(self, words: list[bytes], counts: np.ndarray, kinds: Classes, hot: dict):
        self.counts, self.kinds = counts, kinds
        self.n, self.place = len(words), {w: i for i, w in enumerate(words)}  # kept for all groups of texts that a process reads
        self.telling = np.full(self.n + 1, -1, np.int64)
        self.telling[: len(kinds.words)] = np.arange(len(kinds.words))  # the first words of the code tell
        found = sorted((self.n + 1 if w is None else self.place.get(w, self.name(w or b"")), -(-m // HOT)) for w, m in hot.items())
        self.hot, self.parts = (np.array([x[k] for x in found], np.uint32) for k in (0, 1))

    def name(self, word: bytes) -> int:
        """The number of a word outside the code, from its hash."""
        return self.n + 2 + zlib.crc32(word) % (1 << 26)

    def read(self, texts: pa.Array):
        """For several texts: their words, the different ones, each token's place among these, the numbers of these (-1: not in the code), and the texts' classes."""
        read = Words(texts)
        words, at = read.distinct()
        number = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        return read, words, at, number, self.kinds.best(self.telling[number][at], read.sizes)

    def parts_of(self, words: np.ndarray) -> np.ndarray:
        """1, or the number of parts that the tokens after a hot word are dealt to."""
        if not len(self.hot):
            return np.ones(len(words), np.uint64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, self.parts[at], 1).astype(np.uint64)


_LEXICONS: dict = {}


def lexicon_of(shared, name: str) -> Lexicon:
    """One for each process."""
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(*shared.value)
    return _LEXICONS[name]


def read_documents(shared, name: str, n: int, v: int):
    """For mapInArrow over (row, doc_id, held_out, text): a row for each text, one for each other word in it, one for the tokens of several texts, and counts of the code's words by class."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "cls": pa.int32(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "bytes": pa.int64(), "word": pa.binary(), "piece": pa.int32(), "counts": pa.binary(), "tokens": pa.binary()}

    def pack(many, **columns):
        return batch_of(**{k: (columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k], t)) if k in columns else pa.nulls(many, t) for k, t in kinds.items()})

    def run(batches):
        lexicon = lexicon_of(shared, name)
        base_of = np.append(np.log10((lexicon.counts + 0.1) / (n + 0.1 * (v + 1))), 0.0)
        width = lexicon.n + 1
        sums = np.zeros(len(lexicon.kinds.odds) * width, np.int32)
        for batch in groups(batches, 3):
            read, words, at, number, cls = lexicon.read(batch.column(3))
            found = number[at]
            sizes, starts, held = read.sizes, read.starts, batch.column(2).to_numpy(zero_copy_only=False)
            np.add.at(sums, (np.repeat(cls * width, sizes) + np.where(found < 0, lexicon.n, found))[np.repeat(~held, sizes)], np.int32(1))
            known, base = np.add.reduceat(found >= 0, starts, dtype=np.int64), np.add.reduceat(base_of[found], starts)
            size = pc.fill_null(pc.binary_length(batch.column(3)), 0).cast(pa.int64())
            yield pack(len(batch), row=batch.column(0), doc_id=batch.column(1), held_out=batch.column(2), cls=cls, n=sizes, known=known, base=base, bytes=size)
            away = np.flatnonzero(found < 0)
            if len(away):
                pairs, many = np.unique((np.searchsorted(starts, away, side="right") - 1) * len(words) + at[away], return_counts=True)
                rows, which = np.divmod(pairs, len(words))
                yield pack(len(many), row=batch.column(0).take(pa.array(rows)), cls=cls[rows], word=pa.array(words, pa.binary()).take(pa.array(which)), n=many)
            outside = np.flatnonzero(number < 0)
            number[outside] = [lexicon.name(words[i]) for i in outside.tolist()]
            tokens = packed(number.astype(np.uint32)[at], sizes, batch.column(0).to_numpy(), cls.astype(np.uint8), held)
            yield pack(1, n=[int(sizes.sum())], known=[len(batch)], tokens=[tokens])
        for cls in range(len(lexicon.kinds.odds)):
            for at in range(0, width, PIECE):
                counts = sums[cls * width + at : cls * width + min(at + PIECE, width)]
                if counts.any():
                    yield pack(1, cls=[cls], piece=[at // PIECE], counts=[packed(counts)])

    return run


def merged_counts(rows: pa.Table) -> pa.Table:
    """The counts of one piece of the code's words in one class, summed over tasks."""
    total = 0
    for part in rows.column("counts").to_pylist():
        total = total + unpacked(part, (np.int32, -1))[0].astype(np.int64)
    return pa.table({"cls": rows.column("cls").slice(0, 1), "piece": rows.column("piece").slice(0, 1), "counts": pa.array([packed(total)], pa.binary())})


def send_tokens(shared, name: str, parts: int):
    """For mapInArrow over (n, known, tokens) of ``read_documents``: part, first row, numbers of tokens and texts, and the tokens with the words before them."""

    def flush(held):
        word, prev, before, guess, at, part, doc = (np.concatenate(x) for x in zip(*held[0]))
        rows, cls, train = (np.concatenate(x) for x in zip(*held[1]))
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
        word, prev, before, guess, doc, part = (x[order] for x in (word, prev, before, guess, doc, part))
        ends = np.flatnonzero(np.diff(part, append=-1)) + 1
        out = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            new = np.diff(doc[a:b], prepend=-1) > 0
            mine = doc[a:b][new]
            data = packed(word[a:b], prev[a:b], before[a:b], guess[a:b], np.packbits(new), np.diff(rows[mine], prepend=0), cls[mine], train[mine])
            out.append((int(part[a]), int(rows[mine[0]]), b - a, len(mine), data))
        columns = list(zip(*out))
        yield batch_of(part=pa.array(columns[0], pa.int32()), first=pa.array(columns[1], pa.int64()), tokens=pa.array(columns[2], pa.int32()), texts=pa.array(columns[3], pa.int32()), data=pa.array(columns[4], pa.binary()))

    def run(batches):
        lexicon, held, n, many = lexicon_of(shared, name), ([], []), 0, 0
        start = np.uint32(lexicon.n + 1)
        for many_tokens, texts, tokens in (x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in range(3)))):
            word, sizes, rows, cls, held_out = unpacked(tokens, (np.uint32, many_tokens), (np.int64, texts), (np.int64, texts), (np.uint8, texts), (np.bool_, texts))
            starts = np.cumsum(sizes) - sizes
            prev, before = np.full_like(word, start), np.full_like(word, start)
            prev[1:], before[2:] = word[:-1], word[:-2]
            prev[starts] = before[starts] = start
            before[(starts + 1)[sizes > 1]] = start
            doc = np.repeat(np.arange(texts), sizes)
            wide, last = prev.astype(np.uint64) * C1, before.astype(np.uint64) * C2
            same = (wide + last) * C3 + doc.astype(np.uint64) * C2
            low = np.uint64(len(word).bit_length())  # places go below the upper bits of the sums: one sort, and equal ones stay in order
            same = np.sort((same * C1 >> low << low) | np.arange(len(word), dtype=np.uint64))
            order = (same & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
            again = np.flatnonzero(same[1:] >> low == same[:-1] >> low)
            guess = np.zeros_like(word)
            guess[order[again + 1]] = word[order[again]] + np.uint32(1)
            at = np.arange(len(word)) - np.repeat(starts, sizes)
            parts_prev, parts_before = lexicon.parts_of(prev), lexicon.parts_of(before)
            spread = (rows[doc].astype(np.uint64) * C3 >> np.uint64(20)) + (at >> 16).astype(np.uint64)
            key = wide + np.where(parts_prev > 1, last + np.where(parts_before > 1, spread % np.minimum(parts_prev, parts_before) * C3, np.uint64(0)), np.uint64(0))
            key = (key ^ key >> np.uint64(31)) * C2 >> np.uint64(32)
            held[0].append((word, prev, before, guess, at, (key % np.uint64(parts)).astype(np.int64), doc + many))
            held[1].append((rows, cls, ~held_out))
            n, many = n + len(word), many + texts
            if n > HELD_TOKENS:
                yield from flush(held)
                held, n, many = ([], []), 0, 0
        if n:
            yield from flush(held)

    return run


def table_bits(n: int) -> int:
    return max(10, (2 * n).bit_length())


def by_rows(rows: np.ndarray, values: np.ndarray):
    """Sums of values by row, as blobs of ROWS rows."""
    order = np.argsort(rows, kind="stable")
    rows, first = np.unique(rows[order], return_index=True)
    values = np.add.reduceat(values[order], first).astype(np.float32)
    group = rows // ROWS
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(rows)]
    return [int(group[a]) for a in edges[:-1]], [packed((rows[a:b] % ROWS).astype(np.uint16), values[a:b]) for a, b in zip(edges, edges[1:])], np.diff(edges).tolist()


def code_tokens(shared):
    """For applyInArrow over the rows of a part: log10 probabilities of its tokens in the code, by text."""

    def run(rows: pa.Table) -> pa.Table:
        _LEXICONS.clear()
        pa.default_memory_pool().release_unused()
        tree, node_codes, class_codes, n = shared.value
        tree, fields = Tree(*tree), []
        blobs = sorted(zip(*(rows.column(x).to_pylist() for x in ("first", "tokens", "texts", "data"))))
        for _, many, texts, data in blobs:
            u4 = (np.uint32, many)
            word, prev, before, guess, new, doc, cls, train = unpacked(data, u4, u4, u4, u4, (np.uint8, (many + 7) // 8), (np.int64, texts), (np.uint8, texts), (np.bool_, texts))
            fields.append((word, prev, before, guess, np.cumsum(np.unpackbits(new, count=many), dtype=np.int64) - 1, np.cumsum(doc), cls, train))
        place = np.repeat(np.cumsum([0, *(len(f[5]) for f in fields[:-1])]), [len(f[0]) for f in fields])
        word, prev, before, guess, at, row, cls, train = (np.concatenate(x) for x in zip(*fields))
        at += place
        symbol = np.minimum(word, n).astype(np.int64)
        hope = np.where(guess > 0, np.minimum(guess.astype(np.int64) - 1, n), -1)
        one = prev.astype(np.uint64) * C1
        two = (one ^ before.astype(np.uint64)) * C2 + C3
        learnt, bits = train[at], table_bits(len(word))
        del word, prev, before, guess, fields, place
        contexts = [Hashed(x, bits, reaches(x, symbol, tree)) for x in (one, two)]
        count(contexts, symbol, learnt, tree)
        predictors = [Fixed(node_codes), Fixed(class_codes.ravel(), cls[at], class_codes.shape[1]), *contexts]
        found = coded(symbol, learnt, tree, predictors, Mixer([0.2, 0.4, 0.2, 0.4]), Lookups(), hope)
        group, data, many = by_rows(row[at], found)
        return pa.table({"grp": pa.array(group, pa.int64()), "n": pa.array(many, pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def text_sums(rows: pa.Table) -> pa.Table:
    """For applyInArrow over the blobs of ROWS rows: each row's sum."""
    total, seen = np.zeros(ROWS), np.zeros(ROWS, bool)
    for many, data in sorted(zip(rows.column("n").to_pylist(), rows.column("data").to_pylist())):
        low, values = unpacked(data, (np.uint16, many), (np.float32, many))
        total[low] += values
        seen[low] = True
    here = np.flatnonzero(seen)
    return pa.table({"row": pa.array(here + rows.column("grp")[0].as_py() * ROWS), "coded": pa.array(total[here])})


def spell(n: int, v: int):
    """For applyInArrow over (part, word, c): word, c, base and model, the log10 probabilities of one occurrence."""
    shape = {"word": pa.binary(), "c": pa.int64(), "base": pa.float64(), "model": pa.float64()}

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word").take(np.random.default_rng(0).permutation(len(rows))).combine_chunks()
        words, counts = rows.column("word").to_numpy().tolist(), rows.column("c").to_numpy().astype(np.float64)
        closed = [w if w == END else w + b" " for w in words]
        raw, sizes = np.frombuffer(b"".join(closed), np.uint8), np.fromiter(map(len, closed), np.int64, len(closed))
        starts = np.cumsum(sizes) - sizes
        at, wide = np.arange(len(raw)) - np.repeat(starts, sizes), raw.astype(np.uint64) + np.uint64(1)

        def last(k: int) -> np.ndarray:
            """The last k bytes of the word, as a number."""
            out = np.full(len(raw), k, np.uint64) * C3
            for j in range(1, k + 1):
                shifted = np.zeros_like(wide)
                shifted[j:] = wide[:-j]
                shifted[at < j] = 0
                out = (out + shifted) * C1
            return out

        powers = np.ones(int(sizes.max()), np.uint64)
        powers[1:] = C2
        term = wide * np.multiply.accumulate(powers)[at]
        whole = np.cumsum(term, dtype=np.uint64) - term
        whole = (whole - np.repeat(whole[starts], sizes)) * C1
        train, symbol = np.repeat(counts > 0, sizes), raw.astype(np.int64)
        tree = Tree.huffman(np.bincount(raw[train], minlength=256) + 1)
        contexts = [Hashed(c, table_bits(len(raw))) for c in (last(2), last(3), last(5), whole)]
        count(contexts, symbol, train, tree)
        found = coded(symbol, train, tree, contexts, Mixer([0.2, 0.3, 0.3, 0.3]), Lookups())
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        return pa.table({"word": pa.array(words, pa.binary()), "c": pa.array(counts.astype(np.int64)), "base": pa.array(base), "model": pa.array(np.add.reduceat(found, starts))}, schema=pa.schema(list(shape.items())))

    return run


def scores(docs: DataFrame, reread: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    docs is read several times and its rows must come in the same order each time, as those of a table of files do; say
    ``reread`` for such a table. Anything else is written to the shared folder first.
    """
    docs = docs.select("doc_id", "text")
    docs = docs if reread else stored(docs, "texts")
    context = docs.sparkSession.sparkContext
    held_out = crc_mod(F.col("doc_id"), FOLDS) == 0
    counted = docs.select("text", (~held_out).alias("train")).mapInArrow(count_words, "word binary, c long, m long")
    vocabulary = stored(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m")), "words")
    n, v, every, texts = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("m"))), F.lit(0))).first()
    eligible = (F.col("c") >= 2) & (F.length("word") <= LONG)
    common = vocabulary.where(eligible).select("word", "c").orderBy(F.desc("c"), "word").limit(COMMON).toArrow()  # COMMON rows of LONG bytes at most
    words, counts = common.column("word").to_pylist(), common.column("c").to_numpy()
    kinds = find_classes(docs.where(~held_out), words[:TELLING], counts[:TELLING].astype(np.float64))
    hot = {r["word"]: r["m"] for r in vocabulary.where(F.col("m") > HOT).select("word", "m").toArrow().to_pylist()}  # one for each HOT tokens at most
    if texts > HOT:
        hot[None] = texts
    lexicon, name = context.broadcast((words, counts, kinds, hot)), uuid.uuid4().hex

    placed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out.alias("held_out"), "text")
    read = placed.mapInArrow(read_documents(lexicon, name, n, v), "row long, doc_id long, held_out boolean, cls int, n long, known long, base double, bytes long, word binary, piece int, counts binary, tokens binary")
    read = stored(read, "texts-read")
    shares = {r["cls"]: r["n"] for r in read.where("row is not null and word is null and not held_out").groupBy("cls").agg(F.count("*").alias("n")).collect()}
    many = len(kinds.odds)
    code_of = [math.log10((shares.get(k, 0) + 0.5) / (sum(shares.values()) + 0.5 * many)) for k in range(many)]

    by_class = np.zeros((many, len(words) + 1), np.int64)
    for r in read.where("piece is not null").groupBy("cls", "piece").applyInArrow(merged_counts, "cls int, piece int, counts binary").collect():  # a number for each class and word of the code
        part = unpacked(r["counts"], (np.int64, -1))[0]
        by_class[r["cls"], r["piece"] * PIECE : r["piece"] * PIECE + len(part)] = part
    whole = by_class.sum(0)
    tree = Tree.huffman(whole)
    nodes = lambda c: (lambda x: pair_codes(x[:, 0], x[:, 1]))(tree.node_counts(c))
    model = context.broadcast(((tree.child, tree.code, tree.depth), nodes(whole), np.stack([nodes(c) for c in by_class]), len(words)))
    del by_class

    parts = max(1, -(-every // PART))
    sent = read.where("tokens is not null").select("n", "known", "tokens").mapInArrow(send_tokens(lexicon, name, parts), "part int, first long, tokens int, texts int, data binary")
    coded_parts = sent.repartition(parts, "part").groupBy("part").applyInArrow(code_tokens(model), "grp long, n int, data binary")
    by_text = coded_parts.groupBy("grp").applyInArrow(text_sums, "row long, coded double")

    other = vocabulary
    if words:
        within = (F.col("c") > int(counts[-1])) | ((F.col("c") == int(counts[-1])) & (F.col("word") <= F.lit(words[-1])))
        other = vocabulary.where(~(eligible & within))
    size = other.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    dealt = other.select(F.pmod(F.xxhash64("word"), F.lit(max(1, -(-size // (11 * SPELLED))))).cast("int").alias("part"), "word", "c")
    spelled = dealt.groupBy("part").applyInArrow(spell(n, v), "word binary, c long, base double, model double")
    rare = read.where("word is not null").select("row", "word", "n").join(spelled, "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("r_known"), F.sum(F.col("n") * F.col("base")).alias("r_base"), F.sum(F.col("n") * F.col("model")).alias("r_model"))

    rows = read.where("row is not null and word is null").drop("word", "piece", "counts", "tokens").join(by_text, "row", "left").join(rare, "row", "left")
    add = lambda *xs: sum((F.coalesce(F.col(x), F.lit(0)) for x in xs[1:]), F.col(xs[0]))
    total = add("coded", "r_model") + F.element_at(F.array(*map(F.lit, code_of)), F.col("cls") + 1)
    done = rows.select("doc_id", "held_out", F.col("n").alias("n_tokens"), add("known", "r_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), add("base", "r_base").alias("base_score"), total.alias("score"), "bytes")
    return done.withColumn("bits_per_byte", F.when(F.col("bytes") > 0, -F.col("score") / math.log10(2) / F.col("bytes"))).drop("bytes")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), reread=True)


QUERIES = {"op10_context_mixing": op10_context_mixing}
ORACLE_SQL: dict = {}

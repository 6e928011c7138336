"""Token ids in sorted-string-table shards.

A shard holds documents in ascending doc_id order:

* data blocks of about ``BLOCK`` bytes; an entry is three varints (bytes of the key shared with the entry before it in the
  block, further bytes of the key, bytes of the value), those further key bytes, and the value: ids as little-endian
  unsigned integers of the width named in the footer;
* the sparse index, for each block: its first key (9 bytes), offset, length, and ids of the shard before it (3 x u64);
* a Bloom filter of 10 bits a document and 7 probes;
* a footer of 64 bytes: offsets and lengths of index and filter, documents, ids, width, magic.

A key is a byte 0 for null or 1, then doc_id + 2^63 in big-endian order, so that keys sort as doc_ids do. A lookup asks the
filter, searches the index by bisection and reads one block. A task names its shard anew at every attempt and Spark's
committed manifest says which shards count, so an attempt that is lost or repeated leaves no wrong shard.

Defined results: null and empty texts hold the end id alone; a null doc_id comes first; rows that share a doc_id are kept,
ordered by text; an empty table gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.util import ASCII_LOWER, new_path, stored, table
from tapeworks.sources.files import opened

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLOCK, PROBES, BITS_A_KEY, MAGIC = 1 << 16, 7, 10, b"TWSST001"
FOOTER, INDEX = struct.Struct("<QQQQQQQ8s"), struct.Struct("<9sQQQ")
END_ID = 1
#: Words that a worker keeps encoded; when full, the memory starts anew.
REMEMBERED = 1_600_000
#: Texts that are encoded together.
GROUP = 256
#: Ids that a reader holds before it passes them on.
HELD_IDS = 1 << 18
#: So many shards at most are dealt by bounds that the plan holds.
FEW_SHARDS = 500


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        at, n, shift = at + 1, n | (byte & 127) << shift, shift + 7
        if byte < 128:
            return n, at


def probes(key: bytes, bits: int):
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard from entries in key order; one block is held at a time."""

    def __init__(self, folder: str, width: int):
        self.fs, self.root = opened(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.sst"
        self.out, self.width = self.fs.open_output_stream(f"{self.root}/{self.name}.tmp"), width
        self.block, self.index, self.keys = bytearray(), [], []
        self.at = self.tokens = self.before = 0
        self.first = self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.block and len(self.block) + len(value) > BLOCK:
            self.flush()
        if not self.block:
            self.first, self.last, self.before = key, b"", self.tokens
        shared = len(os.path.commonprefix([self.last, key]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.tokens += len(value) // self.width
        self.keys.append(key)
        self.last = key

    def flush(self) -> None:
        if self.block:
            self.index.append(INDEX.pack(self.first, self.at, len(self.block), self.before))
            self.write(bytes(self.block))
            self.block.clear()

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        self.flush()
        index_at = self.at
        self.write(b"".join(self.index))
        bloom_at, bits = self.at, max(64, BITS_A_KEY * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for i in probes(key, bits):
                bloom[i >> 3] |= 1 << (i & 7)
        self.write(struct.pack("<Q", bits) + bloom.tobytes())
        self.write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.keys), self.tokens, self.width, MAGIC))
        self.out.close()
        self.fs.move(f"{self.root}/{self.name}.tmp", f"{self.root}/{self.name}")


class Reader:
    """Reads one shard: whole, in order, or by key."""

    def __init__(self, folder: str, name: str):
        fs, root = opened(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        index_at, index_len, bloom_at, bloom_len, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard")
        self.index = list(INDEX.iter_unpack(self.file.read_at(index_len, index_at)))
        self.firsts = [x[0] for x in self.index]
        bloom = self.file.read_at(bloom_len, bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def block(self, k: int):
        """Entries (key, ids before it in the shard, value) of block k."""
        _, offset, length, before = self.index[k]
        raw, at, key = self.file.read_at(length, offset), 0, b""
        while at < length:
            shared, at = read_varint(raw, at)
            more, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            yield key, before, raw[at + more : at + more + n]
            at += more + n
            before += n // self.width

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of the first document with this doc_id, or None."""
        key = key_of(doc_id)
        if not all(self.bloom[i >> 3] >> (i & 7) & 1 for i in probes(key, self.bits)):
            return None
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            for found, _, value in self.block(k):
                if found == key:
                    return self.ids(value)
        return None


#: A word of Latin letters and the plain marks after it: certainly two pieces to the pre-tokeniser, or one.
STEM = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!*%&$#|]*)\Z")


class Encoder:
    """Encodes texts word by word with one tokenizer file, each distinct word once.

    The tokenizer drops white space, never looks across it, and lower-cases; so words can be encoded apart and A-Z lower-cased
    first. Texts that may name a special token go through the library whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.width = 2 if max(len(vocabulary), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind)

    def learn(self, words: set[bytes]) -> None:
        """Encodes new words. Those of letters alone, and the letters before marks, share calls: a closing token ends each."""
        known = self.known
        if len(known) + len(words) > REMEMBERED:
            known.clear()
        marked, plain, rest = [], set(), set()
        for w in words:
            match = STEM.match(w)
            if not match:
                rest.add(w)
            elif match[2]:
                marked.append((w, *match.groups()))
            else:
                plain.add(w)
        plain.update(stem for _, stem, _ in marked if stem not in known)
        rest.update(tail for _, _, tail in marked if tail not in known)
        letters = list(plain)
        for i in range(0, len(letters), 2000):
            group = letters[i : i + 2000]
            ids = self.ids(b" ".join(group))
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * self.width).tolist()
            if len(ends) != len(group):
                raise ValueError("the tokenizer doesn't close each word with one token")
            raw, begin = ids.tobytes(), 0
            for w, end in zip(group, ends):
                known[w], begin = raw[begin:end], end
        for w in rest:
            known[w] = self.ids(w).tobytes()
        for w, stem, tail in marked:
            known[w] = known[stem] + known[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian integers of the width."""
        out, waiting, new, get = [], [], set(), self.known.get
        for text in texts:
            if b"<|" in text:
                out.append([self.ids(text).tobytes()])
                continue
            words = text.translate(ASCII_LOWER).split()
            values = list(map(get, words))
            if None in values:
                at = [i for i, v in enumerate(values) if v is None]
                waiting.append((values, words, at))
                new.update([words[i] for i in at])
            out.append(values)
        if new:
            self.learn(new)
        for values, words, at in waiting:
            for i in at:
                values[i] = self.known[words[i]]
        return list(map(b"".join, out))


#: Encoders of this process, which may run many tasks.
_ENCODERS: dict = {}


def write_shards(path: str, folder: str, end_id: int):
    """For mapInArrow over rows (doc_id, text) in order: encodes them and writes a shard for the partition."""

    def run(batches):
        encoder = _ENCODERS[path, end_id] = _ENCODERS.get((path, end_id)) or Encoder(path, end_id)
        end, shard = np.array([end_id], encoder.kind).tobytes(), None
        for batch in batches:
            shard = shard or (Writer(folder, encoder.width) if len(batch) else None)
            for i in range(0, len(batch), GROUP):
                part = batch.slice(i, GROUP)
                values = encoder.encode([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                for doc_id, value in zip(part.column(0).to_pylist(), values):
                    shard.add(key_of(doc_id), value + end)
        if shard:
            first = id_of(shard.keys[0])
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard.name, pa.string()), (first, pa.int64()), (len(shard.keys), pa.int64()), (shard.tokens, pa.int64()))], names=["name", "first_id", "n_docs", "n_tokens"])

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes docs as shards; gives the manifest: name, first_id, n_docs, n_tokens, base (ids of all shards before)."""
    rows = docs.select("doc_id", "text")
    n = shards or max(1, rows.rdd.getNumPartitions())
    if n <= FEW_SHARDS:  # bounds from the ids alone; a range partitioning would read the texts twice
        bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
        shard = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: F.col("doc_id") > b)) if n > 1 and bounds else F.lit(0)
        dealt = rows.repartitionById(n, F.when(F.col("doc_id").isNull(), 0).otherwise(shard).cast("int"))
    else:
        dealt = rows.repartitionByRange(n, "doc_id")
    ordered = dealt.sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInArrow(write_shards(path or default_path(), folder, end_id), "name string, first_id long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(folder: str):
    def run(batches):
        _ENCODERS.clear()  # this process may have written shards before; its words aren't needed any more
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list = []
                size, shard = 0, Reader(folder, name)
                for key, before, value in shard:
                    ids = shard.ids(value)
                    out.append((id_of(key), base + before, len(ids), ids.tobytes()))
                    size += len(ids)
                    if size > HELD_IDS:
                        yield pack(out)
                        out, size = [], 0
                if out:
                    yield pack(out)

    def pack(rows):
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document of the shards: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    shards = manifest.select("name", "base")
    return shards.repartition(max(1, manifest.count()), "name").mapInArrow(read_shards(folder), "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, folder: str, doc_id: int | None) -> np.ndarray | None:
    """Ids of one document: the manifest names the one shard whose range can hold it."""
    fits = manifest.where(F.col("first_id").isNull()) if doc_id is None else manifest.where((F.col("first_id") <= doc_id) | F.col("first_id").isNull())
    row = fits.orderBy(F.col("first_id").desc_nulls_last()).first()
    return Reader(folder, row["name"]).find(doc_id) if row else None


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "sstable")
    found = read(write(table(spark, sf_dir, "documents"), folder), folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_sstable": op6_sstable}
ORACLE_SQL: dict = {}

"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of bytes that no token of the vocabulary holds side by side can never be inside a token: a cut between the two is
certain. Texts are cut at those pairs where the pre-tokeniser's split is certain as well, the fragments are encoded
independently, each distinct one once, and their ids are concatenated. ``cuts`` tells which pairs qualify and why.

Defined results: null and empty texts give no ids and decode to the empty text; special tokens written in a text are
those tokens, as the library has it; texts of any length are encoded whole; repeated rows stay; an empty table gives an
empty result; other columns are ignored. Bytes that are no UTF-8 are replaced by U+FFFD.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.util import table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fragments that a worker keeps encoded; when full, the memory starts anew. Results don't depend on it.
REMEMBERED = 800_000
#: Texts that are encoded together.
GROUP = 64
SPACED = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_pairs(tokens) -> np.ndarray:
    """For a * 256 + b: whether no token holds byte a directly before byte b."""
    forced = np.ones(65536, bool)
    for token in tokens:
        if len(token) > 1:
            raw = np.frombuffer(token, np.uint8).astype(np.uint16)
            forced[raw[:-1] * 256 + raw[1:]] = False
    return forced


def cuts(tokens) -> np.ndarray:
    """The forced pairs at which the pre-tokeniser is sure to go on as if the text began there.

    It looks ahead only from white space and never behind. So the left byte must not be white space (or a control, or the
    end of a character that may be white space); the right byte must begin a character; and an apostrophe after a mark
    stays with it, for at the start of a text it could begin a contraction. The left byte may end a two-byte character
    that begins with 0xC3, as none of those is white space: ``split`` sees to that.
    """
    forced = forced_pairs(tokens).reshape(256, 256)
    left = np.zeros(256, bool)
    left[0x21:0x7F] = left[0x80:0xC0] = True
    right = np.ones(256, bool)
    right[0x80:0xC0] = False
    allowed = forced & left[:, None] & right[None, :]
    alnum = np.zeros(256, bool)
    alnum[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    allowed[~alnum, 0x27] = False
    return allowed.reshape(-1)


class Codec:
    """Encodes and decodes with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        plain = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        self.pieces = [b""] * (1 + max([*plain, *self.special.values()]))
        for i, raw in plain.items():
            self.pieces[i] = raw
        for raw, i in self.special.items():
            self.pieces[i] = raw
        self.cut = cuts(plain.values())
        self.opens = np.array([x.startswith(b" ") for x in self.pieces])
        self.known: dict[bytes, bytes] = {}

    def split(self, text: bytes) -> list[bytes]:
        raw = np.frombuffer(text, np.uint8)
        if len(raw) < 2:
            return [text] if text else []
        at = np.flatnonzero(self.cut[raw[:-1].astype(np.uint16) << 8 | raw[1:]])
        if not text.isascii():
            at = at[(raw[at] < 0x80) | (raw[at - 1] == 0xC3) & (at > 0)]
        ends = (at + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]

    def learn(self, new: set[bytes]) -> None:
        """Encodes fragments. Many of a space and letters take one call: a token that begins with the space begins each."""
        plain = sorted(x for x in new if SPACED.match(x))
        for i in range(0, len(plain), 2000):
            group = plain[i : i + 2000]
            ids = np.array(self.library.encode(b"".join(group).decode(), add_special_tokens=False).ids, np.int32)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) != len(group):
                raise ValueError("the tokenizer doesn't open each word with one token")
            raw, ends = ids.tobytes(), [*(begins[1:] * 4).tolist(), 4 * len(ids)]
            for x, a, b in zip(group, (begins * 4).tolist(), ends):
                self.known[x] = raw[a:b]
        rest = list(new.difference(plain))
        for x, found in zip(rest, self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False)):
            self.known[x] = np.array(found.ids, np.int32).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian 32-bit integers."""
        # texts that name a special token are rare: the library knows how these split a text
        split = [None if any(s in t for s in self.special) else self.split(t) for t in texts]
        wanted = set(chain.from_iterable(f for f in split if f))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, wanted
        if new:
            self.learn(new)
        known = self.known.__getitem__
        whole = lambda t: np.array(self.library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32).tobytes()
        return [whole(t) if f is None else b"".join(map(known, f)) for t, f in zip(texts, split)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


#: Codecs of this process, which may run many tasks.
_CODECS: dict = {}


def encode_decode(path: str):
    """For mapInArrow over (doc_id, text): doc_id, ids, and the text that the ids decode to."""

    def run(batches):
        codec = _CODECS[path] = _CODECS.get(path) or Codec(path)
        for batch in batches:
            for i in range(0, len(batch), GROUP):
                part = batch.slice(i, GROUP)
                raw = codec.encode([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                ids = np.frombuffer(b"".join(raw), np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
                decoded = [codec.decode(ids[a:b].tolist()).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded string."""
    return docs.select("doc_id", "text").mapInArrow(encode_decode(path or default_path()), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLE_SQL: dict = {}

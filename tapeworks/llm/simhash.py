"""SimHash near-dedup with covering locality-sensitive hashing.

Every text gets a 64-bit majority fingerprint over its 3-word shingles. Each bit position is given a nonzero vector of
GF(2)^(r+1); for each of the 2^(r+1)-1 nonzero vectors v a table keeps the bits whose vector has odd product with v. Any r
positions leave a v orthogonal to all of theirs, so two fingerprints at distance r or less agree in some table: no pair is
missed. Equal fingerprints are merged first, so copies are never expanded into pairs. A bucket yields a spanning set of
links, at most one fewer than its members. Buckets over ``BUCKET`` members are split among tasks by the midpoints of links:
fingerprints within 1 and within 2 flips of a midpoint are all linked, a midpoint has few such, and every link has one.

Defined results: null, empty and white-space texts have fingerprint zero and are linked like any other; one or two words
are one shingle; repeated rows and equal doc_ids are kept as rows; a null doc_id is never the smallest unless all of its
component are null; an empty table gives an empty result; other columns are ignored (``groups``) or kept (``dedup``).
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.util import ASCII_LOWER, stored, table

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Larger buckets are split among tasks; a smaller one is compared within one task.
BUCKET = 20_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text."""
    words = text.translate(ASCII_LOWER).split()  # bytes.split() parts at 0x20 and 0x09-0x0D, no others
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = sum(np.add.reduce(np.unpackbits(raw[i : i + CHUNK], axis=1), axis=0, dtype=np.int64) for i in range(0, len(raw), CHUNK))
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def fingerprints(batches):
    """For mapInArrow over (doc_id, text, h): doc_id, h and the fingerprint as a signed long."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "h", "fp"])


def vectors(radius: int = RADIUS) -> list[int]:
    """A nonzero vector of GF(2)^(radius+1) for each bit position, each used about equally often."""
    n = (1 << (radius + 1)) - 1
    return [i % n + 1 for i in range(BITS)]


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the covering tables."""
    at = vectors(radius)
    return [sum(1 << i for i in range(BITS) if (at[i] & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what is within the radius among distinct fingerprints, with no superfluous link."""
    links, left = [], members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                links += [(x, y) for y in found]
                queue += list(found)
                left = left[~near]
    return links


def link_buckets(batches):
    """For mapInArrow over arrays of fingerprints that share a bucket."""
    for batch in batches:
        links = [x for fps in batch.column(0) for x in spanning(np.asarray(fps.values.to_numpy(zero_copy_only=False)).view(np.uint64))]
        ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, i])) for i in (0, 1)], names=["a", "b"])


def link_by_midpoint(hot: DataFrame) -> DataFrame:
    """Links of crowded buckets (tab, key, fp), with the work of a bucket spread over its midpoints.

    Two members at distance 3 have a midpoint at distance 1 from one and 2 from the other. Members differ only in the
    bits their mask leaves out, so at most 1 + b + b(b-1)/2 of them, b about 30, share a midpoint.
    """
    flips = []
    for t, mask in enumerate(masks()):
        free = [i for i in range(BITS) if not mask >> i & 1]
        flips += [(t, 0, True)] + [(t, signed(1 << i), True) for i in free] + [(t, signed(1 << i | 1 << j), False) for i, j in combinations(free, 2)]
    spark = hot.sparkSession
    flips = F.broadcast(spark.createDataFrame(flips, "tab int, flip long, close boolean"))  # 15 tables, fixed size
    around = hot.join(flips, "tab").select("tab", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp", "close")
    met = around.groupBy("tab", "mid").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
    return met.where("a is not null and size(all) > 1").select("a", F.explode("all").alias("b"))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a > b, that join all distinct fingerprints (column fp) within the radius of each other."""
    tables = F.array(*(F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks())))
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("k.tab", "k.key", "fp")
    sizes = stored(keyed.groupBy("tab", "key").count().where("count > 1"), "buckets")
    crowded = sizes.where(F.col("count") > bucket).select("tab", "key")
    shared = keyed.join(sizes.where(F.col("count") <= bucket).select("tab", "key"), ["tab", "key"])
    found = shared.groupBy("tab", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(link_buckets, "a long, b long")
    if not crowded.isEmpty():
        found = found.unionByName(link_by_midpoint(keyed.join(crowded, ["tab", "key"])))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), a > b: a row (node, root) for each node but the roots.

    Alternating large-star and small-star steps, each on the whole edge table and kept in the shared folder; no component
    or neighbourhood is ever gathered in one place.
    """
    edges, before = stored(edges, "edges"), None
    while True:
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, fp, h (a hash of the text), root and component_id for each row of docs."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = stored(hashed.mapInArrow(fingerprints, "doc_id long, h long, fp long"), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps.select("fp")))
    found = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(found.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    return placed(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id, with all columns."""
    kept = placed(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.first("root").alias("__root"))
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")))
    place = F.row_number().over(Window.partitionBy("__root").orderBy("__h", "text"))
    return left.withColumn("__place", place).where("__place = 1").select(*docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash_dedup": op5_simhash_dedup}
ORACLE_SQL: dict = {}

"""Phrase collocations, counted exactly over whole texts.

Texts are cut into pieces, and identical pieces of a language become one with a multiplicity, so that what is copied is read
once. n-grams are counted in rounds of one word more: tasks add up those of some megabytes of pieces and send them, by
hash of language and phrase, to buckets, where duckdb sums them within ``MEMORY``, beyond which it spills to the task's own
scratch folder. A phrase that occurs ``least`` times has parts that do, so a round leaves out n-grams one of whose parts the
round before didn't keep; tasks know this from a bitmap of hashes of at most ``BITS`` bits, where a clash lets some n-grams
too many be counted, never one too few.

A candidate asks for the counts of its parts by requests, shuffled to where the parts' counts are. Parts that hold more than
one in ``HEAVY`` of all words, at most ``HEAVY`` of each length, answer on the map side instead, so that no bucket is flooded.

Defined results: a null text is empty, a null language ``und``; words are whatever stands between blanks, in any script; a
text of any length is read whole; repeated rows count as often as they occur; scores are exact whole numbers, with products
in 128 bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.util import LOWER, UPPER, ascii_lower, stored, table

#: Words of the longest phrase, occurrences of a candidate, hundredths of them inside a longer one that drop it, phrases a language.
LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Bytes of pieces whose n-grams are added up at once, rows sent on at once, memory of duckdb in a task.
CHUNK, SENT, MEMORY = 16 << 20, 1 << 16, "256MB"
#: Bits of a bitmap for each phrase in it, as a power of two, and of the largest bitmap (8 MB).
SPREAD, BITS = 4, 26
HEAVY = 4096
SALTS = 32


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by a space) and m, how often it occurs."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    cut = docs.select(lang.alias("lang"), F.explode(F.split(ascii_lower(F.col("text")), r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    tidy = F.regexp_replace(F.expr("trim(BOTH ' \t' FROM piece)"), r"[ \t]+", " ")
    return cut.select("lang", tidy.alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def hashes(langs: list[str], words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word in its language."""
    seeds = {lang: xxhash.xxh32_intdigest(lang) for lang in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in zip(langs, words)), np.uint64, len(words))


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def dense(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below ``size``, and the place of each key among them."""
    if size > 4 * len(keys) + (1 << 20):
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def added(some: pa.Table, n: int, bitmap: np.ndarray | None):
    """lang, phrase and count of the n-grams of some pieces, but for those with a part that the bitmap doesn't hold."""
    lists = pc.split_pattern(some.column("piece").combine_chunks(), " ")
    words = lists.flatten().dictionary_encode()
    lengths = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(some)), lengths)
    langs = some.column("lang").combine_chunks().dictionary_encode()
    lang, word = langs.indices.to_numpy()[owner].astype(np.int64), words.indices.to_numpy().astype(np.int64)
    keys, ids = dense(lang * len(words.dictionary) + word, len(langs.dictionary) * len(words.dictionary))
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.empty(0, np.int64)
    if n > 1:
        which = np.divmod(keys, len(words.dictionary))
        h = hashes(*(pc.take(d, pa.array(x)).to_pylist() for d, x in zip((langs.dictionary, words.dictionary), which)))[ids]
        part = h
        for j in range(1, n - 1):
            part = longer(part[: len(h) - j], h[j:])
        place = part >> np.uint64(64 - int(len(bitmap) * 64).bit_length() + 1)
        known = (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        at = at[known[at] & known[at + 1]]
    found, count = ids[at], len(keys)
    for j in range(1, n):
        kept, found = np.unique(found * len(keys) + ids[at + j], return_inverse=True)
        count = len(kept)
    weights = np.zeros(count, np.int64)
    np.add.at(weights, found, some.column("m").to_numpy()[owner[at]])
    first = np.zeros(count, np.int64)
    first[found] = at
    seen = np.flatnonzero(weights)
    first = first[seen]
    texts = [pc.take(words.dictionary, pa.array(word[first + j])) for j in range(n)]
    return pa.table({"lang": pc.take(langs.dictionary, pa.array(lang[first])), "phrase": pc.binary_join_element_wise(*texts, " ") if n > 1 else texts[0], "f": weights[seen]})


def grams(n: int, shared=None):
    """For mapInArrow over (lang, piece, m): lang, phrase and f of n-grams, added up by ``CHUNK``."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                yield from added(pa.Table.from_batches(held), n, shared and shared.value).to_batches(SENT)
                held, size = [], 0
        if held:
            yield from added(pa.Table.from_batches(held), n, shared and shared.value).to_batches(SENT)

    return run


def summed(least: int):
    """For mapInArrow over a bucket of (lang, phrase, f): sums that reach ``least``, out of core.

    What duckdb spills lies in the folder that Spark gives the task's executor for files of its own; it goes with the task, and
    a task that runs again elsewhere begins anew.
    """

    def run(batches):
        with tempfile.TemporaryDirectory(dir=SparkFiles.getRootDirectory()) as scratch, duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": scratch, "threads": 1, "preserve_insertion_order": False}) as db:
            db.execute("CREATE TABLE grams (lang VARCHAR, phrase VARCHAR, f BIGINT)")
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute("INSERT INTO grams SELECT lang, phrase, f FROM batch")
                db.unregister("batch")
            yield from db.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(f) >= {least}").to_arrow_reader(SENT)

    return run


def places(bits: int):
    """For mapInArrow over (lang, phrase): the place of each phrase in a bitmap."""

    def run(batches):
        for batch in batches:
            lists = pc.split_pattern(batch.column("phrase"), " ")
            n = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
            langs, out = batch.column("lang").to_pylist(), np.empty(0, np.uint64)
            for j in range(n):  # phrases of a round are of one length
                h = hashes(langs, pc.list_element(lists, j).to_pylist())
                out = longer(out, h) if j else h
            yield pa.RecordBatch.from_arrays([pa.array((out >> np.uint64(64 - bits)).astype(np.int64))], names=["place"])

    return run


def bitmap(phrases: DataFrame) -> np.ndarray:
    """2^SPREAD bits for each phrase, 2^BITS at most, as 64-bit words; it reaches the driver as its words that aren't zero."""
    bits = min(BITS, max(10, phrases.count().bit_length() + SPREAD))
    at = phrases.select("lang", "phrase").mapInArrow(places(bits), "place long")
    words = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toArrow()
    found = np.zeros(1 << (bits - 6), np.uint64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return found


def counted(cut: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """For each number of words: lang, phrase and f of the phrases that occur ``least`` times."""
    rounds, shared = [], None
    for n in range(1, longest + 1):
        if rounds:
            shared = cut.sparkSession.sparkContext.broadcast(bitmap(rounds[-1]))
        sent = cut.mapInArrow(grams(n, shared), "lang string, phrase string, f long").repartition("lang", "phrase")
        rounds.append(stored(sent.mapInArrow(summed(least), "lang string, phrase string, f long"), f"grams-{n}"))
    return rounds


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    cut = stored(pieces(docs), "pieces")
    totals = stored(cut.groupBy("lang").agg(F.sum(F.col("m") * (F.length("piece") - F.length(F.translate("piece", " ", "")) + 1)).alias("n")), "totals")
    rounds = counted(cut, longest, least)
    counts, candidates = rounds[0].limit(0), rounds[0].limit(0)
    for n, phrases in enumerate(rounds, 1):
        counts = counts.unionByName(phrases)
        candidates = candidates.unionByName(phrases) if n > 1 else candidates
    candidates = candidates.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    asked = F.expr("flatten(transform(sequence(1, size(w) - 1), k -> array(struct(2 * k AS slot, array_join(slice(w, 1, k), ' ') AS part), struct(2 * k + 1 AS slot, array_join(slice(w, k + 1, size(w) - k), ' ') AS part))))")
    requests = candidates.select("lang", "phrase", "a", F.inline(asked))
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answers = counts.select("lang", F.col("phrase").alias("part"), "f")
    heavy = F.broadcast(answers.where(F.col("f") * HEAVY > words))  # under HEAVY of each length
    told = requests.join(heavy, ["lang", "part"]).unionByName(requests.join(heavy, ["lang", "part"], "left_anti").join(answers.where(F.col("f") * HEAVY <= words), ["lang", "part"]))
    told = told.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.map_from_entries(F.collect_list(F.struct("slot", "f"))).alias("f"))  # 2 * longest answers at most
    big = lambda x: f"cast({x} AS decimal(19, 0))"
    score = f"(cast(1000000 AS decimal(7, 0)) * ({big('a')} * {big('a')})) div ({big('f[2 * k]')} * {big('f[2 * k + 1]')})"
    worst = F.expr(f"array_min(transform(sequence(1, size(f) div 2), k -> struct({score} AS score, k AS k, f[2 * k] AS l, f[2 * k + 1] AS r)))")
    scored = told.select("lang", "phrase", "a", worst.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    within = F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    held = candidates.where("size(w) > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each of SALTS parts of a language, then the first of these
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x != '') AS w FROM p
), g AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, generate_series(1, {LONGEST}) s(k)
), c AS (
    SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (
    SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang
), q AS MATERIALIZED (
    SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND a >= {LEAST}
), s AS (
    SELECT q.lang, q.phrase, q.a, l.a AS l, r.a AS r, ((1000000::HUGEINT * q.a * q.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM q) q
    JOIN c l ON l.lang = q.lang AND l.phrase = array_to_string(q.w[1:j], ' ')
    JOIN c r ON r.lang = q.lang AND r.phrase = array_to_string(q.w[j + 1:], ' ')
    QUALIFY row_number() OVER (PARTITION BY q.lang, q.phrase ORDER BY score, j) = 1
), h AS (
    SELECT lang, phrase, max(a) AS longer
    FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))))) AS phrase FROM q WHERE k > 2) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s LEFT JOIN h USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < {INSIDE} * a
QUALIFY rank <= {TOP}
"""
QUERIES = {"op13_collocations": op13_collocations}
ORACLE_SQL = {"op13_collocations": SQL}

"""Line dedup over windows of three consecutive lines, in DataFrame operations only.

The lines of a text are what newlines part. Every three consecutive lines that are not all blank are a window, hashed to
128 bits. Of equal windows in the whole table the first, by doc_id and position, covers nothing; every later one covers its
three lines. Covered positions merge into spans, and the lines of the spans are cut out of their text. A later window that
overlaps a first one takes the lines that they share: four equal lines leave one.

Hot windows: equal ones are first reduced to their first place by a partially aggregated group-by; the join that finds the
later ones meets one row on that side, so that Spark's skew join can split a hot window's rows among tasks.

Defined results: a null text stays null and has no line; an empty text is one empty line; texts of under three lines
stay as they are; a null doc_id comes first; of rows that share a doc_id and text all windows but the first place's are
later ones, for rows in the same place equally, so that exact repeats of a row are treated alike; an empty table gives an
empty result; other columns are kept, whatever their names, but columns named n_lines or n_removed are
replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.util import table

LINES = 3


def windows(lines: Column) -> Column:
    """An array of (at, h1, h2) for the windows of a text's lines that are not all blank; at counts from 0."""

    def window(i):
        joined = F.array_join(F.slice(lines, i + 1, LINES), "\n")
        h2 = F.xxhash64(F.lit("second"), joined)
        return F.struct(i.alias("at"), F.xxhash64(joined).alias("h1"), h2.alias("h2"), (F.length(F.trim(F.regexp_replace(joined, "\\s", ""))) == 0).alias("blank"))

    return F.when(F.size(lines) >= LINES, F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - LINES), window), lambda w: ~w["blank"]))


def later_windows(docs: DataFrame) -> DataFrame:
    """Row number, doc_id and position of every window that has an equal one before it. docs: __row, doc_id, text."""
    split = docs.select("__row", "doc_id", F.split("text", "\n", -1).alias("lines"))
    found = split.select("__row", "doc_id", F.explode(windows(F.col("lines"))).alias("w")).select("__row", "doc_id", "w.at", "w.h1", "w.h2")
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("at").alias("at"))
    firsts = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    return found.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("__row", "at")


def spans(starts: Column) -> Column:
    """Merges windows that begin at the sorted positions into spans (a, b), b exclusive."""
    opens = F.filter(starts, lambda x, i: (i == 0) | (x > F.get(starts, i - 1) + LINES))
    closes = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > x + LINES))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("a"), (b + LINES).alias("b")))


def without(lines: Column, cut: Column) -> Column:
    """The lines outside the spans."""
    heads = F.transform(cut, lambda s, i: F.slice(lines, F.when(i == 0, 0).otherwise(F.get(cut, i - 1)["b"]) + 1, s["a"] - F.when(i == 0, 0).otherwise(F.get(cut, i - 1)["b"])))
    end = F.element_at(cut, -1)["b"]
    return F.concat(F.flatten(heads), F.slice(lines, end + 1, F.size(lines) - end))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text rid of repeated passages, and the columns n_lines and n_removed."""
    row = F.xxhash64("doc_id", F.col("text").isNull(), "text")
    found = later_windows(docs.select(row.alias("__row"), "doc_id", "text"))
    marks = found.groupBy("__row").agg(F.array_sort(F.collect_set("at")).alias("at"))  # at most a position for each line
    # all of docs is one column here, so that no name of it can clash
    joined = docs.select(F.struct("*").alias("doc"), row.alias("__row")).join(marks, "__row", "left")
    cut = joined.withColumn("lines", F.split("doc.text", "\n", -1)).withColumn("cut", spans(F.col("at")))
    kept = cut.withColumn("left", F.when(F.col("at").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.col("cut"))))
    n = F.when(F.col("doc.text").isNull(), 0).otherwise(F.coalesce(F.size("lines"), F.lit(0)))
    text = F.when(F.col("at").isNull(), F.col("doc.text")).otherwise(F.array_join("left", "\n"))
    removed = F.when(F.col("at").isNull(), 0).otherwise(n - F.size("left"))
    columns = [text.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return kept.select(*columns, n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL = {
    "op1_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
            FROM documents WHERE text IS NOT NULL
        ), w AS (
            SELECT doc_id, pos, line, lead(line, 1) OVER o AS line2, lead(line, 2) OVER o AS line3, count(*) OVER (PARTITION BY doc_id) AS n
            FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ), r AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS nth
            FROM w WHERE pos + 3 <= n AND NOT regexp_full_match(line || line2 || line3, '\\s*')
        ), covered AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) t(k) WHERE nth > 1
        ), kept AS (
            SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
            FROM l LEFT JOIN covered c USING (doc_id, pos) GROUP BY l.doc_id
        )
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS text_sha256
        FROM documents d LEFT JOIN kept USING (doc_id)
    """
}

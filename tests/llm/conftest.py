import pytest

EDGE = [
    (0, None, "en", "a", 0), (1, "", None, "a", None), (2, "   \n\t", "en", None, 1), (3, "One two three four five six", "en", "b", 5), (4, "ONE two three four five six", "en", "b", 5),
    (5, "x\ny\nz\nx\ny\nz", "de", "a", 11), (6, "line one\nline two\nline three\nline four", "de", "a", 3), (7, "line one\nline two\nline three\nline five", "de", None, 3),
    (8, "long " * 30_000, "en", "c", 150_000), (9, "é" * 300 + " ünïcode 日本語 🙂 <|endoftext|> it's", "fr", "c", 9), (9, "another text with the same id", "fr", "c", 9), (3, "One two three four five six", "en", "b", 5), (None, "no id here", "en", "b", 5), (-7, "negative id", "en", "b", 5),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({"size": F.lit(1), "score": F.lit("s"), "digest": F.lit(2), "n": F.lit(3), "copies": F.lit(4), "fp": F.lit(5), "word": F.lit("w"), "tie": F.lit(6), "line": F.lit(7)}).cache()


@pytest.fixture(scope="session")
def texts():
    return {i: t for i, t, *_ in EDGE if i is not None}

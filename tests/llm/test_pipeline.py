import os

import pytest

import corpus_pipeline
from tapeworks.llm import registry
from tests.test_queries import DATA, duck, rows_of  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    found, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns) and rows_of(found, columns) == rows_of(want, columns)


def test_stages_narrow_the_rows_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        rows = docs.collect()
        assert docs.columns == columns and all(r["text"] == texts[r["doc_id"]] for r in rows)
        if name != "mixing":
            assert 0 < len(rows) <= n
            n = len(rows)
        if name == "exact_dedup":
            assert len({r["text"].lower() for r in rows}) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_stages_of_edge_cases(spark, edge):
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        last, docs = docs, stage(spark, docs, DATA).cache()
        if name != "bpe":
            assert docs.columns == edge.columns and docs.exceptAll(last.crossJoin(spark.range(3)).drop("id")).count() == 0
    assert docs.count() == last.count()

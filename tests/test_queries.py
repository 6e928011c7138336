"""Every registered query of the tape against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tapeworks.plans import registry, stored  # noqa: F401 (stored adds its queries)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows_of(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - set(registry.GROUPS)))
def test_query_matches_sql(spark, duck, name):
    found, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns) and len(found) == len(want)
    assert rows_of(found, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_seams_agree(spark):
    assert registry.QUERIES["seam_check"](spark, DATA).where("apart").count() == 0


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

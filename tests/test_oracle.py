"""Every registered query against its DuckDB twin on the same Parquet tables (sf0.001
here; the driver runs the same comparison at sf0.01). Queries without SQL (iterative
training) must run and return rows."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare

ALL = sorted(E.queries())
WITH_SQL = [n for n in ALL if n in E.oracle_sql()]
ROWS_ONLY = [n for n in ALL if n not in E.oracle_sql()]


def test_every_query_is_registered_once():
    assert len(ALL) == len(set(ALL))
    assert set(E.oracle_sql()) <= set(ALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_duckdb(spark, duck_small, name):
    r = compare(spark, name, SF_SMALL, duck_small)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["match"], r


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "source", "n_rows", "n_ids"]

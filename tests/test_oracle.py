"""Every registered query against its DuckDB oracle (exact rows, names and values)."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle import compare, duck

SF_DIR = os.environ.get("TABLESCOPE_TEST_SF", "/root/testdata/sf0.001")
SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, QUERIES[name], SQL[name], SF_DIR, con)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert {"table_name", "column_name", "null_rate", "distinct_count"} <= set(df.columns)

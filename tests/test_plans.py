"""Plan checks: no Python UDFs, pruned scans, codegen'd wide aggregates, pushed filters."""

import os

import pytest

from tablescope.operators import profile
from tablescope.plans.registry import queries

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The executed (final) AQE plan, without the initial-plan section."""
    return plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_udf(spark, name):
    p = plan(queries()[name](spark, SF_DIR))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_scan_reads_only_needed_columns(spark):
    li = spark.read.parquet(os.path.join(SF_DIR, "lineitem.parquet"))
    p = plan(profile.column_nulls(li, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in p


def test_filters_pushed_to_parquet(spark):
    o = spark.read.parquet(os.path.join(SF_DIR, "orders.parquet"))
    from pyspark.sql import functions as F
    p = plan(profile.column_nulls(o.where(F.col("o_orderstatus") == "F"), ["o_totalprice"]))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p


def test_profile_has_no_interpreted_wide_aggregate(spark):
    li = spark.read.parquet(os.path.join(SF_DIR, "lineitem.parquet"))
    df = profile.column_stats(li)
    df.collect()
    text = final_plan(df)
    import re
    # numeric buffers: codegen'd hash aggregates; string min/max buffers make Spark pick a
    # (key-less, so sort-free) SortAggregate
    hashed = re.findall(r"(\*\(\d+\) )?(?<![A-Za-z])HashAggregate\(", text)
    assert hashed and all(hashed)
    assert "ObjectHashAggregate" not in text

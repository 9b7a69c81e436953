"""Invariants on the test tables and property tests against brute force on random frames."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.operators import benford, correlation, keys, marts, profile
from tablescope.plans import bindings as B
from tablescope.sources.tables import load_tables

SF = "/root/testdata/sf0.001"
FAST = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_daily_revenue_sums_to_item_revenue(spark):
    t = load_tables(spark, SF, ["orders", "lineitem"])
    m = marts.daily_revenue(t["orders"], t["lineitem"], B.ROLES)
    total_mart = m.agg(F.sum(F.col("total_items_sold")), F.sum(F.col("total_orders"))).first()
    li = t["lineitem"].join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    assert total_mart[0] == li.count()
    assert total_mart[1] == li.select("l_orderkey").distinct().count()
    exact = li.agg(F.sum((F.col("l_extendedprice") + F.col("l_extendedprice") * F.col("l_tax"))
                         .cast("decimal(18,4)"))).first()[0]
    assert abs(m.agg(F.sum("total_revenue")).first()[0] - float(exact)) < 0.01 * m.count()


def test_matrix_symmetric_unit_diagonal(spark):
    li = load_tables(spark, SF, ["lineitem"])["lineitem"]
    m = {(r.column_1, r.column_2): r.correlation for r in correlation.correlation_matrix(li).collect()}
    cols = {a for a, _ in m}
    assert len(m) == len(cols) ** 2
    for a in cols:
        assert m[(a, a)] == 1.0
        for b in cols:
            assert m[(a, b)] == m[(b, a)] and -1.0 <= m[(a, b)] <= 1.0


def test_benford_counts_sum_to_analysed(spark):
    ev = load_tables(spark, SF, ["events"])["events"]
    digits = benford.benford_digits(ev, "value").agg(F.sum("count")).first()[0]
    summary = benford.benford_summary(ev, "value").first()
    assert digits == summary.total_values_analyzed == ev.where(F.col("value") >= 1).count()


rows_strategy = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 2))),
                         min_size=0, max_size=12)


@FAST
@given(rows_strategy)
def test_pk_uniqueness_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "a INT, b INT")
    r = keys.pk_uniqueness(df, ["a", "b"]).first()
    assert r.total_rows == len(rows) and r.unique_pk_rows == len(set(rows))


@FAST
@given(rows_strategy)
def test_completeness_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "a INT, b INT")
    out = profile.table_completeness(df).collect()
    n = len(rows)
    rates = [round(sum(1 for r in rows if r[i] is None) / n, 4) if n else 0.0 for i in range(2)]
    assert sorted(r.null_rate for r in out) == sorted(rates)
    expected = 1.0 - sum(rates) / 2
    assert abs(out[0].overall_completeness - expected) < 1e-4 + 1e-9


@FAST
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=0, max_size=15))
def test_column_stats_match_brute_force(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x INT")
    s = profile.column_stats(df).first()
    vals = [x for x in xs if x is not None]
    assert s.distinct_count == len(set(vals))
    if vals:
        mean = sum(vals) / len(vals)
        assert math.isclose(s.mean_value, mean, abs_tol=1e-9)
        assert s.min_value == min(str(v) for v in vals) and s.min_typed == str(min(vals))
    else:
        assert s.mean_value is None and s.min_value is None


def test_hot_key_holding_a_third_of_rows(spark):
    """One key carries a third of the child rows: results stay exact, and the
    join input is pre-aggregated to one row per key."""
    from tablescope.operators.constraints import ForeignKey
    n = 3000
    child = spark.range(n).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 500 + 1000 END AS k")
    parent = spark.range(0, 1400).selectExpr("id AS k")
    fk = ForeignKey("child_k", "child", ("k",), "parent", ("k",))
    r = keys.referential_integrity({"child": child, "parent": parent}, [fk]).first()
    rows = [(i, 7 if i % 3 == 0 else i % 500 + 1000) for i in range(n)]
    orphans = [k for _, k in rows if k >= 1400]
    assert (r.child_rows, r.orphan_rows, r.orphan_keys) == (n, len(orphans), len(set(orphans)))
    u = keys.pk_uniqueness(child, ["k"]).first()
    assert u.unique_pk_rows == len({k for _, k in rows})
    plan = keys.orphan_counts(child, parent, ["k"], ["k"])._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    j = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert "Aggregate [" in lines[j + 1]  # child keys are reduced before the join

    orders = spark.range(300).selectExpr("id AS o_orderkey", "id % 10 AS o_custkey",
                                         "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + make_interval(0, 0, 0, CAST(id % 3 AS INT)) AS o_orderdate")
    items = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 300 END AS l_orderkey",
                                         "CAST(id % 97 AS DOUBLE) AS l_extendedprice", "0.0D AS l_tax")
    m = marts.daily_revenue(orders, items, B.ROLES)
    assert m.agg(F.sum("total_items_sold")).first()[0] == 3000
    hot_day = m.where(F.col("date") == F.lit("2024-01-01").cast("date")).first()
    assert hot_day.total_items_sold == sum(1 for i in range(3000) if (0 if i % 3 == 0 else i % 300) % 3 == 0)

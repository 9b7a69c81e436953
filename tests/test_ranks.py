"""Exact percentiles and ranks: odd values against Spark's own aggregates and windows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablescope.functions.quantiles import exact_percentiles
from tablescope.functions.ranks import value_ranks, with_ranks
from tablescope.operators import distribution, marts, outliers

INF, NAN = float("inf"), float("nan")
PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def odd_values():
    rng = random.Random(1)
    yield [-INF, 1.0, 2.0, INF]
    yield [NAN, 1.0, 2.0, 3.0]
    yield [NAN, NAN]
    yield [None, None]
    yield [5.0]
    yield [0.0, -0.0, 0.0, 1.0]
    yield [1e308, -1e308, 3.0]
    yield [rng.choice([None, NAN, INF, -INF, 0.0, 1.5, rng.random()]) for _ in range(300)]
    yield [rng.choice([7.0, rng.random() * 10]) for _ in range(6000)]


def same(a, b):
    if a is None or b is None or math.isnan(a) or math.isnan(b):
        return a is b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    return a == b or abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, x double").repartition(3)


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_percentiles_of_odd_values(spark, accuracy):
    for values in odd_values():
        df = frame(spark, values)
        got = spark.range(1).select(exact_percentiles(df, "x", PROBS, accuracy)).first()[0]
        want = df.agg(F.percentile("x", F.array(*map(F.lit, PROBS)))).first()[0] or [None] * len(PROBS)
        assert all(map(same, got, want)), (values[:8], got, want)


def test_percentile_reports_with_nan(spark):
    df = frame(spark, [NAN, 1.0, 2.0, 3.0, 4.0, 5.0, 90.0, -INF])
    row = outliers.outliers_iqr(df, "x").first()
    assert (row["q1"], row["total_rows"]) == (1.75, 8)
    assert distribution.distribution_stats(df, "x").first()["p50"] == 3.5


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_against_a_window(spark, descending):
    for values in odd_values():
        df = frame(spark, values).withColumn("rank", F.lit("clash")).withColumnRenamed("rank", "v")
        way = "DESC" if descending else "ASC"
        want = df.where("x IS NOT NULL").selectExpr("id", f"rank() OVER (ORDER BY x {way}) AS r", f"percent_rank() OVER (ORDER BY x {way}) AS p")
        got = {r["id"]: (r["rank"], r["percent_rank"]) for r in with_ranks(df, "x", descending).collect()}
        found = {r["id"]: (r["r"], r["p"]) for r in want.collect()}
        assert len(got) == len(values)
        for i, x in enumerate(values):
            assert got[i] == (found[i] if x is not None else (None, None))


def test_ranks_of_nothing(spark):
    assert with_ranks(frame(spark, [1.0]).limit(0), "x").collect() == []
    assert [tuple(r) for r in value_ranks(frame(spark, [2.0, 2.0, 1.0, None]), "x").orderBy("v").collect()] == [(1.0, 1, 1, 3), (2.0, 2, 2, 3)]


def test_no_window_gathers_the_rows(spark):
    df = frame(spark, [float(i % 1000) for i in range(5000)])
    ranked = value_ranks(df, "x")
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("m#" in line or "part#" in line for line in windows)  # sums of ranges, or within a range


def test_vip_rules(spark):
    rows = [(i, i % 40, 10.0 * (i % 40), "2001-08-01") for i in range(160)]
    orders = spark.createDataFrame(rows, "k int, c int, total double, d string").withColumn("d", F.to_timestamp("d"))
    roles = marts.Roles(order_key="k", customer_key="c", order_total="total", purchase_ts="d")
    by = {rule: {r["segment_name"]: r["customer_count"] for r in marts.customer_segments(orders, "2001-09-01 00:00:00", roles, vip_by=rule).collect()} for rule in ("cutoff", "percent_rank")}
    assert by == {"cutoff": {"VIP": 4, "Regular": 36}, "percent_rank": {"VIP": 4, "Regular": 36}}
    with pytest.raises(ValueError):
        marts.customer_segments(orders, "2001-09-01", roles, vip_by="other")

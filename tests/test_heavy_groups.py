"""The top groups by bounds equal the full group-by."""

import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import heavy_groups as h


def full(rows, n):
    """Plain Python: rows (a, b, amount) -> first n of ((a, b), rows, sum)."""
    out = {}
    for a, b, m in rows:
        c, s = out.get((a, b), (0, None))
        out[a, b] = c + 1, s if m is None else (s or 0) + m
    key = lambda k: [(x is not None, x if x is not None else 0) for x in k]
    count = sorted(((k, c) for k, (c, _) in out.items()), key=lambda x: (-x[1], key(x[0])))[:n]
    total = sorted(((k, c, s) for k, (c, s) in out.items()), key=lambda x: (x[2] is None, -(x[2] or 0), key(x[0])))[:n]
    return [(*k, c) for k, c in count], [(*k, c, s) for k, c, s in total]


def cases():
    rng = random.Random(3)
    zipf = [(int(rng.paretovariate(0.7)) % 5000, rng.randrange(2), rng.randrange(100)) for _ in range(20_000)]
    yield "skew", zipf
    yield "alike", [(i % 700, None, 1) for i in range(4_200)]
    yield "hot", [(None, None, 1)] * 3_000 + [(i, 0, 1) for i in range(6_000)]
    yield "negative", [(i % 60, 0, -rng.randrange(50)) for i in range(500)]
    yield "signs", [(i % 900, 0, rng.randrange(-90, 100)) for i in range(9_000)] + [(7, 0, None), (5_000, 0, None)]
    yield "few", [(1, 1, 5), (1, 1, None), (2, 1, None)]
    yield "none", []


@pytest.mark.parametrize("name,rows", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("slots", [16, 1024])
def test_equal_to_the_full_group_by(spark, name, rows, slots):
    df = spark.createDataFrame(rows, "`a.x` int, row_count int, m int").repartition(3)
    counts, sums = full(rows, 8)
    assert [tuple(r) for r in h.heavy_groups(df, ["a.x", "row_count"], 8, slots=slots).collect()] == counts
    df = df.withColumnsRenamed({"row_count": "b"})
    assert [tuple(r) for r in h.heavy_groups(df, ["a.x", "b"], 8, "m", slots=slots).collect()] == sums


def test_few_keys_are_left_to_group(spark):
    n = 40_000
    df = spark.range(n * 2).select(F.when(F.col("id") < n, F.col("id") % 10).otherwise(F.col("id")).alias("k"))
    keyed = h._keyed(df, ["k"], None, 4096)
    bounds = h.slot_bounds(keyed, False)
    assert bounds.count() <= h.ROWS * 4096
    left = h.above(keyed, bounds, n // 10).select("k0").distinct().count()
    assert 10 <= left < 20  # of 40,010
    p = h.above(keyed, bounds, n // 10)._jdf.queryExecution().executedPlan().toString()
    assert p.count("BroadcastHashJoin") == h.ROWS


def test_amounts_that_are_no_money(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.25), ("b", float("inf")), ("c", -0.0)], "k string, m double")
    assert [tuple(r) for r in h.heavy_groups(df, ["k"], 5, "m").collect()] == [("a", 2, 1.25), ("c", 1, 0.0), ("b", 1, None)]

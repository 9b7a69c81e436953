"""Content fingerprints, profiles kept up to date, marts kept up to date."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from tablescope.operators import fingerprint, incremental_profile, profile

SF = "/root/testdata/sf0.001"


def sums(df, partition=None):
    return sorted((tuple(r) for r in fingerprint.content_fingerprint(df, partition).collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    schema = "p string, i int, d double, s string, a array<string>, m map<string, int>, t struct<x: int, y: array<int>>, b binary, ts timestamp"
    rows = [("a", 1, 0.0, "x", ["u", None], {"k": 1, "l": None}, (1, [1, None]), b"\x00", None), ("a", None, -0.0, None, [None, "u"], None, (None, []), None, None),
            ("b", 2, float("nan"), "", [], {}, None, b"", None), (None, 3, 1.5, "y", None, {"l": None, "k": 1}, (1, None), b"\x01", None), ("a", 1, 0.0, "x", ["u", None], {"l": None, "k": 1}, (1, [1, None]), b"\x00", None)]
    return spark.createDataFrame(rows, schema), rows, schema


def test_order_files_and_columns_do_not_matter(spark, odd):
    df, rows, schema = odd
    want = sums(df, "p")
    assert sums(df.repartition(7, "i").orderBy(F.col("s").desc()), "p") == want
    assert sums(df.select(*reversed(df.columns)), "p") == want
    assert sums(df.withColumn("d", F.col("d") + 0.0), "p") == want  # -0.0 is 0.0
    whole = fingerprint.combined(fingerprint.content_fingerprint(df, "p")).first()
    assert (None, *whole) == sums(df)[0]
    assert [r[1] for r in sums(df.limit(0))] == [0] and sums(df.limit(0), "p") == []


@pytest.mark.parametrize("column,edit", [
    ("i", "if(i = 3, 4, i)"), ("s", "coalesce(s, '')"), ("a", "array_sort(a)"), ("a", "coalesce(a, CAST(array() AS ARRAY<STRING>))"),
    ("t", "named_struct('x', coalesce(t.x, 0), 'y', t.y)"), ("m", "map_filter(m, (k, v) -> v IS NOT NULL)"), ("b", "coalesce(b, X'')"), ("d", "nanvl(d, 0D)"),
])
def test_one_changed_value_shows(odd, column, edit):
    df = odd[0]
    assert sums(df.withColumn(column, F.expr(edit))) != sums(df)


def test_moved_values_and_repeated_rows_show(spark):
    one = spark.createDataFrame([("x", None), ("y", "z")], "a string, b string")
    two = spark.createDataFrame([(None, "x"), ("y", "z")], "a string, b string")
    swapped = spark.createDataFrame([("x", "z"), ("y", None)], "a string, b string")
    assert len({tuple(sums(d)[0]) for d in (one, two, swapped, one.unionByName(one), one.unionByName(one.limit(1)))}) == 5


def test_diff_names_partitions(odd):
    df = odd[0]
    now = df.where("p IS DISTINCT FROM 'b'").withColumn("i", F.when(F.col("p").isNull(), 9).otherwise(F.col("i"))).unionByName(df.where("p = 'b'").withColumn("p", F.lit("c")))
    a, b = (fingerprint.table_fingerprints({"t": d}, {"t": "p"}) for d in (df, now))
    got = {(r["part"], r["change"], r["old_rows"], r["new_rows"]) for r in fingerprint.content_diff(a, b).collect()}
    assert got == {("b", "removed", 1, None), ("c", "added", None, 1), (None, "changed", 1, 1)}
    assert fingerprint.content_diff(a, a).collect() == []
    assert len({r["content_hash"] for r in fingerprint.content_hash(a.unionByName(b)).collect()}) == 5


def test_profile_reads_only_new_partitions(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "store")
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("part", F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")))
    rows.where("part < 4").write.partitionBy("part").parquet(table)
    read = lambda: spark.read.parquet(table)
    assert incremental_profile.update_profile(read(), "part", store) == ["1", "2", "3"]
    assert incremental_profile.update_profile(read(), "part", store) == []
    rows.where("part IS NULL OR part >= 4").write.mode("append").partitionBy("part").parquet(table)
    rows.where("part = 2").limit(10).write.mode("append").partitionBy("part").parquet(table)
    before = {f: os.path.getmtime(f) for f in (str(p) for p in (tmp_path / "store").rglob("*.parquet"))}
    assert incremental_profile.update_profile(read(), "part", store) == ["2", "4", "5", None]
    assert sum(os.path.exists(f) and os.path.getmtime(f) == t for f, t in before.items()) == 2  # the rows of partitions 1 and 3
    got = {r["column_name"]: r for r in incremental_profile.merged_profile(incremental_profile.stored_profile(read(), "part", store)).collect()}
    exact = {r["column_name"]: r for r in profile.column_profile(read()).collect()}
    assert set(got) == set(exact) - {"part"}
    for c, r in got.items():
        e = exact[c]
        assert (r["total_rows"], r["null_count"], r["min_value"], r["max_value"]) == (e["total_rows"], e["null_count"], e["min_value"], e["max_value"])
        assert abs(r["distinct_approx"] - e["distinct_count"]) <= max(1, incremental_profile.DISTINCT_ERROR * e["distinct_count"])
        if e["mean_value"] is not None:
            assert r["mean_value"] == pytest.approx(e["mean_value"]) and r["std_dev"] == pytest.approx(e["std_dev"])
            n = e["total_rows"]
            for p, v in zip((0.25, 0.5, 0.75), r["quantiles"]):
                low, high = read().agg(F.count_if(F.col(c) < v), F.count_if(F.col(c) <= v)).first()
                assert low / n - incremental_profile.QUANTILE_ERROR <= p <= high / n + incremental_profile.QUANTILE_ERROR


def test_profile_drops_partitions_that_are_gone(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "store")
    df = spark.createDataFrame([("a b/c", 1, None), ("é=", 2, None), ("z", None, None)], "k string, x int, empty double")
    df.write.partitionBy("k").parquet(table)
    assert incremental_profile.update_profile(spark.read.parquet(table), "k", store) == ["a b/c", "z", "é="]
    left = spark.read.parquet(table).where("k <> 'z'")
    got = {r["column_name"]: r for r in incremental_profile.merged_profile(incremental_profile.stored_profile(left, "k", store)).collect()}
    assert got["x"]["total_rows"] == 2 and got["x"]["null_count"] == 0 and got["x"]["mean_value"] == 1.5
    assert got["empty"]["null_count"] == 2 and got["empty"]["quantiles"] is None and got["empty"]["distinct_approx"] == 0


def test_second_run_reads_no_old_bytes(spark, tmp_path):
    """The scan of the second run lists one partition only."""
    table = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 10 AS part").write.partitionBy("part").parquet(table)
    plan = spark.read.parquet(table).where(F.col("part").isin([F.lit("3").cast("int")]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "= 3)" in plan


# --- marts kept up to date -------------------------------------------------------------

ROWS = lambda df: sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def shop(spark):
    from tablescope.plans import bindings as B

    o, li = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("orders", "lineitem"))
    # some orders have a second review, some customers and items are unknown
    reviews = B.reviews(o).unionByName(B.reviews(o.where("o_orderkey % 3 = 0")).withColumn("score", F.lit(5)))
    return o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey"))), li, reviews, B.ROLES


def whole(o, li, reviews, roles):
    from tablescope.operators import marts

    return [ROWS(marts.daily_revenue(o, li, roles)), ROWS(marts.seller_performance(o, li, reviews, roles, dedupe_reviews=True)), ROWS(marts.product_metrics(o, li, reviews, roles, dedupe_reviews=True))]


def from_states(spark, path):
    from tablescope.operators import incremental_marts as im

    states = im.load_states(spark, path)
    return [ROWS(f(states)) for f in (im.revenue, im.sellers, im.products)]


def test_marts_from_a_base_and_changed_days(spark, shop, tmp_path):
    from tablescope.operators import incremental_marts as im

    o, li, reviews, roles = shop
    path = str(tmp_path / "state")
    early = o.where("o_orderdate < '1998-06-01'")
    im.refresh(path, early, li, reviews, roles)
    assert from_states(spark, path) == whole(early, li, reviews, roles)
    # later days arrive, the orders of one day go and those of another change
    days = [str(r[0]) for r in o.select(F.to_date("o_orderdate")).distinct().orderBy(F.to_date("o_orderdate")).collect()]
    gone, other = days[3], days[10]
    now = o.where(F.to_date("o_orderdate") != F.lit(gone).cast("date")).withColumn("o_orderstatus", F.when(F.to_date("o_orderdate") == F.lit(other).cast("date"), "P").otherwise(F.col("o_orderstatus")))
    touched = {d[:7] for d in days if d >= "1998-06-01" or d in (gone, other)}
    files = {str(f): os.path.getmtime(f) for f in (tmp_path / "state").rglob("*.parquet") if not any(f"month={m}" in str(f) for m in touched)}
    for _ in range(2):  # a repeated run changes nothing
        im.refresh(path, now, li, reviews, roles, [gone, other, *(d for d in days if d >= "1998-06-01")])
        assert from_states(spark, path) == whole(now, li, reviews, roles)
    assert files and all(os.path.getmtime(f) == t for f, t in files.items())  # other months keep their files
    im.refresh(path, now, li, reviews, roles, [])
    empty = now.where("o_orderdate < '1998-06-01'")
    im.refresh(path, empty, li, reviews, roles, [d for d in days if d >= "1998-06-01"])  # months that lose all orders
    assert from_states(spark, path) == whole(empty, li, reviews, roles)


def test_customers_of_a_month_count_once(spark, shop, tmp_path):
    from tablescope.operators import incremental_marts as im

    o, li, reviews, roles = shop
    im.refresh(str(tmp_path / "s"), o, li, reviews, roles)
    got = {str(r["date"]): (r["total_orders"], r["unique_customers"]) for r in im.revenue(im.load_states(spark, str(tmp_path / "s")), "trunc(day, 'MM')").collect()}
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    want = {str(r[0]): (r[1], r[2]) for r in j.groupBy(F.trunc(F.to_date("o_orderdate"), "MM")).agg(F.count_distinct("o_orderkey"), F.count_distinct("o_custkey")).collect()}
    assert got == want


def test_a_large_month_is_not_one_task(spark, shop, tmp_path):
    from tablescope.operators import incremental_marts as im

    o, li, reviews, roles = shop
    o = o.where("o_orderdate >= '1998-06-01' AND o_orderdate < '1998-08-01'")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "4KB")
    try:
        im.refresh(str(tmp_path / "s"), o, li, reviews, roles)
    finally:
        spark.conf.unset(size)
    files = [str(f.parent.name) for f in (tmp_path / "s").rglob("*.parquet")]
    assert all(files.count(f"month={m}") > 1 for m in ("1998-06", "1998-07"))
    assert from_states(spark, str(tmp_path / "s")) == whole(o, li, reviews, roles)


def test_customers_meet_before_they_become_bits(spark, shop):
    from tablescope.operators import incremental_marts as im

    plan = im.day_states(*shop)["customers"]._jdf.queryExecution().executedPlan().toString().splitlines()
    aggs = [k for k, line in enumerate(plan) if "bitmap_construct_agg" in line]
    assert len(aggs) == 2 and not any("Exchange" in line for line in plan[aggs[0] : aggs[1]])


@pytest.fixture
def in_pieces(monkeypatch):
    from tablescope.operators import incremental_marts as im

    for name, n in {"SHARE_BYTES": 1, "BATCH_BYTES": 1, "BATCHES": 3}.items():
        monkeypatch.setattr(im, name, n)


def test_a_refresh_holds_one_batch_on_disk(spark, shop, tmp_path, monkeypatch, in_pieces):
    """The shuffle files of a step are gone before the next, the joined rows go batch by batch."""
    from tablescope.operators import incremental_marts as im
    from tablescope.session import shared_dir

    o, li, reviews, roles = shop
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {f.name for d in dirs for f in pathlib.Path(d).rglob("shuffle_*")}
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    stored = lambda: {str(f) for f in shared.rglob("*.parquet")}
    seen, states_of, before, kept = [], im.states_of, shuffles(), {*shared.iterdir()}

    def watched(j):
        seen.append((shuffles() - before, {r[0] for r in j.select(F.month("day")).distinct().collect()}, len({f.rsplit("/", 2)[1] for f in stored() if "/mart-rows-" in f})))
        return states_of(j)

    monkeypatch.setattr(im, "states_of", watched)
    path = str(tmp_path / "s")
    im.refresh(path, o, li, reviews, roles)
    assert seen == [(set(), {k, k + 3, k + 6, k + 9}, left) for k, left in ((1, 12), (2, 8), (3, 4))]
    assert shuffles() <= before and {*shared.iterdir()} == kept
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert all(".zstd." in f.name for f in pathlib.Path(path).rglob("*.parquet"))
    assert from_states(spark, path) == whole(o, li, reviews, roles)
    now = o.where("o_orderdate < '1998-06-01'")  # months that lose all orders
    days = [str(r[0]) for r in o.where("o_orderdate >= '1998-05-20'").select(F.to_date("o_orderdate")).distinct().collect()]
    before = shuffles()
    im.refresh(path, now, li, reviews, roles, days)
    assert shuffles() <= before and {*shared.iterdir()} == kept
    assert from_states(spark, path) == whole(now, li, reviews, roles)


def test_a_refresh_that_fails_leaves_no_rows(spark, shop, tmp_path, monkeypatch, in_pieces):
    from tablescope.operators import incremental_marts as im
    from tablescope.session import shared_dir

    monkeypatch.setattr(im, "states_of", lambda j: 1 / 0)
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    kept = {*shared.iterdir()}
    with pytest.raises(ZeroDivisionError):
        im.refresh(str(tmp_path / "s"), *shop)
    assert {*shared.iterdir()} == kept and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("order,item,shares", [("int", "bigint", 4), ("string", "string", 4), ("string", "bigint", 1)])
def test_pieces_give_the_states_of_the_whole(spark, tmp_path, in_pieces, order, item, shares):
    """Keys of two types, repeated and unknown ones, orders without a day, a role that is null."""
    from tablescope.operators import incremental_marts as im
    from tablescope.operators.marts import Roles

    day = lambda k: None if k % 7 == 0 else f"20{k % 3:02d}-{k % 12 + 1:02d}-{k % 28 + 1:02d} 10:00:00"
    orders = spark.createDataFrame([(None if k % 11 == 0 else k % 50, None if k % 5 == 0 else k % 40, day(k)) for k in range(60)], "k int, customer_id int, at string")
    items = spark.createDataFrame([(None if k % 13 == 0 else k % 55, k % 4, k % 6, k / 4, k % 3) for k in range(200)], "k int, product_id int, seller_id int, price double, quantity int")
    reviews = spark.createDataFrame([(k % 45, k % 6) for k in range(70)], "k int, score int")
    orders = orders.select(F.col("k").cast(order).alias("order_id"), "customer_id", F.lit("shipped").alias("order_status"), F.col("at").cast("timestamp").alias("purchase_timestamp"))
    items = items.select(F.col("k").cast(item).alias("order_id"), "product_id", "seller_id", "price", "quantity", F.lit("2003-01-01").cast("timestamp").alias("delivered_customer_date"))
    reviews = reviews.select(F.col("k").cast(order).alias("order_id"), "score")
    given = orders, items, reviews, Roles(item_freight="NULL")
    assert len(im._shares(*given)) == shares
    im.refresh(str(tmp_path / "s"), *given)
    stored, at_once = im.load_states(spark, str(tmp_path / "s")), im.day_states(*given)
    for kind, rows in stored.items():
        want = ROWS(at_once[kind].select(*rows.columns))
        assert want and ROWS(rows) == want


def test_ranges_of_months():
    from tablescope.operators.incremental_marts import _ranges

    assert _ranges(["1999-11", "1999-12", "2000-01", "2001-05"]) == [("1999-11-01", "2000-02-01"), ("2001-05-01", "2001-06-01")]

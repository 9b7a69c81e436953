"""Micro-frames for values the test tables do not hold: exact sums, odd numbers, null and
repeated keys, odd names, user folders. Expected values are worked out by hand."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tablescope.functions.exprs import money
from tablescope.operators import benford, catalog, keys, kpi, marts, profile, report, retail
from tablescope.operators.constraints import constraints_frame
from tablescope.plans import registry
from tablescope.sources import sinks
from tablescope.sources.sql import UnsafeQueryError, safe_sql
from tablescope.sources.tables import list_tables, load_tables, register_views, sample_rows
from tablescope.sources.upsert import upsert

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- sums -----------------------------------------------------------------------------

def test_sums_keep_small_and_large_values(spark):
    small = spark.range(1_000_000).select(F.lit(0.00004).alias("x"), F.lit("g").alias("g"))
    assert kpi.measure_summary(small, "x").first()["total_value"] == 40.0
    assert kpi.group_sum_topn(small, "g", "x").first()["total_revenue"] == 40.0
    assert kpi.kpi_revenue(small, "x").first()["total_revenue"] == 40.0
    large = spark.createDataFrame([(1e15,), (1e15,)], "x double")
    assert kpi.kpi_revenue(large, "x").first()["total_revenue"] == 2e15
    assert kpi.measure_summary(large, "x").first()["avg_value"] == 1e15


def test_sums_keep_the_source_decimal_and_whole_numbers(spark):
    d = spark.sql("SELECT CAST('0.000000000000000001' AS DECIMAL(38,18)) AS x FROM range(1000000)")
    assert d.agg(F.sum(money("x", d)).cast("double")).first()[0] == 1e-12
    i = spark.createDataFrame([((1 << 62),)] * 4, "x long")
    assert kpi.measure_summary(i, "x").first()["total_value"] == float(1 << 64)


def test_sums_with_nan_and_infinity(spark):
    d = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double")
    assert kpi.kpi_revenue(d, "x").first()["total_revenue"] == 1.5  # money: NaN is none


def _orders_items(spark):
    orders = spark.createDataFrame(
        [(1, 10, "canceled", "2020-01-01"), (2, 10, "ok", "2020-01-01"), (3, None, "ok", "2020-01-02"), (2, 11, "ok", "2020-01-01")],
        "order_id long, customer_id long, order_status string, d string").withColumn("purchase_timestamp", F.col("d").cast("timestamp_ntz")).drop("d")
    items = spark.createDataFrame(
        [(1, 7, 5, 0.123456, 0.1, 2.0, "shipped"), (2, 7, 5, 10.0, 0.25, 1.0, "shipped"), (3, 8, 6, 1.0, 0.0, 1.0, "x")],
        "order_id long, product_id long, seller_id long, price double, freight_value double, quantity double, order_status string"
    ).withColumn("delivered_customer_date", F.lit("2020-01-03").cast("timestamp_ntz"))
    reviews = spark.createDataFrame([(1, 4)], "order_id long, score int")
    return orders, items, reviews


def test_daily_revenue_by_hand(spark):
    orders, items, _ = _orders_items(spark)
    got = {str(r["date"]): r for r in marts.daily_revenue(orders, items, marts.Roles()).collect()}
    first, second = got["2020-01-01"], got["2020-01-02"]
    # order 2 stands twice (customers 10 and 11): one distinct order, its item joined twice
    assert (first["total_orders"], first["total_items_sold"], first["unique_customers"]) == (2, 3, 2)
    assert first["total_revenue"] == round(0.223456 + 2 * 10.25, 2)
    assert (second["total_orders"], second["unique_customers"], second["total_revenue"]) == (1, 0, 1.0)


def test_order_roles_read_the_orders_column(spark):
    orders, items, reviews = _orders_items(spark)
    seller = {r["seller_id"]: r for r in marts.seller_performance(orders, items, reviews, marts.Roles()).collect()}
    assert seller[5]["cancellation_rate"] == 0.3333 and seller[6]["cancellation_rate"] == 0.0
    of_items = marts.Roles(canceled="price > 5")
    assert {r["seller_id"]: r["cancellation_rate"] for r in marts.seller_performance(orders, items, reviews, of_items).collect()}[5] == 0.6667
    returned = marts.Roles(returned="quantity > 1 AND customer_id = 10")  # items and orders together
    assert {r["product_id"]: r["return_rate"] for r in marts.product_metrics(orders, items, reviews, returned).collect()} == {7: 0.3333, 8: 0.0}


def test_order_totals_at_full_precision(spark):
    items = spark.createDataFrame([(1, 3, 0.00001, 0.5)], "order_id long, quantity int, list_price double, discount double")
    assert float(retail.order_totals(items).first()["total"]) == pytest.approx(0.000015)


def test_status_share_has_no_single_task_window(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("s"))
    plan = kpi.kpi_status_share(df, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert [r["share_pct"] for r in kpi.kpi_status_share(df, "s").collect()] == [33.4, 33.3, 33.3]


# --- odd numbers ----------------------------------------------------------------------

def test_benford_of_nan_infinity_and_text(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (12.0,), (1.23e7,), (None,), (0.5,)], "x double")
    assert {r["digit"]: r["count"] for r in benford.benford_digits(d, "x").collect() if r["count"]} == {1: 2}
    t = spark.createDataFrame([("05",), ("+7.5",), (" 3",), ("abc",), ("NaN",), ("",), ("1e3",), ("0.9",)], "x string")
    assert {r["digit"]: r["count"] for r in benford.benford_digits(t, "x").collect() if r["count"]} == {1: 1, 3: 1, 5: 1, 7: 1}
    assert benford.benford_summary(d, "x").first()["total_values_analyzed"] == 2


# --- freshness ------------------------------------------------------------------------

def test_freshness_column_is_picked_by_whole_name_parts(spark):
    for name, want in (("contents", None), ("created_at", "created_at"), ("updatedAt", "updatedAt"), ("hats", None), ("ts", "ts"), ("candidate", None), ("order_date", "order_date")):
        df = spark.createDataFrame([("x",)], f"{name} string")
        assert report.pick_timestamp_column(df) == want, name


def test_text_that_never_parses_is_no_timestamp(spark):
    bad = spark.createDataFrame([("x",)], "created_at string")
    good = spark.createDataFrame([("2020-01-01",), ("oops",)], "created_at string")
    got = {r["table_name"]: r for r in report.quality_report({"bad": bad, "good": good}, {}, None, "2020-01-03 00:00:00").collect()}
    assert got["bad"]["freshness_column"] is None and got["bad"]["freshness_age_days"] is None
    assert got["good"]["freshness_column"] == "created_at" and got["good"]["freshness_age_days"] == 2.0


# --- keys -----------------------------------------------------------------------------

def test_null_keys_in_constraints(spark):
    t = spark.createDataFrame([(1, 1), (None, None), (2, None), (2, 2)], "a int, b int")
    cons = constraints_frame(spark, [("t", "pk", "p", 1, "a", None, None, None), ("t", "unique", "u", 1, "b", None, None, None)])
    got = {r["kind"]: r["violations"] for r in catalog.constraints_summary({"t": t}, cons).collect()}
    assert got == {"pk": 2, "unique": 0}  # one null key and one repeated key; two nulls are not equal


def test_names_with_dots(spark):
    t = spark.createDataFrame([(1, 2.0), (1, 3.0)], "`a.b` int, `c d` double")
    assert keys.pk_uniqueness(t, ["a.b"]).first()["duplicate_rows"] == 1
    assert keys.orphan_counts(t, t.limit(0), ["a.b"], ["a.b"]).first()["orphan_rows"] == 2
    cons = constraints_frame(spark, [("t", "pk", "p", 1, "a.b", None, None, None), ("t", "not_null", "n", 1, "c d", None, None, None)])
    assert {r["kind"]: r["violations"] for r in catalog.constraints_summary({"t": t}, cons).collect()} == {"pk": 1, "not_null": 0}
    from tablescope.operators import correlation
    assert len(correlation.correlation_matrix(t).collect()) == 4


def test_column_stats_of_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, 1), ({"b": 2, "a": 1}, 2), (None, 3)], "m map<string,int>, x int")
    got = {r["column_name"]: r for r in profile.column_stats(df).collect()}
    assert got["m"]["distinct_count"] == 1 and got["m"]["min_typed"] is None and got["x"]["max_typed"] == "3"


# --- upsert ---------------------------------------------------------------------------

@pytest.mark.parametrize("mode,want", [
    ("replace", [(None, "n2", 9), (1, "b", 2), (2, "y", 0)]),
    ("ignore", [(None, "n", 0), (1, "a", 1), (2, "y", 0)]),
    ("update", [(None, "n", 9), (1, "a", 2), (2, "y", 0)]),
])
def test_upsert_with_null_and_repeated_keys(spark, mode, want):
    ddl = "k int, v string, n int"
    base = spark.createDataFrame([(1, "a", 1), (None, "n", 0)], ddl)
    upd = spark.createDataFrame([(1, "old", 1), (1, "b", 2), (None, "n2", 9), (2, "y", 0)], ddl)
    key = lambda r: (r[0] is not None, r)
    once = upsert(base, upd, ["k"], mode, ["n"], order_by=["n"])
    assert sorted((tuple(r) for r in once.collect()), key=key) == want
    assert sorted((tuple(r) for r in upsert(once, upd, ["k"], mode, ["n"], order_by=["n"]).collect()), key=key) == want
    with pytest.raises(Exception, match="more than one row of a key"):
        upsert(base, upd, ["k"], mode).collect()


# --- guarded SQL ----------------------------------------------------------------------

def test_guarded_sql_refuses_reflection_and_files(spark):
    register_views({"tt": spark.createDataFrame([(1,)], "x int"), "orders": spark.read.parquet(f"{SF}/orders.parquet")})
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.Math', 'abs', -1)",
                "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')", f"SELECT * FROM parquet.`{SF}/orders.parquet`",
                "SELECT (SELECT max(reflect('java.lang.System', 'getProperty', 'user.home')) FROM tt)",
                f"WITH c AS (SELECT * FROM parquet.`{SF}/orders.parquet`) SELECT * FROM c a JOIN c b ON a.o_orderkey = b.o_orderkey"):
        with pytest.raises(UnsafeQueryError):
            safe_sql(spark, bad)
    assert safe_sql(spark, "SELECT 'reflect' AS r FROM tt").collect() == [("reflect",)]
    assert safe_sql(spark, "WITH c AS (SELECT * FROM orders) SELECT count(*) FROM c").first()[0] == 1500


# --- folders, samples, snapshots ------------------------------------------------------

def test_tables_of_a_folder_are_found(spark, tmp_path):
    for name in ("alpha.parquet", "beta"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    shutil.copy(f"{SF}/region.parquet", f"{tmp_path}/gamma.parquet")
    os.mkdir(f"{tmp_path}/_temporary")
    for source in (str(tmp_path), f"file://{tmp_path}", f"file://{tmp_path}/"):
        assert list_tables(spark, source) == ["alpha", "beta", "gamma"]
        assert {n: df.count() for n, df in load_tables(spark, source).items()} == {"alpha": 3, "beta": 3, "gamma": 5}


def test_sample_rows_gives_what_is_asked_for(spark):
    assert sample_rows(spark.range(100), 50).count() == 50
    assert sample_rows(spark.range(100), 50, cap=20).count() == 20


def test_saving_a_snapshot_twice_keeps_one(spark, tmp_path):
    cols = catalog.schema_columns({"t": spark.range(1)})
    for _ in range(2):
        sinks.save_snapshot(cols, f"{tmp_path}/s", "v1")
    sinks.save_snapshot(cols, f"{tmp_path}/s", "v2")
    assert sinks.load_snapshot(spark, f"{tmp_path}/s", "v1").count() == 1 and spark.read.parquet(f"{tmp_path}/s").count() == 2


def test_a_missing_query_module_is_an_error(monkeypatch):
    monkeypatch.setattr(registry, "_MODULES", ("no_such_queries",))
    with pytest.raises(ModuleNotFoundError):
        registry.queries()


# --- schemas and changes --------------------------------------------------------------

def test_nullability_and_key_changes_are_seen(spark):
    from pyspark.sql import types as T

    def cols(nullable, pk):
        df = spark.createDataFrame([(1, 2)], T.StructType([T.StructField("a", T.IntegerType(), nullable), T.StructField("b", T.IntegerType(), True)]))
        cons = constraints_frame(spark, [("t", "pk", "p", 1, pk, None, None, None)])
        return catalog.columns_df({"t": df}, cons)

    base, nulls, keyed = cols(False, "a"), cols(True, "a"), cols(False, "b")
    hashes = [catalog.schema_fingerprint(c).first()["schema_hash"] for c in (base, nulls, keyed, cols(False, "a"))]
    assert len(set(hashes)) == 3 and hashes[0] == hashes[3]
    assert [(r["column_name"], r["change"]) for r in catalog.schema_diff(base, nulls).collect()] == [("a", "nullability_changed")]
    assert rows(catalog.schema_diff(base, keyed).select("column_name", "change")) == [("a", "key_changed"), ("b", "key_changed")]
    assert catalog.schema_diff(base, cols(False, "a")).collect() == []


def test_impact_of_changes_by_hand(spark):
    old = {"t": spark.createDataFrame([(1.5, "x", 1), (2.0, None, 2), (None, "y", 3)], "q double, gone string, same int")}
    new = {"t": old["t"].withColumn("q", F.col("q").cast("int")).drop("gone").withColumn("added", F.lit(1))}
    assert rows(catalog.change_impact(old, new)) == [("t", "added", 3), ("t", "gone", 2), ("t", "q", 1)]


def test_tables_of_several_schemas(spark):
    one = spark.range(2)
    t = {"sales.orders": one, "stage.orders": spark.range(3), "plain": spark.range(1)}
    assert rows(catalog.tables_overview(t)) == [("main", "plain", 1, 1), ("sales", "sales.orders", 2, 1), ("stage", "stage.orders", 3, 1)]
    cons = constraints_frame(spark, [("sales.orders", "pk", "p", 1, "id", None, None, None)])
    snap = {r["table_name"]: r for r in catalog.schema_snapshot(t, cons).collect()}
    assert snap["sales.orders"]["schema_name"] == "sales" and snap["sales.orders"]["primary_keys"] == ["id"]
    assert snap["plain"]["schema_name"] == "main" and snap["stage.orders"]["row_count"] == 3


def test_roles_of_tables_by_name():
    roles = kpi.match_table_roles(["orders", "order_items", "app_users", "customers", "products", "vendors", "ratings", "order_item_log", "transactions"])
    assert roles == {"orders": "orders", "products": "products", "customers": "customers", "sellers": "vendors", "reviews": "ratings",
                     "order_items": "order_item_log", "payments": "transactions"}


def test_percentiles_with_hot_values_and_odd_sizes(spark):
    from tablescope.functions.quantiles import exact_percentiles
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for data in ([], [3.0], [1.0, 2.0], [5.0] * 900 + [float(i) for i in range(100)], [float(i * i % 977) for i in range(1000)]):
        df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x double")
        got = spark.range(1).select(exact_percentiles(df, "x", probs, accuracy=50)).first()[0]
        want = df.agg(F.percentile("x", F.array(*map(F.lit, probs)))).first()[0]
        assert got == pytest.approx(want) if data else got is None or got == [None] * 5


def test_days_whose_sum_of_microseconds_passes_a_bigint(spark, tmp_path):
    from tablescope.operators import incremental_marts

    days = 73_000_000  # 6.3e18 microseconds; two such spans pass 9.2e18
    orders = spark.createDataFrame([(1, 1), (2, 1)], "o long, c long").withColumn("st", F.lit("F")).withColumn("ts", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    items = spark.createDataFrame([(1, 7, 1.0), (2, 7, 2.0)], "io long, seller long, price double").withColumn("at", F.expr(f"timestampadd(DAY, {days}, TIMESTAMP_NTZ '1970-01-01')"))
    got = kpi.kpi_derived(orders, items, "o", "io", "price", "price", "ts", "at").first()
    assert (got["orders_with_items"], got["avg_delivery_days"]) == (2, float(days))
    roles = marts.Roles(order_key="o", customer_key="c", order_status="st", purchase_ts="ts", order_total="c", item_order_key="io", item_product_key="io", item_seller_key="seller",
                        item_price="price", item_freight="price", item_quantity="price", item_delivered_ts="at", canceled="st = 'C'", returned="st = 'R'", review_order_key="o", review_score="score")
    reviews = spark.createDataFrame([], "o long, score int")
    assert marts.seller_performance(orders, items, reviews, roles).first()["avg_delivery_days"] == float(days)
    path = str(tmp_path / "s")
    incremental_marts.refresh(path, orders, items, reviews, roles)
    assert incremental_marts.sellers(incremental_marts.load_states(spark, path)).first()["avg_delivery_days"] == float(days)

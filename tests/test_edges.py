"""Edge semantics on hand-computed micro-frames."""

import math

import pytest
from pyspark.sql import functions as F

from tablescope.operators import benford, catalog, correlation, distribution, keys, lineage, marts, outliers, profile
from tablescope.operators.constraints import constraints_frame, foreign_keys
from tablescope.sources.sql import UnsafeQueryError, safe_sql
from tablescope.sources.upsert import upsert


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x DOUBLE")
    r = one(profile.column_nulls(df))
    assert r.total_rows == 0 and r.null_count == 0 and r.null_rate is None
    c = profile.table_completeness(df).collect()
    assert c[0].overall_completeness == 1.0 and c[0].null_rate == 0.0
    assert profile.quality_overview({"e": df}).count() == 0  # empty tables are skipped
    d = one(distribution.distribution_stats(df, "x"))
    assert d.total_rows == 0 and d.p10 is None


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x DOUBLE")
    r = one(profile.column_nulls(df))
    assert (r.total_rows, r.null_count, r.null_rate) == (2, 2, 1.0)
    s = one(profile.column_stats(df))
    assert s.distinct_count == 0 and s.mean_value is None and s.min_value is None
    assert profile.table_completeness(df).collect()[0].overall_completeness == 0.0


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a DOUBLE, b DOUBLE")
    z = one(outliers.outliers_zscore(df, "a"))
    assert z.outlier_count == 0 and z.stddev == 0.0 and z.note is not None
    d = one(distribution.distribution_stats(df, "a"))
    assert d.skewness == 0.0 and d.kurtosis == 0.0 and d.skewness_interpretation == "symmetric (none)"
    m = {(r.column_1, r.column_2): r.correlation for r in correlation.correlation_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] == 0.0 and m[("a", "a")] == 1.0 and m[("b", "a")] == 0.0


def test_one_row_has_null_stddev(spark):
    df = spark.createDataFrame([(1.0,)], "x DOUBLE")
    s = one(profile.column_stats(df))
    assert s.mean_value == 1.0 and s.std_dev is None


def test_null_keys_count_as_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (None, None)], "a INT, b INT")
    r = one(keys.pk_uniqueness(df, ["a", "b"]))
    assert (r.total_rows, r.unique_pk_rows, r.uniqueness_rate) == (4, 3, 0.75)


def test_pairwise_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 7.0), (4.0, 1.0)], "a DOUBLE, b DOUBLE")
    m = {(r.column_1, r.column_2): r.correlation for r in correlation.correlation_matrix(df).collect()}
    assert m[("a", "b")] == -0.0524
    assert m[("a", "b")] == m[("b", "a")]


def test_mixed_text_has_no_moments(spark):
    df = spark.createDataFrame([("1",), ("x",)], "x STRING")
    s = one(profile.column_stats(df))
    assert s.mean_value is None and s.std_dev is None and s.distinct_count == 2


def test_text_min_max_is_lexicographic(spark):
    df = spark.createDataFrame([(9.0,), (50.0,)], "x DOUBLE")
    s = one(profile.column_stats(df))
    assert (s.min_value, s.max_value) == ("50.0", "9.0")
    assert (s.min_typed, s.max_typed) == ("9.0", "50.0")


def test_benford_guard_and_absent_digits(spark):
    df = spark.createDataFrame([(0.5,), (0.00012,), (1.0,), (12.0,), (1.23e7,)], "x DOUBLE")
    rows = {r.digit: r for r in benford.benford_digits(df, "x").collect()}
    assert len(rows) == 9 and rows[1]["count"] == 3 and sum(r["count"] for r in rows.values()) == 3
    assert rows[2]["count"] == 0 and rows[2].deviation == -17.6
    s = one(benford.benford_summary(df, "x"))
    assert s.total_values_analyzed == 3 and s.digits_observed == 1
    assert s.chi_square_full > s.chi_square_statistic


def test_zero_percentile_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,)], "x DOUBLE")
    d = one(distribution.distribution_stats(df, "x"))
    assert d.p10 == 0.0 and d.p25 == 0.0 and d.median == 0.0


def test_skew_kurtosis_match_sample_sd_formula(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0, 4.5]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    d = one(distribution.distribution_stats(df, "x"))
    n = len(xs)
    mean = sum(xs) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1))
    skew = sum((x - mean) ** 3 for x in xs) / n / sd ** 3
    kurt = sum((x - mean) ** 4 for x in xs) / n / sd ** 4 - 3
    assert d.skewness == pytest.approx(round(skew, 4), abs=1e-4)
    assert d.kurtosis == pytest.approx(round(kurt, 4), abs=1e-4)


def test_iqr_fences_are_strict(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x DOUBLE")
    r = one(outliers.outliers_iqr(df, "x"))
    assert (r.q1, r.q3, r.iqr) == (3.0, 7.0, 4.0)
    assert (r.lower_bound, r.upper_bound, r.outlier_count) == (-3.0, 13.0, 1)


def _fk_frames(spark):
    parent = spark.createDataFrame([(1, 1), (1, 2)], "a INT, b INT")
    child = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (None, 2)], "a INT, b INT")
    cons = constraints_frame(spark, [
        ("parent", "pk", "parent_pk", 1, "a", None, None, None),
        ("parent", "pk", "parent_pk", 2, "b", None, None, None),
        ("child", "fk", "child_fk", 1, "a", "parent", "a", None),
        ("child", "fk", "child_fk", 2, "b", "parent", "b", None),
    ])
    return {"parent": parent, "child": child}, cons


def test_composite_fk(spark):
    t, cons = _fk_frames(spark)
    fks = foreign_keys(cons)
    assert len(fks) == 1 and fks[0].pairs == [("a", "a"), ("b", "b")]
    r = one(keys.referential_integrity(t, fks))
    assert (r.child_rows, r.null_fk_rows, r.orphan_rows, r.orphan_keys, r.result) == (4, 1, 1, 1, "fail")
    edges = lineage.lineage_edges(cons).collect()
    assert sorted(e.label for e in edges) == ["a → a", "b → b"]
    cs = {r.kind: r.violations for r in catalog.constraints_summary(t, cons).collect()}
    assert cs == {"pk": 0, "fk": 1}


def test_two_reviews_fan_out(spark):
    orders = spark.createDataFrame([(1, 10, "F", "2024-01-01 00:00:00")], "order_id INT, customer_id INT, order_status STRING, ts STRING") \
        .withColumn("purchase_timestamp", F.col("ts").cast("timestamp_ntz"))
    items = spark.createDataFrame([(1, 100, 7, 10.0), (1, 101, 7, 20.0)], "order_id INT, product_id INT, seller_id INT, price DOUBLE") \
        .withColumn("quantity", F.lit(1)).withColumn("freight_value", F.lit(0.0)) \
        .withColumn("delivered_customer_date", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    reviews = spark.createDataFrame([(1, 5), (1, 3)], "order_id INT, score INT")
    roles = marts.Roles()
    lit_join = one(marts.seller_performance(orders, items, reviews, roles))
    deduped = one(marts.seller_performance(orders, items, reviews, roles, dedupe_reviews=True))
    assert lit_join.total_revenue == 60.0 and deduped.total_revenue == 30.0
    assert lit_join.avg_review_score == 4.0 and deduped.avg_delivery_days == 2.0


def test_upsert_modes_and_idempotence(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k INT, v STRING, n INT")
    upd = spark.createDataFrame([(2, "B", 21), (3, "C", 30)], "k INT, v STRING, n INT")
    rep = sorted(tuple(r) for r in upsert(base, upd, ["k"], "replace").collect())
    assert rep == [(1, "a", 10), (2, "B", 21), (3, "C", 30)]
    ign = sorted(tuple(r) for r in upsert(base, upd, ["k"], "ignore").collect())
    assert ign == [(1, "a", 10), (2, "b", 20), (3, "C", 30)]
    part = sorted(tuple(r) for r in upsert(base, upd, ["k"], "update", ["n"]).collect())
    assert part == [(1, "a", 10), (2, "b", 21), (3, "C", 30)]
    twice = upsert(upsert(base, upd, ["k"], "replace"), upd, ["k"], "replace")
    assert sorted(tuple(r) for r in twice.collect()) == rep


def test_schema_diff_and_fingerprint(spark):
    old = spark.createDataFrame([(1, "a", 1.0)], "id INT, name STRING, amount DOUBLE")
    new = spark.createDataFrame([(1, "a", 1, True)], "id INT, name STRING, amount INT, flag BOOLEAN").drop("name")
    oc, nc = catalog.schema_columns({"t": old}), catalog.schema_columns({"t": new})
    d = {r.column_name: r.change for r in catalog.schema_diff(oc, nc).collect()}
    assert d == {"name": "removed", "amount": "type_changed", "flag": "added"}
    more_rows = catalog.schema_columns({"t": old.union(old)})
    h1 = one(catalog.schema_fingerprint(oc)).schema_hash
    assert h1 == one(catalog.schema_fingerprint(more_rows)).schema_hash  # data change is not a schema change
    assert h1 != one(catalog.schema_fingerprint(nc)).schema_hash


@pytest.mark.parametrize("sql,ok", [
    ("SELECT 1 AS x", True),
    ("WITH a AS (SELECT 1 AS x) SELECT * FROM a", True),
    ("SELECT 'DELETE x' AS s", True),
    ("SELECT 1 AS x -- trailing comment", True),
    ("SELECT 1 AS x;", True),
    ("DROP TABLE t", False),
    ("INSERT INTO t VALUES (1)", False),
    ("SET spark.sql.ansi.enabled=false", False),
    ("SELECT 1; DROP TABLE t", False),
])
def test_sql_guard(spark, sql, ok):
    if ok:
        assert safe_sql(spark, sql, limit=5).count() == 1
    else:
        with pytest.raises(UnsafeQueryError):
            safe_sql(spark, sql, limit=5).collect()


def test_null_count_invariant(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (3, "y")], "a INT, b STRING")
    for r in profile.column_profile(df).collect():
        assert r.null_count + df.where(F.col(r.column_name).isNotNull()).count() == r.total_rows


@pytest.mark.parametrize("column", ["value", "ts_key"])
def test_distributed_percentiles_match_builtin(spark, column):
    from tablescope.functions.quantiles import exact_percentiles
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("ts_key", F.col("user_id") % 7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    mine = spark.range(1).select(exact_percentiles(ev, column, probs, accuracy=1000)).first()[0]
    ref = ev.agg(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(mine, ref))


def test_iqr_methods_agree(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x DOUBLE")
    a = one(outliers.outliers_iqr(df, "x", method="map"))
    b = one(outliers.outliers_iqr(df, "x", method="exact"))
    assert (a.q1, a.q3, a.outlier_count) == (b.q1, b.q3, b.outlier_count)


def test_distinct_modes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    exact = {r.column_name: r.distinct_count for r in profile.column_profile(docs, metrics=("distinct",)).collect()}
    builtin = docs.agg(*[F.count_distinct(c).alias(c) for c in docs.columns]).first().asDict()
    approx = {r.column_name: r.distinct_count
              for r in profile.column_profile(docs, metrics=("distinct",), distinct="approx").collect()}
    assert exact == builtin
    assert all(abs(approx[k] - v) <= 0.2 * v + 2 for k, v in exact.items())


def test_catalog_listings(spark):
    t = {"a": spark.createDataFrame([(1,)], "x INT"), "b": spark.createDataFrame([(1,), (2,)], "y INT")}
    g = one(catalog.tables_by_schema(catalog.tables_overview(t)))
    assert (g.schema_name, g.tables, g.table_count, g.total_rows) == ("main", ["a", "b"], 2, 3)
    names = {r.schema_name for r in catalog.schemas_df(spark).collect()}
    assert "default" in names and "information_schema" not in names


def test_tables_of_two_schemas_stay_apart(spark):
    t = {n: spark.range(k).toDF("x") for n, k in (("sales.orders", 3), ("sales.items", 0), ("hr.orders", 2), ("loose", 1))}
    got = {r.schema_name: (r.tables, r.table_count, r.total_rows) for r in catalog.tables_by_schema(catalog.tables_overview(t)).collect()}
    assert got == {"sales": (["sales.items", "sales.orders"], 2, 3), "hr": (["hr.orders"], 1, 2), "main": (["loose"], 1, 1)}
    assert catalog.tables_overview(t).where("schema_name = 'hr'").first().table_name == "hr.orders"


def test_upsert_versioned_round_trip(spark, tmp_path):
    from tablescope.sources.upsert import upsert_versioned
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    p0 = str(tmp_path / "v0")
    base.write.parquet(p0)
    upd = spark.createDataFrame([(2, "B"), (3, "C")], "k INT, v STRING")
    p1 = upsert_versioned(spark, p0, upd, ["k"], str(tmp_path / "t"), "1")
    again = upsert_versioned(spark, p0, upd, ["k"], str(tmp_path / "t"), "1")  # retried job: same result
    assert p1 == again
    assert sorted(tuple(r) for r in spark.read.parquet(p1).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    assert spark.read.parquet(p0).count() == 2


def test_pick_timestamp_column(spark):
    from tablescope.operators.report import pick_timestamp_column, quality_report
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    assert pick_timestamp_column(ev) == "ts" and pick_timestamp_column(li) == "l_shipdate"
    assert pick_timestamp_column(nation) is None
    rep = {r.table_name: r for r in quality_report({"events": ev, "nation": nation}, {}, None,
                                                   "2024-02-01 00:00:00").collect()}
    assert rep["events"].freshness_column == "ts" and rep["nation"].freshness_column is None


def test_string_timestamp_column_freshness(spark):
    from tablescope.operators.report import pick_timestamp_column, table_quality
    df = spark.createDataFrame([("a", "2024-01-30 00:00:00"), ("b", "2024-01-31 12:00:00")], "id STRING, created_at STRING")
    assert pick_timestamp_column(df) == "created_at"
    r = one(table_quality(df, "t", ["id"], "created_at", "2024-02-01 00:00:00"))
    assert r.freshness_age_days == 0.5 and r.pk_uniqueness_rate == 1.0


def test_public_helpers(spark):
    from tablescope.operators.kpi import first_matching_column
    from tablescope.sources.payload import payload_field
    from tablescope.sources.sql import safe_sql_result
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert first_matching_column(orders, ["price", "value", "amount"]) == "o_totalprice"
    assert first_matching_column(orders, ["nothing"]) is None
    orders.createOrReplaceTempView("orders_helpers")
    r = safe_sql_result(spark, "SELECT o_orderstatus FROM orders_helpers", limit=2)
    assert r["row_count"] == 2 and r["truncated"] is True and r["columns"] == ["o_orderstatus"]
    r = safe_sql_result(spark, "SELECT DISTINCT o_orderstatus FROM orders_helpers", limit=10)
    assert r["row_count"] == 3 and r["truncated"] is False
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ev.select(payload_field("props", "$.k").cast("int").alias("k")).where("k IS NULL").count() == 0
    t, cons = _fk_frames(spark)
    fk = catalog.foreign_keys_df(cons).orderBy("position").collect()
    assert [(r.column_name, r.ref_column) for r in fk] == [("a", "a"), ("b", "b")]


def test_correlation_matches_numpy_in_one_scan(spark):
    import numpy as np
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    wide = li.select(*[(F.col("l_extendedprice") * (i + 1) + F.pow("l_tax", F.lit(i % 3 + 1)) * 1e6 * i).alias(f"c{i}") for i in range(38)],
                     F.lit(1.0).alias("flat"), F.when(F.col("l_linenumber") > 2, F.col("l_discount") + 1e9).alias("holes"))
    for cols in (wide.columns, ["c1", "holes", "flat"]):
        df = correlation.correlation_long(wide, cols)
        got = {(r.column_1, r.column_2): r.r for r in df.collect()}
        x = np.array([[np.nan if v is None else v for v in r] for r in wide.select(*cols).collect()], float)
        assert len(got) == len(cols) * (len(cols) - 1) // 2
        for i, a in enumerate(cols):
            for j in range(i + 1, len(cols)):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                u, w = x[both, i], x[both, j]
                want = 0.0 if "flat" in (a, cols[j]) else np.corrcoef(u, w)[0, 1]
                assert abs(got[a, cols[j]] - want) < 1e-7, (a, cols[j])
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1
    odd = spark.createDataFrame([(1.0, 2.0), (2.0, float("nan")), (None, float("inf")), (4.0, 9.0)], "a double, b double")
    assert correlation.correlation_long(odd).first().r != correlation.correlation_long(odd).first().r  # NaN
    assert [r.r for r in correlation.correlation_long(odd.limit(0)).collect()] == [0.0]


def test_sample_rows_skips_unorderable_columns(spark):
    from tablescope.sources.tables import sample_rows
    df = spark.createDataFrame([(2, {"a": 1}), (1, {"b": 2}), (3, None)], "id INT, m MAP<STRING, INT>")
    assert [r.id for r in sample_rows(df, 2).collect()] == [1, 2]
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sample_rows(emb, 50).count() == 50  # no cap of its own


def test_column_counts_of_odd_values(spark):
    df = spark.createDataFrame([(0.0, [1.0], {"a": 1}, None), (-0.0, [1.0], {"a": 1}, None), (float("nan"), None, None, None),
                                (float("nan"), [2.0], {"a": 2}, None)], "d DOUBLE, a ARRAY<DOUBLE>, m MAP<STRING,INT>, n STRING")
    got = {r.column_name: (r.total_rows, r.null_count, r.distinct_count) for r in profile.column_counts(df).collect()}
    assert got == {"d": (4, 0, 2), "a": (4, 1, 2), "m": (4, 1, 2), "n": (4, 4, 0)}
    assert all((r.total_rows, r.null_count, r.distinct_count) == (0, 0, 0) for r in profile.column_counts(df.limit(0)).collect())

"""Registered KPI, mart, upsert, source and retail queries with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablescope.operators import heavy_groups, incremental_marts, kpi, marts, retail
from tablescope.plans import bindings as B
from tablescope.plans.base import R, q, query, tables, union_all
from tablescope.session import shared_dir
from tablescope.sources.payload import parse_payload, serialisable
from tablescope.sources.sql import safe_sql
from tablescope.sources.tables import list_tables, register_views, sample_rows
from tablescope.sources.upsert import upsert, upsert_partitions

ROLES = B.ROLES
REVIEWS_SQL = ("(SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS score "
               "FROM orders WHERE o_orderstatus = 'F')")


def UNITS(e: str) -> str:
    """Sum of money in whole millionths: exact in HUGEINT, independent of how the
    implementation represents it."""
    return f"sum(CAST(round(({e}) * 1000000.0) AS HUGEINT))"


def USUM(e: str) -> str:
    return f"(CAST({UNITS(e)} AS DOUBLE) / 1000000.0)"


def UAVG(e: str) -> str:
    return f"({USUM(e)} / CAST(count({e}) AS DOUBLE))"


def DAYS(a: str, b: str) -> str:
    """SQL twin of ``age_days``: (b - a) in days with microsecond precision."""
    return f"((epoch_us({b}) - epoch_us({a})) / 86400000000.0)"


def AVG_DAYS(a: str, b: str) -> str:
    """SQL twin of ``avg_days``: exact micros sum / count / 86400e6."""
    return (f"(CAST(sum(epoch_us({b}) - epoch_us({a})) AS DOUBLE) / "
            f"CAST(count(epoch_us({b}) - epoch_us({a})) AS DOUBLE) / 86400000000.0)")


# --- K1-K15 ---------------------------------------------------------------------------

@query("kpi_orders", "SELECT count(*) AS total_orders, count(DISTINCT o_custkey) AS unique_customers FROM orders")
def q_kpi_orders(spark, sf):
    return kpi.kpi_orders(tables(spark, sf, "orders")["orders"], "o_custkey")


@query("kpi_status_share", f"""SELECT o_orderstatus AS status, count(*) AS order_count,
  {R('CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE)', 2)} AS share_pct
FROM orders GROUP BY o_orderstatus""")
def q_kpi_status_share(spark, sf):
    return kpi.kpi_status_share(tables(spark, sf, "orders")["orders"], "o_orderstatus")


@query("kpi_revenue", f"""SELECT {R(f"coalesce({USUM('l_extendedprice')}, 0)", 2)} AS total_revenue,
  {R(f"coalesce({USUM('l_extendedprice')} / count(l_extendedprice), 0)", 2)} AS avg_item_price FROM lineitem""")
def q_kpi_revenue(spark, sf):
    return kpi.kpi_revenue(tables(spark, sf, "lineitem")["lineitem"], "l_extendedprice")


ENTITIES = [("products", "part"), ("sellers", "supplier"), ("customers", "customer"), ("orders", "orders")]


@query("kpi_entity_counts", union_all(
    [f"SELECT {q(e)} AS entity, count(*) AS entity_count, 14 AS total_tables FROM {t}" for e, t in ENTITIES]
    + [f"SELECT 'reviews' AS entity, count(*) AS entity_count, 14 AS total_tables FROM {REVIEWS_SQL}"]))
def q_kpi_entity_counts(spark, sf):
    t = tables(spark, sf, "part", "supplier", "customer", "orders")
    ents = {e: t[n] for e, n in ENTITIES}
    ents["reviews"] = B.reviews(t["orders"])
    return kpi.kpi_entity_counts(ents, len(list_tables(spark, sf)))


@query("kpi_score_distribution", f"""WITH r AS {REVIEWS_SQL}
SELECT score, count(*) AS review_count, (SELECT count(*) FROM r) AS total_reviews,
  (SELECT {R('coalesce(avg(score), 0)', 2)} FROM r) AS avg_review_score
FROM r WHERE score IS NOT NULL GROUP BY score""")
def q_kpi_score_distribution(spark, sf):
    return kpi.kpi_score_distribution(B.reviews(tables(spark, sf, "orders")["orders"]), "score")


@query("kpi_category_top5", """SELECT coalesce(CAST(o_orderpriority AS VARCHAR), 'None') AS category,
  count(*) AS row_count FROM orders GROUP BY 1 ORDER BY row_count DESC, category LIMIT 5""")
def q_kpi_category_top5(spark, sf):
    return kpi.kpi_category_top(tables(spark, sf, "orders")["orders"], "o_orderpriority", 5)


@query("kpi_derived", f"""WITH po AS (
  SELECT l_orderkey AS ok, {UNITS('l_extendedprice')} AS v, count(*) AS n,
         {UNITS('l_extendedprice * l_tax')} AS f, max(l_shipdate) AS d FROM lineitem GROUP BY l_orderkey),
j AS (SELECT * FROM orders o JOIN po ON o.o_orderkey = po.ok)
SELECT count(*) AS orders_with_items, {R('CAST(sum(v) AS DOUBLE) / 1000000.0 / count(*)', 2)} AS avg_order_value,
  {R('CAST(sum(n) AS DOUBLE) / count(*)', 4)} AS items_per_order,
  {R(AVG_DAYS('o_orderdate', 'd'), 4)} AS avg_delivery_days,
  {R('CAST(sum(f) AS DOUBLE) / 1000000.0', 2)} AS total_freight FROM j""")
def q_kpi_derived(spark, sf):
    t = tables(spark, sf, "orders", "lineitem")
    return kpi.kpi_derived(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey", "l_extendedprice",
                           "l_extendedprice * l_tax", "o_orderdate", "l_shipdate")


@query("measure_summary", f"""SELECT count(*) AS total_rows,
  {R('coalesce(sum(l_extendedprice), 0)', 2)} AS total_value,
  {R('avg(l_extendedprice)', 2)} AS avg_value FROM lineitem""")
def q_measure_summary(spark, sf):
    return kpi.measure_summary(tables(spark, sf, "lineitem")["lineitem"], "l_extendedprice")


@query("numeric_summary", f"""SELECT count(*) AS total_rows, {R('avg(CAST(l_quantity AS DOUBLE))', 2)} AS avg_l_quantity,
  min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem""")
def q_numeric_summary(spark, sf):
    return kpi.numeric_summary(tables(spark, sf, "lineitem")["lineitem"], "l_quantity")


@query("group_count_topn", """SELECT c_nationkey, count(*) AS row_count FROM customer GROUP BY c_nationkey
ORDER BY row_count DESC, c_nationkey LIMIT 10""")
def q_group_count_topn(spark, sf):
    return kpi.group_count_topn(tables(spark, sf, "customer")["customer"], "c_nationkey", 10)


@query("group_sum_topn", f"""SELECT l_partkey, count(*) AS times_ordered, {R('sum(l_extendedprice)', 2)} AS total_revenue
FROM lineitem GROUP BY l_partkey ORDER BY sum(l_extendedprice) DESC, l_partkey LIMIT 10""")
def q_group_sum_topn(spark, sf):
    return kpi.group_sum_topn(tables(spark, sf, "lineitem")["lineitem"], "l_partkey", "l_extendedprice", 10)


@query("heavy_count_groups", """SELECT l_orderkey, l_shipdate, count(*) AS row_count FROM lineitem GROUP BY l_orderkey, l_shipdate
ORDER BY row_count DESC, l_orderkey, l_shipdate LIMIT 20""")
def q_heavy_count_groups(spark, sf):
    return heavy_groups.heavy_groups(tables(spark, sf, "lineitem")["lineitem"], ["l_orderkey", "l_shipdate"], 20)


@query("heavy_sum_groups", f"""SELECT o_custkey, count(*) AS row_count, {R(USUM('o_totalprice'), 2)} AS total
FROM orders GROUP BY o_custkey ORDER BY {UNITS('o_totalprice')} DESC, o_custkey LIMIT 10""")
def q_heavy_sum_groups(spark, sf):
    return heavy_groups.heavy_groups(tables(spark, sf, "orders")["orders"], ["o_custkey"], 10, "o_totalprice")


@query("group_avg", f"""SELECT o_orderpriority, count(*) AS row_count,
  {R('avg(o_totalprice)', 2)} AS avg_o_totalprice FROM orders GROUP BY o_orderpriority""")
def q_group_avg(spark, sf):
    return kpi.group_avg(tables(spark, sf, "orders")["orders"], "o_orderpriority", "o_totalprice")


@query("monthly_trend", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS row_count
FROM orders GROUP BY 1""")
def q_monthly_trend(spark, sf):
    return kpi.monthly_trend(tables(spark, sf, "orders")["orders"], "o_orderdate")


# --- M1-M4, S7 ------------------------------------------------------------------------

def _m1_sql(order_filter: str = "TRUE", item_filter: str = "TRUE") -> str:
    rev = "l.l_extendedprice + l.l_extendedprice * l.l_tax"
    return (f"SELECT CAST(o.o_orderdate AS DATE) AS date, count(DISTINCT o.o_orderkey) AS total_orders, "
            f"{R(f'coalesce({USUM(rev)}, 0)', 2)} AS total_revenue, "
            f"{R(f'coalesce({USUM(rev)} / count(*), 0)', 2)} AS avg_order_value, "
            f"count(*) AS total_items_sold, count(DISTINCT o.o_custkey) AS unique_customers "
            f"FROM (SELECT * FROM orders WHERE {order_filter}) o "
            f"JOIN (SELECT * FROM lineitem WHERE {item_filter}) l ON o.o_orderkey = l.l_orderkey "
            f"GROUP BY CAST(o.o_orderdate AS DATE)")


@query("mart_daily_revenue", _m1_sql())
def q_mart_daily_revenue(spark, sf):
    t = tables(spark, sf, "orders", "lineitem")
    return marts.daily_revenue(t["orders"], t["lineitem"], ROLES)


def _m23_from() -> str:
    return (f"FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey "
            f"LEFT JOIN {REVIEWS_SQL} r ON r.o_orderkey = o.o_orderkey")


@query("mart_seller_performance", f"""SELECT l.l_suppkey AS seller_id, count(DISTINCT l.l_orderkey) AS total_orders,
  {R(USUM('l.l_extendedprice'), 2)} AS total_revenue, {R('avg(CAST(r.score AS DOUBLE))', 4)} AS avg_review_score,
  {R(AVG_DAYS('o.o_orderdate', 'l.l_shipdate'), 4)} AS avg_delivery_days,
  {R("CAST(sum(CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)", 4)} AS cancellation_rate
{_m23_from()} GROUP BY l.l_suppkey""")
def q_mart_seller_performance(spark, sf):
    t = tables(spark, sf, "orders", "lineitem")
    return marts.seller_performance(t["orders"], t["lineitem"], B.reviews(t["orders"]), ROLES)


@query("mart_product_metrics", f"""SELECT l.l_partkey AS product_id, {R('sum(l.l_quantity)', 4)} AS total_sold,
  {R(USUM('l.l_extendedprice * l.l_quantity'), 2)} AS total_revenue,
  {R(UAVG('l.l_extendedprice'), 4)} AS avg_price,
  {R('avg(CAST(r.score AS DOUBLE))', 4)} AS avg_review_score,
  {R("CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)", 4)} AS return_rate
{_m23_from()} GROUP BY l.l_partkey""")
def q_mart_product_metrics(spark, sf):
    t = tables(spark, sf, "orders", "lineitem")
    return marts.product_metrics(t["orders"], t["lineitem"], B.reviews(t["orders"]), ROLES)


_SEG_DESC = "CASE segment_name " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in marts.SEGMENT_DESCRIPTIONS.items()) + " END"


def _segments_sql(cut: str, vip: str) -> str:
    return f"""WITH per AS (
  SELECT o_custkey, count(*) AS n_orders, {USUM('o_totalprice')} AS spend, max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey),
cut AS ({cut}),
seg AS (SELECT per.*, {vip} AS top, {DAYS('last_order', f"TIMESTAMP {q(B.AS_OF_ORDERS)}")} AS days FROM per, cut),
lab AS (SELECT CASE WHEN days > 365 THEN 'Churned' WHEN days > 180 THEN 'At Risk'
                    WHEN top AND n_orders >= 3 THEN 'VIP' WHEN n_orders = 1 AND days <= 90 THEN 'New'
                    WHEN n_orders >= 2 THEN 'Regular' ELSE 'Other' END AS segment_name, n_orders, spend FROM seg)
SELECT segment_name, count(*) AS customer_count,
  {R(f"{USUM('spend')} / sum(n_orders)", 2)} AS avg_order_value,
  {R('CAST(sum(n_orders) AS DOUBLE) / count(*)', 4)} AS avg_orders_per_customer,
  {R(USUM('spend'), 2)} AS total_revenue, {_SEG_DESC} AS description
FROM lab GROUP BY segment_name"""


@query("mart_customer_segments", _segments_sql("SELECT quantile_cont(spend, 0.9) AS c FROM per", "spend >= c"))
def q_mart_customer_segments(spark, sf):
    return marts.customer_segments(tables(spark, sf, "orders")["orders"], B.AS_OF_ORDERS, ROLES)


@query("mart_customer_segments_ranked", _segments_sql("SELECT 1", "percent_rank() OVER (ORDER BY spend DESC) <= 0.1"))
def q_mart_customer_segments_ranked(spark, sf):
    return marts.customer_segments(tables(spark, sf, "orders")["orders"], B.AS_OF_ORDERS, ROLES, vip_by="percent_rank")


BASE_FILTER = "o_orderdate < TIMESTAMP '2000-01-01 00:00:00'"
UPD_FILTER = "o_orderdate >= TIMESTAMP '1999-07-01 00:00:00'"
UPD_ITEMS = "l_returnflag <> 'R'"


def _upsert_inputs(spark, sf, item_filter: str | None):
    t = tables(spark, sf, "orders", "lineitem")
    o, li = t["orders"], t["lineitem"]
    base = marts.daily_revenue(o.where(F.expr(BASE_FILTER)), li, ROLES)
    upd_items = li.where(F.expr(item_filter)) if item_filter else li
    updates = marts.daily_revenue(o.where(F.expr(UPD_FILTER)), upd_items, ROLES)
    return base, updates


@query("mart_upsert", f"""WITH b AS ({_m1_sql(BASE_FILTER)}), u AS ({_m1_sql(UPD_FILTER)})
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.date = b.date)
UNION ALL SELECT * FROM u""")
def q_mart_upsert(spark, sf):
    base, updates = _upsert_inputs(spark, sf, None)
    return upsert(base, updates, ["date"], mode="replace")


@query("mart_upsert_partial", f"""WITH b AS ({_m1_sql(BASE_FILTER)}), u AS ({_m1_sql(UPD_FILTER, UPD_ITEMS)})
SELECT coalesce(b.date, u.date) AS date,
  CASE WHEN b.date IS NOT NULL THEN b.total_orders ELSE u.total_orders END AS total_orders,
  CASE WHEN u.date IS NOT NULL THEN u.total_revenue ELSE b.total_revenue END AS total_revenue,
  CASE WHEN u.date IS NOT NULL THEN u.avg_order_value ELSE b.avg_order_value END AS avg_order_value,
  CASE WHEN b.date IS NOT NULL THEN b.total_items_sold ELSE u.total_items_sold END AS total_items_sold,
  CASE WHEN b.date IS NOT NULL THEN b.unique_customers ELSE u.unique_customers END AS unique_customers
FROM b FULL OUTER JOIN u ON b.date = u.date""")
def q_mart_upsert_partial(spark, sf):
    base, updates = _upsert_inputs(spark, sf, UPD_ITEMS)
    return upsert(base, updates, ["date"], mode="update", update_cols=["total_revenue", "avg_order_value"])


@query("mart_upsert_partitions", f"""WITH b AS ({_m1_sql(BASE_FILTER)}), u AS ({_m1_sql(UPD_FILTER)})
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.date = b.date)
UNION ALL SELECT * FROM u""")
def q_mart_upsert_partitions(spark, sf):
    """S7 on a table stored by month: only the months of the updates are rewritten."""
    base, updates = _upsert_inputs(spark, sf, None)
    root = f"{shared_dir(spark)}/mart-{uuid.uuid4().hex}"
    for version, rows in enumerate((base, updates)):
        upsert_partitions(spark, f"{root}/table", rows, ["date"], {"month": "date_format(date, 'yyyy-MM')"}, f"{root}/staged", str(version))
    return spark.read.parquet(f"{root}/table").drop("month")


# --- S2, S3, S8, S9 --------------------------------------------------------------------

@query("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_sample_rows(spark, sf):
    return sample_rows(tables(spark, sf, "orders")["orders"], 10, ["o_orderkey"])


GUARDED = ("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) > 0 AS has_value FROM orders "
           "GROUP BY o_orderstatus ORDER BY n DESC -- statuses by volume\n;")


@query("guarded_sql", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) > 0 AS has_value FROM orders "
                      "GROUP BY o_orderstatus ORDER BY n DESC LIMIT 100")
def q_guarded_sql(spark, sf):
    register_views(tables(spark, sf, "orders"))
    return safe_sql(spark, GUARDED, limit=100)


@query("json_payload", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_payload(spark, sf):
    ev = tables(spark, sf, "events")["events"].select("event_id", "event_type", "props")
    return parse_payload(ev, "props", "k BIGINT").drop("props")


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END"


@query("serialised_rows", f"SELECT event_id, {_ISO.format('ts')} AS ts, user_id, event_type, value, props FROM events")
def q_serialised_rows(spark, sf):
    return serialisable(tables(spark, sf, "events")["events"])


# --- R1-R7 ----------------------------------------------------------------------------

_IT = ("it AS (SELECT l_orderkey AS order_id, "
       f"{UNITS('l_quantity * (l_extendedprice / l_quantity) * (1 - l_discount)')} AS total "
       "FROM lineitem GROUP BY l_orderkey)")
_ST = ("pairs AS (SELECT DISTINCT s.s_nationkey AS store_id, l.l_partkey AS product_id FROM lineitem l "
       "JOIN supplier s ON s.s_suppkey = l.l_suppkey), "
       "st AS (SELECT pairs.store_id, pairs.product_id, pt.p_size AS quantity FROM pairs "
       "JOIN part pt ON pt.p_partkey = pairs.product_id)")
_STATUS_CODE = "CASE o.o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 2 WHEN 'P' THEN 1 END"
_STATUS_LABEL = "CASE " + " ".join(f"WHEN {_STATUS_CODE} = {k} THEN {q(v)}" for k, v in retail.ORDER_STATUS.items()) \
    + " END"


def _retail(spark, sf):
    return B.retail_frames(tables(spark, sf, "orders", "lineitem", "customer", "nation", "part", "supplier"))


@query("retail_orders", f"""WITH {_IT}
SELECT o.o_orderkey AS order_id, c.c_name AS customer, n.n_name AS store,
  CAST({_STATUS_CODE} AS INTEGER) AS status_code, {_STATUS_LABEL} AS status,
  {R('coalesce(CAST(it.total AS DOUBLE) / 1000000.0, 0)', 2)} AS total
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN it ON it.order_id = o.o_orderkey""")
def q_retail_orders(spark, sf):
    r = _retail(spark, sf)
    return retail.retail_orders(r["orders"], r["order_items"], r["customers"], r["stores"])


@query("retail_revenue_by_store", f"""WITH {_IT},
j AS (SELECT n.n_name AS store_name, it.total FROM orders o JOIN it ON it.order_id = o.o_orderkey
      LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT CASE WHEN grouping(store_name) = 1 THEN 'ALL' ELSE store_name END AS store,
  grouping(store_name) = 1 AS is_total, {R('CAST(sum(total) AS DOUBLE) / 1000000.0', 2)} AS revenue, count(*) AS orders
FROM j GROUP BY ROLLUP (store_name)""")
def q_retail_revenue_by_store(spark, sf):
    r = _retail(spark, sf)
    return retail.retail_revenue_by_store(r["orders"], r["order_items"], r["stores"])


@query("retail_product_filter", """SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand,
  p_type AS category, p_retailprice AS price FROM part WHERE p_type = 'STANDARD' AND p_brand = 'Brand#13'""")
def q_retail_product_filter(spark, sf):
    r = _retail(spark, sf)
    return retail.retail_product_filter(r["products"], r["brands"], r["categories"], category="STANDARD",
                                        brand="Brand#13")


@query("retail_product_detail", f"""WITH {_ST},
agg AS (SELECT st.product_id, count(*) AS store_count, sum(quantity) AS total_stock,
        string_agg(n.n_name, ',' ORDER BY n.n_name, quantity) AS stores
        FROM st LEFT JOIN nation n ON n.n_nationkey = st.store_id GROUP BY st.product_id)
SELECT p.p_partkey AS product_id, p.p_name AS name, p.p_brand AS brand, p.p_type AS category,
  p.p_retailprice AS list_price, CAST(coalesce(store_count, 0) AS BIGINT) AS store_count,
  CAST(coalesce(total_stock, 0) AS BIGINT) AS total_stock, coalesce(stores, '') AS stores
FROM part p LEFT JOIN agg ON agg.product_id = p.p_partkey""")
def q_retail_product_detail(spark, sf):
    r = _retail(spark, sf)
    d = retail.retail_product_detail(r["products"], r["brands"], r["categories"], r["stocks"], r["stores"])
    return d.select("product_id", "name", F.col("brand.name").alias("brand"), F.col("category.name").alias("category"),
                    "list_price", F.size("stock").cast("bigint").alias("store_count"),
                    F.aggregate("stock", F.lit(0).cast("bigint"), lambda acc, s: acc + s["quantity"])
                    .alias("total_stock"),
                    F.concat_ws(",", F.transform("stock", lambda s: s["store"])).alias("stores"))


@query("retail_category_counts", """SELECT 'category' AS kind, p_type AS id, p_type AS name, count(*) AS product_count
FROM part GROUP BY p_type
UNION ALL SELECT 'brand' AS kind, p_brand AS id, p_brand AS name, count(*) AS product_count FROM part GROUP BY p_brand""")
def q_retail_category_counts(spark, sf):
    r = _retail(spark, sf)
    return retail.retail_category_counts(r["products"], r["categories"], r["brands"])


@query("retail_inventory", f"""WITH {_ST}
SELECT st.store_id, n.n_name AS store, CAST(sum(quantity) AS BIGINT) AS total_items, count(*) AS product_count,
  count(*) FILTER (WHERE quantity < 5) AS low_stock_alerts
FROM st LEFT JOIN nation n ON n.n_nationkey = st.store_id GROUP BY st.store_id, n.n_name""")
def q_retail_inventory(spark, sf):
    r = _retail(spark, sf)
    return retail.retail_inventory(r["stocks"], r["stores"])


@query("retail_low_stock", f"""WITH {_ST}
SELECT st.product_id, p.p_name AS product, st.store_id, n.n_name AS store, st.quantity, 5 AS reorder_point
FROM st LEFT JOIN part p ON p.p_partkey = st.product_id LEFT JOIN nation n ON n.n_nationkey = st.store_id
WHERE st.quantity < 5""")
def q_retail_low_stock(spark, sf):
    r = _retail(spark, sf)
    return retail.retail_low_stock(r["stocks"], r["stores"], r["products"])


# --- marts from stored states ------------------------------------------------------------

def _states(spark, sf, since: str | None = None):
    """States of all orders; with ``since`` those of the orders before it first, then a refresh
    of the months from a month before it on: that month is worked out twice, all others once."""
    t = tables(spark, sf, "orders", "lineitem")
    orders, rest = t["orders"], (t["lineitem"], B.reviews(t["orders"]), ROLES)
    path = f"{shared_dir(spark)}/marts-{uuid.uuid4().hex}"
    incremental_marts.refresh(path, orders.where(F.col("o_orderdate") < F.lit(since).cast("timestamp_ntz")) if since else orders, *rest)
    if since:
        late = orders.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz") - F.expr("INTERVAL 1 MONTH"))
        days = [str(r[0]) for r in late.select(F.to_date("o_orderdate")).distinct().collect()]
        incremental_marts.refresh(path, orders, *rest, days)
    return incremental_marts.load_states(spark, path)


@query("mart_monthly_revenue_states", _m1_sql().replace("CAST(o.o_orderdate AS DATE)", "CAST(date_trunc('month', o.o_orderdate) AS DATE)"))
def q_mart_monthly_revenue_states(spark, sf):
    return incremental_marts.revenue(_states(spark, sf, "2000-01-01 00:00:00"), "trunc(day, 'MM')")


@query("mart_seller_states", f"""SELECT l.l_suppkey AS seller_id, count(DISTINCT l.l_orderkey) AS total_orders,
  {R(USUM('l.l_extendedprice'), 2)} AS total_revenue, {R('avg(CAST(r.score AS DOUBLE))', 4)} AS avg_review_score,
  {R(AVG_DAYS('o.o_orderdate', 'l.l_shipdate'), 4)} AS avg_delivery_days,
  {R("CAST(sum(CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)", 4)} AS cancellation_rate
{_m23_from()} GROUP BY l.l_suppkey""")
def q_mart_seller_states(spark, sf):
    return incremental_marts.sellers(_states(spark, sf))

"""Bindings of the generic operators to the driver's TPC-H-like test tables.

Roles: orders -> orders, items -> lineitem, products -> part, sellers -> supplier,
customers -> customer, stores -> nation. Reviews are derived from orders (one
per finished order, score = first digit of the priority); stocks are derived from
the (part, supplier-nation) pairs that appear in lineitem. All derived frames are
lazy projections/joins of the given tables, so their size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators.constraints import constraints_frame
from tablescope.operators.marts import Roles

AS_OF_EVENTS = "2024-02-01 00:00:00"
AS_OF_ORDERS = "2001-09-01 00:00:00"

ROLES = Roles(
    order_key="o_orderkey",
    customer_key="o_custkey",
    order_status="o_orderstatus",
    purchase_ts="o_orderdate",
    order_total="o_totalprice",
    item_order_key="l_orderkey",
    item_product_key="l_partkey",
    item_seller_key="l_suppkey",
    item_price="l_extendedprice",
    item_freight="l_extendedprice * l_tax",
    item_quantity="l_quantity",
    item_delivered_ts="l_shipdate",
    canceled="o_orderstatus = 'P'",
    returned="l_returnflag = 'R'",
    review_order_key="o_orderkey",
    review_score="score",
)

# Declared keys of the test tables: (table, kind, name, position, column, ref_table, ref_column, expression).
CONSTRAINT_ROWS = [
    ("region", "pk", "region_pk", 1, "r_regionkey", None, None, None),
    ("nation", "pk", "nation_pk", 1, "n_nationkey", None, None, None),
    ("nation", "fk", "nation_region_fk", 1, "n_regionkey", "region", "r_regionkey", None),
    ("customer", "pk", "customer_pk", 1, "c_custkey", None, None, None),
    ("customer", "fk", "customer_nation_fk", 1, "c_nationkey", "nation", "n_nationkey", None),
    ("supplier", "pk", "supplier_pk", 1, "s_suppkey", None, None, None),
    ("supplier", "fk", "supplier_nation_fk", 1, "s_nationkey", "nation", "n_nationkey", None),
    ("part", "pk", "part_pk", 1, "p_partkey", None, None, None),
    ("orders", "pk", "orders_pk", 1, "o_orderkey", None, None, None),
    ("orders", "fk", "orders_customer_fk", 1, "o_custkey", "customer", "c_custkey", None),
    ("lineitem", "pk", "lineitem_pk", 1, "l_orderkey", None, None, None),
    ("lineitem", "pk", "lineitem_pk", 2, "l_linenumber", None, None, None),
    ("lineitem", "fk", "lineitem_orders_fk", 1, "l_orderkey", "orders", "o_orderkey", None),
    ("lineitem", "fk", "lineitem_part_fk", 1, "l_partkey", "part", "p_partkey", None),
    ("lineitem", "fk", "lineitem_supplier_fk", 1, "l_suppkey", "supplier", "s_suppkey", None),
    ("events", "pk", "events_pk", 1, "event_id", None, None, None),
    ("events", "fk", "events_customer_fk", 1, "user_id", "customer", "c_custkey", None),
    ("documents", "pk", "documents_pk", 1, "doc_id", None, None, None),
    ("labels", "pk", "labels_pk", 1, "doc_id", None, None, None),
    ("labels", "fk", "labels_documents_fk", 1, "doc_id", "documents", "doc_id", None),
    ("pages", "pk", "pages_pk", 1, "page_id", None, None, None),
    ("benchmark", "pk", "benchmark_pk", 1, "item_id", None, None, None),
    ("embeddings", "pk", "embeddings_pk", 1, "vec_id", None, None, None),
    ("conversations", "pk", "conversations_pk", 1, "conv_id", None, None, None),
    ("conversations", "pk", "conversations_pk", 2, "turn", None, None, None),
    ("orders", "not_null", "orders_date_nn", 1, "o_orderdate", None, None, None),
    ("orders", "check", "orders_status_ck", 1, "o_orderstatus", None, None, "o_orderstatus IN ('F', 'O', 'P')"),
]

# Timestamp column used for freshness, per table.
TS_COLUMNS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}

# A documents -> labels check (not a declared key) used to show orphans.
DOC_LABEL_FK = ("documents_labels_check", "documents", ("doc_id",), "labels", ("doc_id",))


def constraints(spark: SparkSession) -> DataFrame:
    return constraints_frame(spark, CONSTRAINT_ROWS)


def reviews(orders: DataFrame) -> DataFrame:
    """One review per finished order; score 1-5 from the priority's first digit."""
    return orders.where(F.col("o_orderstatus") == "F").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("score"))


def documents_with_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents LEFT JOIN labels: the frame with real nulls for the null/completeness checks."""
    return documents.join(labels, "doc_id", "left")


# --- retail model over the test tables -------------------------------------------------

def retail_frames(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Retail-model frames derived from the star tables.

    store = nation (of the customer for orders, of the supplier for stock);
    status code F->4 Completed, O->2 Processing, P->1 Pending; stock quantity =
    part size for each (supplier nation, part) pair that occurs in lineitem.
    """
    cust = t["customer"]
    orders = t["orders"].join(cust.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left") \
        .select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                F.col("c_nationkey").alias("store_id"),
                F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 2)
                .when(F.col("o_orderstatus") == "P", 1).alias("order_status"))
    items = t["lineitem"].select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("list_price"), F.col("l_discount").alias("discount"))
    customers = cust.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"),
                            F.lit(None).cast("string").alias("last_name"))
    stores = t["nation"].select(F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("store_name"))
    part = t["part"]
    products = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                           F.col("p_brand").alias("brand_id"), F.col("p_type").alias("category_id"),
                           F.lit(None).cast("int").alias("model_year"), F.col("p_retailprice").alias("list_price"))
    brands = part.select(F.col("p_brand").alias("brand_id"), F.col("p_brand").alias("brand_name")).distinct()
    categories = part.select(F.col("p_type").alias("category_id"), F.col("p_type").alias("category_name")).distinct()
    pairs = t["lineitem"].select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("s_suppkey")) \
        .join(t["supplier"].select("s_suppkey", F.col("s_nationkey").alias("store_id")), "s_suppkey") \
        .select("store_id", "product_id").distinct()
    stocks = pairs.join(part.select(F.col("p_partkey").alias("product_id"), F.col("p_size").alias("quantity")),
                        "product_id").select("store_id", "product_id", "quantity")
    return {"orders": orders, "order_items": items, "customers": customers, "stores": stores,
            "products": products, "brands": brands, "categories": categories, "stocks": stocks}

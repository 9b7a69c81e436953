"""KPI overview and summary queries.

Tables and columns are given explicitly (``Roles``) instead of being guessed
from names; ``first_matching_column`` offers the name-based fallback.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import avg_days, col_of, measure_sum, money, ratio, round_half_up


def first_matching_column(df: DataFrame, patterns: Iterable[str]) -> str | None:
    """K8 fallback: first column (schema order) whose lower-cased name contains a pattern."""
    pats = [p.lower() for p in patterns]
    for f in df.schema.fields:
        if any(p in f.name.lower() for p in pats):
            return f.name
    return None


def kpi_orders(orders: DataFrame, customer: str) -> DataFrame:
    """K1: order count and distinct customers."""
    return orders.agg(F.count(F.lit(1)).alias("total_orders"), F.count_distinct(customer).alias("unique_customers"))


def kpi_status_share(orders: DataFrame, status: str) -> DataFrame:
    """K2: orders per status, count descending, with % share (2 dp).

    The share's denominator is the table's row count, as a scalar: no task sees all
    groups, whatever column is given."""
    g = orders.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("order_count"))
    total = orders.agg(F.count(F.lit(1)).alias("total")).scalar()
    return g.select("status", "order_count", round_half_up(F.col("order_count") * 100.0 / total, 2).alias("share_pct")) \
        .orderBy(F.col("order_count").desc(), "status")


def kpi_revenue(items: DataFrame, price: str | Column) -> DataFrame:
    """K3: total revenue and average item price, 0 when empty, 2 dp."""
    p = money(price, items)
    a = items.agg(F.sum(p).cast("double").alias("__s"), F.count(p).alias("__n"))
    return a.select(round_half_up(F.coalesce("__s", F.lit(0.0)), 2).alias("total_revenue"),
                    round_half_up(F.coalesce(ratio("__s", "__n"), F.lit(0.0)), 2).alias("avg_item_price"))


# Which table plays which part, by fragments of its lower-cased name. Of the
# roles in this order the first that fits is given: its own fragments always fit, the
# others only while no table has the role; a name with an excluded fragment never does.
TABLE_ROLES = {
    "orders": ((), ("order",), ("item",)),
    "customers": (("customer",), ("user",), ()),
    "products": (("product",), ("item",), ()),
    "sellers": (("seller",), ("vendor",), ()),
    "reviews": (("review",), ("rating",), ()),
    "order_items": (("order_item",), ("line_item",), ()),
    "payments": (("payment",), ("transaction",), ()),
}


def match_table_roles(names: Iterable[str]) -> dict[str, str]:
    """K8 fallback for tables: role -> table name, names taken in the order given."""
    found: dict[str, str] = {}
    for name in names:
        low = name.lower()
        has = lambda parts: any(p in low for p in parts)
        for role, (own, other, never) in TABLE_ROLES.items():
            if not has(never) and (has(own) or (has(other) and role not in found)):
                found[role] = name
                break
    return found


def kpi_entity_counts(entities: dict[str, DataFrame], table_count: int) -> DataFrame:
    """K4: row count per business entity (products, sellers, ...), with the number of
    tables of the database."""
    parts = [df.agg(F.count(F.lit(1)).alias("entity_count")).select(
        F.lit(k).alias("entity"), "entity_count", F.lit(table_count).alias("total_tables"))
        for k, df in entities.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kpi_score_distribution(reviews: DataFrame, score: str) -> DataFrame:
    """Review count per non-null score (score descending) with the overall
    review count and average score (2 dp) attached as scalars."""
    totals = reviews.agg(F.count(F.lit(1)).alias("total_reviews"),
                         round_half_up(F.coalesce(F.avg(score), F.lit(0.0)), 2).alias("avg_review_score"))
    dist = (reviews.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score"))
            .agg(F.count(F.lit(1)).alias("review_count")))
    return dist.select("score", "review_count", totals.select("total_reviews").scalar().alias("total_reviews"),
                       totals.select("avg_review_score").scalar().alias("avg_review_score")).orderBy(F.col("score").desc())


def kpi_category_top(df: DataFrame, category: str, n: int = 5) -> DataFrame:
    """K6: top-n categories by count (null shown as the text 'None'); ties by name."""
    g = df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("None")).alias("category")) \
        .agg(F.count(F.lit(1)).alias("row_count"))
    return g.orderBy(F.col("row_count").desc(), "category").limit(n)


def kpi_derived(orders: DataFrame, items: DataFrame, order_key: str, item_order_key: str, price: str | Column,
                freight: str | Column, purchase_ts: str, delivered_ts: str) -> DataFrame:
    """K7: average order value, items per order, average delivery days, total freight.

    Two-level aggregate: items are reduced per order first (shuffle on the order
    key, which is also the join key), then joined to orders and averaged.
    """
    per_order = items.groupBy(F.col(item_order_key).alias("__ok")).agg(
        F.sum(money(price, items)).alias("__value"), F.count(F.lit(1)).alias("__items"),
        F.sum(money(freight, items)).alias("__freight"),
        F.max(F.col(delivered_ts)).alias("__delivered"))
    o = orders.select(F.col(order_key).alias("__ok"), F.col(purchase_ts).alias("__ts"))
    j = o.join(per_order, "__ok")
    dtype = orders.schema[purchase_ts].dataType
    a = j.agg(F.count(F.lit(1)).alias("orders_with_items"), F.sum("__value").cast("double").alias("__v"),
              F.sum("__items").alias("__i"), avg_days("__ts", "__delivered", dtype).alias("__d"),
              F.sum("__freight").cast("double").alias("__f"))
    return a.select("orders_with_items",
                    round_half_up(ratio("__v", "orders_with_items"), 2).alias("avg_order_value"),
                    round_half_up(ratio("__i", "orders_with_items"), 4).alias("items_per_order"),
                    round_half_up("__d", 4).alias("avg_delivery_days"),
                    round_half_up("__f", 2).alias("total_freight"))


def measure_summary(df: DataFrame, column: str) -> DataFrame:
    """K9: row count, sum (0 when empty) and average of a measure."""
    a = df.agg(F.count(F.lit(1)).alias("total_rows"), measure_sum(column, df).alias("__s"), F.count(column).alias("__n"))
    return a.select("total_rows", round_half_up(F.coalesce("__s", F.lit(0.0)), 2).alias("total_value"),
                    round_half_up(ratio("__s", "__n"), 2).alias("avg_value"))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Count, average (2 dp), min and max of one numeric column."""
    name = column.lower()
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  round_half_up(F.avg(F.col(column).cast("double")), 2).alias(f"avg_{name}"),
                  F.min(column).alias(f"min_{name}"), F.max(column).alias(f"max_{name}"))


def group_count_topn(df: DataFrame, by: str, n: int | None = 10) -> DataFrame:
    """Rows per group, count descending (ties by key); top-n when n is given."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.col("row_count").desc(), F.col(by))
    return g.limit(n) if n else g


def group_sum_topn(df: DataFrame, by: str, measure: str | Column, n: int = 10) -> DataFrame:
    """Per group: times ordered and total revenue, top-n by revenue."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("times_ordered"), measure_sum(measure, df).alias("__r"))
    g = g.select(by, "times_ordered", round_half_up("__r", 2).alias("total_revenue"), F.col("__r"))
    return g.orderBy(F.col("__r").desc(), F.col(by)).limit(n).drop("__r")


def group_avg(df: DataFrame, by: str, measure: str) -> DataFrame:
    """Per group: count and average of a measure (2 dp)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("row_count"),
                              round_half_up(ratio(measure_sum(measure, df), F.count(measure)), 2).alias(f"avg_{measure.lower()}"))


def monthly_trend(df: DataFrame, ts: str) -> DataFrame:
    """Rows per calendar month (month start as DATE), ascending."""
    m = F.trunc(F.to_date(F.col(ts)), "month")
    return df.groupBy(m.alias("month")).agg(F.count(F.lit(1)).alias("row_count")).orderBy("month")

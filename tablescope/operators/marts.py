"""M1-M4: analytics marts.

Money is summed as decimals (``exprs.money``: exact, independent of summation order) and
reported as double rounded to 2 dp. Items are either reduced per order before
they meet orders (M1) or joined once against order-level rows (M2/M3), so the
single large join reads shuffle stages directly and AQE can split a hot order key
or broadcast a side that turns out small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import age_days, avg_days, money, money_avg, ratio, round_half_up
from tablescope.functions.quantiles import percentile_array
from tablescope.functions.ranks import with_ranks
from tablescope.session import materialize


@dataclass(frozen=True)
class Roles:
    """Which columns play which part. Values are column names or SQL expressions."""

    order_key: str = "order_id"
    customer_key: str = "customer_id"
    order_status: str = "order_status"
    purchase_ts: str = "purchase_timestamp"
    order_total: str = "order_total"
    item_order_key: str = "order_id"
    item_product_key: str = "product_id"
    item_seller_key: str = "seller_id"
    item_price: str = "price"
    item_freight: str = "freight_value"
    item_quantity: str = "quantity"
    item_delivered_ts: str = "delivered_customer_date"
    canceled: str = "order_status = 'canceled'"
    returned: str = "order_status = 'returned'"
    review_order_key: str = "order_id"
    review_score: str = "score"

    def expr(self, name: str) -> Column:
        return F.expr(getattr(self, name))


def daily_revenue(orders: DataFrame, items: DataFrame, roles: Roles) -> DataFrame:
    """M1: per purchase date — distinct orders, revenue = sum(price + freight),
    avg_order_value (an average per *item row*, as in the reference), item rows,
    distinct customers.

    Items are reduced to one row per order before the join (partial aggregation on
    the join key), which cuts the join input by the items-per-order factor.
    """
    per_order = items.groupBy(roles.expr("item_order_key").alias("__ok")).agg(
        F.sum(money(roles.expr("item_price") + roles.expr("item_freight"), items)).alias("__rev"),
        F.count(F.lit(1)).alias("__items"))
    o = orders.select(roles.expr("order_key").alias("__ok"), roles.expr("customer_key").alias("__cust"),
                      F.to_date(roles.expr("purchase_ts")).alias("date"))
    j = o.join(per_order, "__ok")
    # one row an order and day (still on the join's partitioning), then one a customer and
    # day: distinct counts become plain counts, without an Expand that copies every order
    by_order = j.groupBy("date", "__ok").agg(F.sum("__rev").alias("__rev"), F.sum("__items").alias("__items"),
                                             F.collect_set("__cust").alias("__custs"))
    each = by_order.select("date", "__rev", "__items", F.posexplode_outer("__custs").alias("__at", "__cust"))
    first = F.coalesce(F.col("__at"), F.lit(0)) == 0
    by_customer = each.groupBy("date", "__cust").agg(
        F.count_if(first).alias("__orders"), F.sum(F.when(first, F.col("__rev"))).alias("__rev"),
        F.sum(F.when(first, F.col("__items"))).alias("__items"))
    a = by_customer.groupBy("date").agg(
        F.sum("__orders").cast("bigint").alias("total_orders"), F.sum("__rev").cast("double").alias("__rev"),
        F.sum("__items").cast("bigint").alias("total_items_sold"), F.count("__cust").alias("unique_customers"))
    return a.select("date", "total_orders",
                    round_half_up(F.coalesce("__rev", F.lit(0.0)), 2).alias("total_revenue"),
                    round_half_up(F.coalesce(ratio("__rev", "total_items_sold"), F.lit(0.0)), 2).alias("avg_order_value"),
                    "total_items_sold", "unique_customers")


def _items_orders_reviews(orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles,
                          dedupe_reviews: bool, of_order: dict[str, Column] | None = None,
                          of_item: dict[str, Column] | None = None) -> DataFrame:
    """items ⋈ (orders ⟕ reviews) on the order key, with role expressions evaluated on
    the joined rows (so a flag may use item or order columns).

    Reviews are attached to orders first (an order-sized join), so the one large join
    reads both sides straight from their shuffles — the shape AQE's skew-join rule
    can split when one order key holds a large share of the items. The fan-out is
    the same as joining reviews after the items. A role that orders alone can answer
    is evaluated on orders before the join; only what is left (a flag over item
    columns) is evaluated on the joined rows. ``of_order`` and ``of_item`` name further
    expressions over orders and over the joined rows.
    """
    of_order, of_item = of_order or {}, of_item or {}
    o = orders.select(*[F.col(c) for c in orders.columns], roles.expr("order_key").alias("__ok"))
    sides = {}
    for name, role in (("__purchase", "purchase_ts"), ("__canceled", "canceled"), ("__returned", "returned")):
        e = roles.expr(role)
        sides[name] = role
        if _resolves(orders, e):  # an order role reads the order's own column, also where items has that name
            o = o.withColumn(name, e)
            sides[name] = None
    o = o.withColumns(of_order)
    used = [c for c in o.columns if c.startswith("__") and c in ("__ok", *sides, *of_order)]
    rest = [c for c in orders.columns if c not in items.columns] if any(sides.values()) else []
    r = reviews.select(roles.expr("review_order_key").alias("__ok"), roles.expr("review_score").alias("__score"))
    if dedupe_reviews:
        r = r.groupBy("__ok").agg(F.avg("__score").alias("__score"))
    order_info = o.select(*used, *rest).join(r, "__ok", "left")
    i = items.withColumn("__ok", roles.expr("item_order_key"))
    j = i.join(order_info, "__ok")
    return j.select("__ok", "__score",
                    roles.expr("item_seller_key").alias("__seller"), roles.expr("item_product_key").alias("__product"),
                    roles.expr("item_price").alias("__price"), roles.expr("item_quantity").alias("__qty"),
                    roles.expr("item_delivered_ts").alias("__delivered"),
                    *[F.col(n) if role is None else roles.expr(role).alias(n) for n, role in sides.items()],
                    *of_order, *[c.alias(n) for n, c in of_item.items()])


def _resolves(df: DataFrame, e: Column) -> bool:
    """Whether an expression reads columns of ``df`` only."""
    try:
        df.select(e).schema
    except AnalysisException:
        return False
    return True


def seller_performance(orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles,
                       dedupe_reviews: bool = False) -> DataFrame:
    """M2: per seller — distinct orders, revenue, avg score, avg delivery days,
    canceled item rows / item rows. A second review of an order repeats its item
    rows (the literal join); ``dedupe_reviews=True`` averages reviews per order first."""
    j = _items_orders_reviews(orders, items, reviews, roles, dedupe_reviews)
    dtype = orders.schema[roles.purchase_ts].dataType if roles.purchase_ts in orders.columns else None
    a = j.groupBy(F.col("__seller").alias("seller_id")).agg(
        F.count_distinct("__ok").alias("total_orders"),
        F.sum(money("__price", j)).cast("double").alias("__rev"),
        F.avg(F.col("__score").cast("double")).alias("__score"),
        avg_days("__purchase", "__delivered", dtype).alias("__days"),
        ratio(F.count_if("__canceled"), F.count(F.lit(1))).alias("__cancel"))
    return a.select("seller_id", "total_orders", round_half_up("__rev", 2).alias("total_revenue"),
                    round_half_up("__score", 4).alias("avg_review_score"),
                    round_half_up("__days", 4).alias("avg_delivery_days"),
                    round_half_up("__cancel", 4).alias("cancellation_rate"))


def product_metrics(orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles,
                    dedupe_reviews: bool = False) -> DataFrame:
    """M3: per product — quantity sold, revenue = sum(price * qty), avg price,
    avg score, returned item rows / item rows."""
    j = _items_orders_reviews(orders, items, reviews, roles, dedupe_reviews)
    a = j.groupBy(F.col("__product").alias("product_id")).agg(
        F.sum(F.col("__qty").cast("double")).alias("total_sold"),
        F.sum(money(F.col("__price") * F.col("__qty"), j)).cast("double").alias("__rev"),
        money_avg("__price", j).alias("__avgp"),
        F.avg(F.col("__score").cast("double")).alias("__score"),
        ratio(F.count_if("__returned"), F.count(F.lit(1))).alias("__ret"))
    return a.select("product_id", round_half_up("total_sold", 4).alias("total_sold"),
                    round_half_up("__rev", 2).alias("total_revenue"), round_half_up("__avgp", 4).alias("avg_price"),
                    round_half_up("__score", 4).alias("avg_review_score"),
                    round_half_up("__ret", 4).alias("return_rate"))


# Segment descriptions (wording of the reference's segment table).
SEGMENT_DESCRIPTIONS = {
    "VIP": "Top 10% spenders with 3+ orders",
    "Regular": "Recurring customers with 2+ orders",
    "New": "First-time buyers within last 90 days",
    "At Risk": "No orders in last 6 months",
    "Churned": "No activity in over 1 year",
    "Other": "Customers matching no other segment",
}


def customer_segments(orders: DataFrame, as_of: str, roles: Roles, vip_share: float = 0.10,
                      method: str = "exact", accuracy: int = 10000, vip_by: str = "cutoff") -> DataFrame:
    """M4: VIP / Regular / New / At Risk / Churned / Other.

    Per customer (one shuffle on the customer key): orders, spend, last order.
    First match wins, measured against ``as_of``: Churned (last order > 365 days
    ago), At Risk (> 180), VIP (spend >= the (1 - vip_share) percentile of customer
    spend and >= 3 orders), New (exactly one order, <= 90 days), Regular (>= 2
    orders), else Other. The VIP cut-off is one percentile aggregate entering as a
    scalar (no global sort or single-partition window); it is exact by default
    (``functions.quantiles.percentile_array``), ``method="approx"`` uses a sketch.
    ``vip_by="percent_rank"`` takes the customers whose percent rank by spend, largest first,
    is at most ``vip_share`` instead (``functions.ranks``): ties at the cut fall together, and
    no interpolated value decides.
    """
    if vip_by not in ("cutoff", "percent_rank"):
        raise ValueError(f"unknown vip rule {vip_by!r}")
    dtype = orders.schema[roles.purchase_ts].dataType
    per = orders.groupBy(roles.expr("customer_key").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(money(roles.expr("order_total"), orders)).cast("double").alias("spend"),
        F.max(roles.expr("purchase_ts")).alias("last_order"))
    # read by the cut-off or the ranks, and by the segmentation: written once to the shared
    # checkpoint folder instead of re-running the orders shuffle
    per = materialize(per)
    if vip_by == "cutoff":
        top = F.col("spend") >= F.get(percentile_array(per, "spend", [round(1.0 - vip_share, 12)], method, accuracy), F.lit(0))
    else:
        per = with_ranks(per, "spend", descending=True, rank="__rank", percent_rank="__share")
        top = F.col("__share") <= vip_share
    days = age_days(F.col("last_order"), as_of, dtype)
    seg = (F.when(days > 365, "Churned").when(days > 180, "At Risk")
           .when(top & (F.col("n_orders") >= 3), "VIP")
           .when((F.col("n_orders") == 1) & (days <= 90), "New")
           .when(F.col("n_orders") >= 2, "Regular").otherwise("Other"))
    a = per.groupBy(seg.alias("segment_name")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("n_orders").cast("bigint").alias("__orders"),
        F.sum(money("spend")).cast("double").alias("__rev"))
    desc = F.create_map(*[x for k, v in SEGMENT_DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v))])
    return a.select("segment_name", "customer_count",
                    round_half_up(ratio("__rev", "__orders"), 2).alias("avg_order_value"),
                    round_half_up(ratio("__orders", "customer_count"), 4).alias("avg_orders_per_customer"),
                    round_half_up("__rev", 2).alias("total_revenue"),
                    desc[F.col("segment_name")].alias("description"))

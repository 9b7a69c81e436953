"""M1-M3 kept up to date: stored states per purchase day that add up to the marts.

The orders of a day with their items become state rows of four kinds: one for the day, one a
seller, one a product (exact decimal sums and counts) and the day's customers as bitmaps, sets
of 32,768 neighbouring keys in 4 KB. A mart is the sum of state rows over days, and customers
of a month are the union of its days' bitmaps, so marts over any span never read orders or
items again. An order has one purchase day, so distinct orders of days add up as they are.

States are stored by month. The months with new or changed days are worked out anew and
replace their rows by dynamic partition overwrite. A run that is repeated gives the same
state; other months' files are not touched.

A refresh works in steps, so that its disk is that of the states and the joined rows, not that of
every shuffle at once: orders meet their items by shares of the order keys, into files by month
of the year; these files become states one after the other and are deleted. A month is replaced
as a whole; a refresh that is cut off leaves months done and months as they were, and its next
run does them all.

Customer keys are whole numbers, not negative (``bitmap_bit_position`` deals them out).
Reviews are averaged per order, as ``marts`` does with ``dedupe_reviews``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from tablescope.functions.exprs import micros_sum, money, ratio, round_half_up
from tablescope.operators.marts import Roles, _items_orders_reviews
from tablescope.session import materialize, shared_dir, shuffles_dropped
from tablescope.sources.tables import _filesystem

#: Kinds of state and what each adds up, beside its day and key.
STATES = {
    "days": ("orders", "items", "revenue"),
    "sellers": ("orders", "items", "price", "score", "score_n", "micros", "micros_n", "canceled"),
    "products": ("items", "quantity", "sales", "price", "price_n", "score", "score_n", "returned"),
}
KEYS = {"days": [], "sellers": ["seller"], "products": ["product"], "customers": ["bucket"]}

#: Shares of the order keys that are joined one after the other, and batches of months that become
#: states one after the other: so many at most, and one for each so many bytes of items or joined rows.
SHARES, SHARE_BYTES = 4, 128 << 20
BATCHES, BATCH_BYTES = 12, 64 << 20


def _sums(j: DataFrame) -> dict[str, Column]:
    score = F.col("__score").cast("decimal(20,6)")
    micros = F.timestamp_diff("MICROSECOND", F.col("__purchase").cast("timestamp_ntz"), F.col("__delivered").cast("timestamp_ntz"))
    exact = lambda x: F.sum(money(x, j)).cast("decimal(38,10)")
    return {
        "orders": F.count_distinct("__ok"), "items": F.count(F.lit(1)), "revenue": exact(F.col("__price") + F.col("__freight")), "sales": exact(F.col("__price") * F.col("__qty")),
        "price": exact("__price"), "price_n": F.count(money("__price", j)), "quantity": exact("__qty"), "score": F.sum(score).cast("decimal(38,6)"), "score_n": F.count(score),
        "micros": micros_sum(micros).cast("decimal(38,0)"), "micros_n": F.count(micros), "canceled": F.count_if("__canceled"), "returned": F.count_if("__returned"),
    }


def _joined(orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles) -> DataFrame:
    """Every item with what its order, day and review tell, as ``states_of`` reads it."""
    return _items_orders_reviews(
        orders, items, reviews, roles, True, {"__day": F.to_date(roles.expr("purchase_ts")), "__customer": roles.expr("customer_key").cast("bigint")},
        {"__freight": roles.expr("item_freight")}).withColumnsRenamed({"__day": "day", "__seller": "seller", "__product": "product"})


def states_of(j: DataFrame) -> dict[str, DataFrame]:
    """The state rows of joined rows, by kind, reduced map-side first; only customers meet at their
    day and bucket before they become bits, since 4 KB a bucket, day and task would be far more
    than the customers."""
    sums = _sums(j)
    out = {kind: j.groupBy("day", *KEYS[kind]).agg(*[sums[n].alias(n) for n in names]) for kind, names in STATES.items()}
    once = j.where("__customer IS NOT NULL").select("day", "__customer").distinct()
    placed = once.select("day", F.bitmap_bucket_number("__customer").alias("bucket"), F.bitmap_bit_position("__customer").alias("bit")).repartition("day", "bucket")
    out["customers"] = placed.groupBy("day", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return out


def day_states(orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles) -> dict[str, DataFrame]:
    """The state rows of every day of ``orders`` at once, by kind. The joined rows are written once."""
    return states_of(materialize(_joined(orders, items, reviews, roles)))


def _pieces(size: int, each: int, most: int) -> int:
    return min(most, max(1, -(-size // each)))


def _shares(orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """The three tables by shares of their order keys, each key in one share. Keys that a join would
    have to convert hash differently on its two sides: they are one share."""
    sides = [(orders, roles.expr("order_key")), (items, roles.expr("item_order_key")), (reviews, roles.expr("review_order_key"))]
    types = [df.select(key).schema[0].dataType for df, key in sides]
    whole = all(isinstance(t, IntegralType) for t in types)
    n = _pieces(int(str(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), SHARE_BYTES, SHARES)
    if n == 1 or not (whole or all(t == StringType() for t in types)):
        return [(orders, items, reviews)]
    share = lambda key: F.pmod(F.xxhash64(key.cast("bigint") if whole else key), F.lit(n))
    return [tuple(df.where(share(key) == k) for df, key in sides) for k in range(n)]


def _store_joined(path: str, orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles) -> DataFrame:
    """The joined rows, written under ``path`` by month of the year (``part``). Rows without a day
    are with the first; columns without a type, which files cannot hold, are added as they are read."""
    for share in _shares(orders, items, reviews, roles):
        j = _joined(*share, roles)
        void = [c for c, kind in j.dtypes if kind == "void"]
        kept = j.drop(*void).withColumn("part", F.coalesce(F.month("day"), F.lit(1)))
        kept.write.mode("append").option("compression", "zstd").partitionBy("part").parquet(path)
    return j.sparkSession.read.schema(kept.schema).parquet(path).withColumns({c: F.lit(None) for c in void})


def _ranges(months: list[str]) -> list[tuple[str, str]]:
    """First days (inclusive, exclusive) of runs of neighbouring months."""
    out: list[tuple[str, str]] = []
    for m in months:
        y, k = int(m[:4]), int(m[5:7])
        after = f"{y + k // 12:04d}-{k % 12 + 1:02d}-01"
        if out and out[-1][1] == f"{m}-01":
            out[-1] = (out[-1][0], after)
        else:
            out.append((f"{m}-01", after))
    return out


def refresh(state: str, orders: DataFrame, items: DataFrame, reviews: DataFrame, roles: Roles, days: Iterable[str] | None = None) -> None:
    """Work out the states of the months with ``days`` ('yyyy-MM-dd'; all of ``orders`` if
    None) and put them in the place of those stored at ``state``. ``orders`` and ``items`` are the
    tables as they are now; orders are filtered to ranges of their purchase time, at the scan.
    A month that has no orders any more is emptied."""
    months = None if days is None else sorted({d[:7] for d in days})
    if months == []:
        return
    if months is not None:
        ts = roles.expr("purchase_ts")
        dtype = orders.select(ts).schema[0].dataType
        inside = F.lit(False)
        for first, after in _ranges(months):
            inside = inside | ((ts >= F.lit(first).cast(dtype)) & (ts < F.lit(after).cast(dtype)))
        orders = orders.where(inside)
    spark = orders.sparkSession
    path = f"{shared_dir(spark)}/mart-rows-{uuid.uuid4().hex}"
    fs, at = _filesystem(spark, path)
    try:
        with shuffles_dropped(spark):
            j = _store_joined(path, orders, items, reviews, roles)
            n = _pieces(fs.getContentSummary(at).getLength(), BATCH_BYTES, BATCHES)
            for batch in range(n):
                parts = range(batch + 1, 13, n)
                _replace_months(state, j.where(F.col("part").isin(*parts)), None if months is None else [m for m in months if int(m[5:7]) in parts])
                for k in parts:
                    fs.delete(_filesystem(spark, f"{path}/part={k}")[1], True)
    finally:
        fs.delete(at, True)


def _replace_months(state: str, j: DataFrame, months: list[str] | None) -> None:
    """Put the states of joined rows, and of ``months`` without any, in the place of those stored."""
    rows = None
    for kind, part in states_of(j).items():
        part = part.withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if months:  # a row of no kind says that the month was seen, so it is replaced
        seen = j.sparkSession.createDataFrame([(f"{m}-01",) for m in months], "day STRING").select(F.col("day").cast("date").alias("day"))
        rows = rows.unionByName(seen, allowMissingColumns=True)
    # a month is one task's while it is small; AQE splits one that is large
    (rows.withColumn("month", F.date_format("day", "yyyy-MM")).hint("rebalance", "month").sortWithinPartitions("month", "kind").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(state))


def load_states(spark: SparkSession, state: str) -> dict[str, DataFrame]:
    rows = spark.read.parquet(state)
    return {kind: rows.where(F.col("kind") == kind).select("day", *keys, *STATES.get(kind, ("bits",))) for kind, keys in KEYS.items()}


def revenue(states: dict[str, DataFrame], period: str = "day") -> DataFrame:
    """M1 by ``period``, a SQL expression over ``day``: the rows of ``marts.daily_revenue`` for
    the day itself, with customers counted once a period."""
    by = F.expr(period).alias("date")
    plain = states["days"].groupBy(by).agg(*[F.sum(c).alias(c) for c in STATES["days"]])
    sets = states["customers"].groupBy(by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy("date").agg(F.sum("n").alias("customers"))
    a = plain.join(sets.withColumnRenamed("date", "of"), F.col("date").eqNullSafe(F.col("of")), "left")
    total = F.col("revenue").cast("double")
    return a.select("date", F.col("orders").cast("bigint").alias("total_orders"), round_half_up(F.coalesce(total, F.lit(0.0)), 2).alias("total_revenue"),
                    round_half_up(F.coalesce(ratio(total, F.col("items")), F.lit(0.0)), 2).alias("avg_order_value"),
                    F.col("items").cast("bigint").alias("total_items_sold"), F.coalesce("customers", F.lit(0)).cast("bigint").alias("unique_customers"))


def sellers(states: dict[str, DataFrame]) -> DataFrame:
    """M2, as ``marts.seller_performance`` with ``dedupe_reviews``."""
    a = states["sellers"].groupBy(F.col("seller").alias("seller_id")).agg(*[F.sum(c).alias(c) for c in STATES["sellers"]])
    return a.select("seller_id", F.col("orders").cast("bigint").alias("total_orders"), round_half_up(F.col("price").cast("double"), 2).alias("total_revenue"),
                    round_half_up(ratio("score", "score_n"), 4).alias("avg_review_score"), round_half_up(ratio("micros", "micros_n") / 86_400_000_000.0, 4).alias("avg_delivery_days"),
                    round_half_up(ratio("canceled", "items"), 4).alias("cancellation_rate"))


def products(states: dict[str, DataFrame]) -> DataFrame:
    """M3, as ``marts.product_metrics`` with ``dedupe_reviews``."""
    a = states["products"].groupBy(F.col("product").alias("product_id")).agg(*[F.sum(c).alias(c) for c in STATES["products"]])
    return a.select("product_id", round_half_up(F.col("quantity").cast("double"), 4).alias("total_sold"), round_half_up(F.col("sales").cast("double"), 2).alias("total_revenue"),
                    round_half_up(ratio("price", "price_n"), 4).alias("avg_price"), round_half_up(ratio("score", "score_n"), 4).alias("avg_review_score"),
                    round_half_up(ratio("returned", "items"), 4).alias("return_rate"))

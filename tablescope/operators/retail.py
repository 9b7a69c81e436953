"""Sample retail queries over a two-schema store model.

Inputs use the retail model's column names:

    orders(order_id, customer_id, store_id, order_status)      order_status 1-4
    order_items(order_id, item_id, product_id, quantity, list_price, discount)
    customers(customer_id, first_name, last_name)
    stores(store_id, store_name)
    products(product_id, product_name, brand_id, category_id, model_year, list_price)
    brands(brand_id, brand_name)   categories(category_id, category_name)
    stocks(store_id, product_id, quantity)

Order totals are reduced per order on the items side first (a partial aggregate
on the join key), then joined; dimension tables are small and broadcast by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import money, round_half_up

# Order status codes and labels of the retail model.
ORDER_STATUS = {1: "Pending", 2: "Processing", 3: "Rejected", 4: "Completed"}
REORDER_POINT = 5


def _status_label(c):
    m = F.create_map(*[x for k, v in ORDER_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


def order_totals(items: DataFrame) -> DataFrame:
    """(order_id, total): sum of quantity * list_price * (1 - discount), exact in DECIMAL."""
    amount = money(F.col("quantity") * F.col("list_price") * (1 - F.col("discount")), items)
    return items.groupBy("order_id").agg(F.sum(amount).alias("total"))


def retail_orders(orders: DataFrame, items: DataFrame, customers: DataFrame, stores: DataFrame) -> DataFrame:
    """Orders with customer name, store name, status label and total."""
    cust = customers.select("customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer"))
    j = (orders.join(order_totals(items), "order_id", "left").join(cust, "customer_id", "left")
         .join(stores.select("store_id", "store_name"), "store_id", "left"))
    return j.select("order_id", "customer", F.col("store_name").alias("store"),
                    F.col("order_status").cast("int").alias("status_code"),
                    _status_label(F.col("order_status")).alias("status"),
                    round_half_up(F.coalesce(F.col("total"), F.lit(0)).cast("double"), 2).alias("total"))


def retail_revenue_by_store(orders: DataFrame, items: DataFrame, stores: DataFrame) -> DataFrame:
    """R2: revenue and order count per store plus a grand-total row (``rollup``)."""
    j = orders.select("order_id", "store_id").join(order_totals(items), "order_id") \
        .join(stores.select("store_id", "store_name"), "store_id", "left")
    r = j.rollup("store_name").agg(F.sum("total").cast("double").alias("__rev"),
                                   F.count(F.lit(1)).alias("orders"), F.grouping("store_name").alias("__g"))
    return r.select(F.when(F.col("__g") == 1, F.lit("ALL")).otherwise(F.col("store_name")).alias("store"),
                    F.col("__g").cast("boolean").alias("is_total"),
                    round_half_up("__rev", 2).alias("revenue"), "orders")


def _product_view(products: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    return (products.join(brands, "brand_id", "left").join(categories, "category_id", "left")
            .select("product_id", F.col("product_name").alias("name"), "brand_id", "brand_name", "category_id",
                    "category_name", "model_year", F.col("list_price").cast("double").alias("price")))


def retail_product_filter(products: DataFrame, brands: DataFrame, categories: DataFrame,
                          category: str | None = None, brand: str | None = None) -> DataFrame:
    """Products with brand and category names, optionally filtered by either."""
    v = _product_view(products, brands, categories)
    if category is not None:
        v = v.where(F.col("category_name") == category)
    if brand is not None:
        v = v.where(F.col("brand_name") == brand)
    return v.select("product_id", "name", F.col("brand_name").alias("brand"),
                    F.col("category_name").alias("category"), "price")


def retail_product_detail(products: DataFrame, brands: DataFrame, categories: DataFrame, stocks: DataFrame,
                          stores: DataFrame, product_id=None) -> DataFrame:
    """Product with nested brand/category structs and its stock per store
    (array sorted by store; its size is bounded by the number of stores)."""
    v = _product_view(products, brands, categories)
    if product_id is not None:
        v = v.where(F.col("product_id") == F.lit(product_id))
    st = (stocks.join(stores.select("store_id", "store_name"), "store_id", "left")
          .groupBy("product_id").agg(F.array_sort(F.collect_list(
              F.struct(F.col("store_name").alias("store"), F.col("quantity").alias("quantity")))).alias("stock")))
    return v.join(st, "product_id", "left").select(
        "product_id", "name",
        F.struct(F.col("brand_id").alias("id"), F.col("brand_name").alias("name")).alias("brand"),
        F.struct(F.col("category_id").alias("id"), F.col("category_name").alias("name")).alias("category"),
        "model_year", F.col("price").alias("list_price"),
        F.coalesce("stock", F.array().cast("array<struct<store:string,quantity:int>>")).alias("stock"))


def retail_category_counts(products: DataFrame, categories: DataFrame, brands: DataFrame) -> DataFrame:
    """Product count per category and per brand (zero counts kept)."""
    pc = products.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    pb = products.groupBy("brand_id").agg(F.count(F.lit(1)).alias("n"))
    c = categories.join(pc, "category_id", "left").select(
        F.lit("category").alias("kind"), F.col("category_id").cast("string").alias("id"),
        F.col("category_name").alias("name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("product_count"))
    b = brands.join(pb, "brand_id", "left").select(
        F.lit("brand").alias("kind"), F.col("brand_id").cast("string").alias("id"),
        F.col("brand_name").alias("name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("product_count"))
    return c.unionByName(b)


def retail_inventory(stocks: DataFrame, stores: DataFrame, store_id=None,
                     reorder_point: int = REORDER_POINT) -> DataFrame:
    """Per store — total items, products stocked, low-stock alerts."""
    s = stocks if store_id is None else stocks.where(F.col("store_id") == F.lit(store_id))
    a = s.groupBy("store_id").agg(F.sum("quantity").cast("bigint").alias("total_items"),
                                  F.count(F.lit(1)).alias("product_count"),
                                  F.count_if(F.col("quantity") < reorder_point).alias("low_stock_alerts"))
    return a.join(stores.select("store_id", "store_name"), "store_id", "left").select(
        "store_id", F.col("store_name").alias("store"), "total_items", "product_count", "low_stock_alerts")


def retail_low_stock(stocks: DataFrame, stores: DataFrame, products: DataFrame,
                     reorder_point: int = REORDER_POINT) -> DataFrame:
    """Stock rows with quantity < reorder point."""
    low = stocks.where(F.col("quantity") < reorder_point)
    return (low.join(products.select("product_id", "product_name"), "product_id", "left")
            .join(stores.select("store_id", "store_name"), "store_id", "left")
            .select("product_id", F.col("product_name").alias("product"), "store_id",
                    F.col("store_name").alias("store"), "quantity", F.lit(reorder_point).alias("reorder_point")))

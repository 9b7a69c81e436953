"""Exact ranks of every row without a window over the whole table.

``rank() OVER (ORDER BY x)`` without a partition gathers all rows in one task. Here the
distinct values with their counts (reduced map-side: a hot value is one row a task) are dealt
to ranges and written once; a rank is the rows in the ranges before, from prefix sums of one
row a range, plus a running sum inside the range. Ranges are of equal numbers of distinct
values, so a value with a third of all rows makes no range large.

Values return to their rows by a join in which no key is hot: the values that hold more than
1/HOT of all rows are fewer than HOT and are broadcast; their rows are spread in the shuffle
of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize

HOT = 1000


def value_ranks(df: DataFrame, column: str | Column, descending: bool = False) -> DataFrame:
    """One row a distinct value: v, n_rows, rank (1 + rows that come before), total (all rows
    with a value). NaN is larger than any other value, -0.0 is 0.0, nulls have no rank."""
    c = F.col(column) if isinstance(column, str) else column
    x = (c.cast("double") + F.lit(0.0)).alias("v")
    counts = df.where(c.isNotNull()).select(x).groupBy("v").agg(F.count(F.lit(1)).alias("n_rows"))
    order = F.col("v").desc() if descending else F.col("v").asc()
    # written once: a range partitioning that is worked out a second time may cut elsewhere
    dealt = materialize(counts.repartitionByRange(order).selectExpr("v", "n_rows", "spark_partition_id() AS part"))
    parts = dealt.groupBy("part").agg(F.expr("sum(n_rows) AS m")).selectExpr(
        "part", "sum(m) OVER () AS total", "coalesce(sum(m) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    way = "DESC" if descending else "ASC"
    return dealt.join(parts, "part").selectExpr(
        "v", "n_rows", f"before + sum(n_rows) OVER (PARTITION BY part ORDER BY v {way}) - n_rows + 1 AS rank", "total")


def with_ranks(df: DataFrame, column: str, descending: bool = False, rank: str = "rank", percent_rank: str = "percent_rank") -> DataFrame:
    """``df`` with the rank of ``column`` and its percent rank, (rank - 1) / (rows - 1), 0 for a
    single row; both null where the column is null. Equal values share the smallest rank."""
    ranked = materialize(value_ranks(df, column, descending))
    hot = ranked.where(F.col("n_rows") * HOT > F.col("total")).select(F.col("v").alias("__hot"), F.struct("rank", "total").alias("__h"))
    rows = df.select(F.struct("*").alias("__row"), (F.col(column).cast("double") + F.lit(0.0)).alias("__v"))
    rows = rows.join(F.broadcast(hot), F.col("__v") == F.col("__hot"), "left").drop("__hot")
    # rows that are done, or have no value, meet nothing and are spread by their salt
    open_ = F.col("__h").isNull() & F.col("__v").isNotNull()
    rows = rows.select("__row", "__h", F.when(open_, F.col("__v")).alias("__v"), F.when(open_, 0).otherwise(F.monotonically_increasing_id() % 8192 + 1).alias("__salt"))
    rest = ranked.select(F.col("v").alias("__v"), F.lit(0).cast("long").alias("__salt"), F.struct("rank", "total").alias("__r"))
    found = rows.join(rest, (rows["__v"].eqNullSafe(rest["__v"])) & (rows["__salt"] == rest["__salt"]), "left").select("__row", F.coalesce("__h", "__r").alias("__r"))
    share = F.when(F.col("__r.total") == 1, 0.0).otherwise((F.col("__r.rank") - 1) / (F.col("__r.total") - 1))
    return found.select("__row.*", F.col("__r.rank").alias(rank), F.when(F.col("__r").isNotNull(), share).alias(percent_rank))

"""Q6 z-score and Q7 IQR outliers.

Both are two-pass: statistics first, then a counting scan. The statistics enter
the second pass as scalar subqueries (computed once, inlined as literals), so
there is no join and nothing per-row is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import ratio, round_half_up
from tablescope.functions.quantiles import percentile_array

ZERO_STDDEV_NOTE = "Standard deviation is zero - no variation in data"


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("__x"))


def outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0, table_name: str | None = None) -> DataFrame:
    """mean, sample stddev, count of |z| > threshold over non-null rows, percentage.

    Zero (or undefined) stddev yields counts of 0 and a note instead of a
    division error.
    """
    v = _values(df, column)
    mean = v.agg(F.avg("__x")).scalar()
    sd = v.agg(F.stddev_samp("__x")).scalar()
    z = F.abs(F.try_divide(F.col("__x") - mean, sd))
    degenerate = sd.isNull() | (sd == 0)
    counted = v.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(z > F.lit(threshold)).alias("__n"))
    n_out = F.when(degenerate, F.lit(0)).otherwise(F.col("__n")).cast("bigint")
    return counted.select(
        F.lit(table_name).cast("string").alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(float(threshold)).alias("threshold"),
        round_half_up(F.coalesce(mean, F.lit(0.0)), 4).alias("mean"),
        round_half_up(F.coalesce(sd, F.lit(0.0)), 4).alias("stddev"),
        "total_rows",
        n_out.alias("outlier_count"),
        F.coalesce(round_half_up(ratio(n_out * 100, "total_rows"), 2), F.lit(0.0)).alias("outlier_percentage"),
        F.when(degenerate, F.lit(ZERO_STDDEV_NOTE)).alias("note"),
    )


def outliers_zscore_sample(df: DataFrame, column: str, threshold: float = 3.0, n: int = 5) -> DataFrame:
    """Top-``n`` outliers by |z| (value breaks ties): a distributed top-k."""
    v = _values(df, column)
    mean = v.agg(F.avg("__x")).scalar()
    sd = v.agg(F.stddev_samp("__x")).scalar()
    z = F.abs(F.try_divide(F.col("__x") - mean, sd))
    top = (v.select(F.col("__x").alias("value"), z.alias("__z")).where(F.col("__z") > F.lit(threshold))
           .orderBy(F.col("__z").desc(), F.col("value").asc()).limit(n))
    return top.select("value", round_half_up("__z", 2).alias("zscore"))


def outliers_iqr(df: DataFrame, column: str, multiplier: float = 1.5, method: str = "exact",
                 accuracy: int = 10000, table_name: str | None = None) -> DataFrame:
    """q1, q3, iqr, fences q1 - m*iqr / q3 + m*iqr (strict), outlier count and percentage.

    Quartiles are exact PERCENTILE_CONT by default (``method="exact"``, see
    ``functions.quantiles.percentile_array``); ``method="approx"`` uses a sketch.
    """
    v = _values(df, column)
    # the quartiles become a column once; all that follows refers to it
    d = v.select("__x", percentile_array(df, column, [0.25, 0.75], method, accuracy).alias("q"))
    q1, q3 = F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("q", F.lit(1)), F.lit(0.0))
    iqr = q3 - q1
    lower, upper = q1 - F.lit(multiplier) * iqr, q3 + F.lit(multiplier) * iqr
    counted = d.agg(F.count(F.lit(1)).alias("total_rows"), F.first("q").alias("q"),
                    F.count_if((F.col("__x") < lower) | (F.col("__x") > upper)).alias("outlier_count"))
    return counted.select(
        F.lit(table_name).cast("string").alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(float(multiplier)).alias("multiplier"),
        round_half_up(q1, 4).alias("q1"),
        round_half_up(q3, 4).alias("q3"),
        round_half_up(iqr, 4).alias("iqr"),
        round_half_up(lower, 4).alias("lower_bound"),
        round_half_up(upper, 4).alias("upper_bound"),
        "total_rows",
        "outlier_count",
        F.coalesce(round_half_up(ratio(F.col("outlier_count") * 100, "total_rows"), 2), F.lit(0.0))
        .alias("outlier_percentage"),
    )

"""Q8: distribution shape in one aggregate.

Skewness and kurtosis follow the reference's formula: population central
moments divided by powers of the *sample* standard deviation. Spark's
``skewness``/``kurtosis`` are the population forms, so they are rescaled:

    skew = skewness * ((n-1)/n)^1.5
    kurt = (kurtosis + 3) * ((n-1)/n)^2 - 3

Zero variance gives 0 for both. Percentiles are PERCENTILE_CONT; a percentile
equal to 0 stays 0 (not null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import round_half_up
from tablescope.functions.quantiles import percentile_array

PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)


def distribution_stats(df: DataFrame, column: str, method: str = "exact", accuracy: int = 10000,
                       table_name: str | None = None) -> DataFrame:
    """Moments in one aggregate; percentiles (exact by default, see
    ``functions.quantiles.percentile_array``) attached as scalars."""
    x = F.col(column).cast("double")
    pct = percentile_array(df, column, PROBS, method, accuracy)
    a = df.where(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.var_samp(x).alias("var"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.skewness(x).alias("g1"),
        F.kurtosis(x).alias("g2"),
    ).select("*", pct.alias("p"))
    n = F.col("n").cast("double")
    shrink = F.try_divide(n - 1, n)
    skew = F.coalesce(F.col("g1") * F.pow(shrink, 1.5), F.lit(0.0))
    kurt = F.coalesce((F.col("g2") + 3) * F.pow(shrink, 2) - 3, F.lit(0.0))
    a = a.select("*", skew.alias("skew"), kurt.alias("kurt"))
    s, k = F.col("skew"), F.col("kurt")
    skew_kind = (F.when(F.abs(s) < 0.5, "symmetric").when(F.abs(s) < 1, "moderately skewed")
                 .otherwise("highly skewed"))
    skew_dir = F.when(s > 0, "right").when(s < 0, "left").otherwise("none")
    kurt_kind = (F.when(F.abs(k) < 1, "mesokurtic (normal)").when(k > 1, "leptokurtic (heavy tails)")
                 .otherwise("platykurtic (light tails)"))

    def r4(c):
        return round_half_up(c, 4)

    return a.select(
        F.lit(table_name).cast("string").alias("table_name"),
        F.lit(column).alias("column_name"),
        F.col("n").alias("total_rows"),
        r4("mean").alias("mean"),
        r4(F.col("p")[2]).alias("median"),
        r4("sd").alias("stddev"),
        r4("var").alias("variance"),
        r4("lo").alias("min"),
        r4("hi").alias("max"),
        r4(F.col("hi") - F.col("lo")).alias("range"),
        r4(s).alias("skewness"),
        F.concat(skew_kind, F.lit(" ("), skew_dir, F.lit(")")).alias("skewness_interpretation"),
        r4(k).alias("kurtosis"),
        kurt_kind.alias("kurtosis_interpretation"),
        r4(F.col("p")[0]).alias("p10"),
        r4(F.col("p")[1]).alias("p25"),
        r4(F.col("p")[2]).alias("p50"),
        r4(F.col("p")[3]).alias("p75"),
        r4(F.col("p")[4]).alias("p90"),
    )

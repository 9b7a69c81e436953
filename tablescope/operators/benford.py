"""Q9: Benford's-law leading-digit analysis.

Only finite values >= 1 are analysed: values in (0, 1) have a leading "0" in plain
decimal text and are excluded, and the guard keeps Spark's scientific text of
small doubles ("1.2E-4") from being counted as a 1. NaN and infinity have no
leading digit. For x >= 1 the first character of the text form, after a sign and
zeros that a text column may hold, is the leading digit, also in scientific
notation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.functions.exprs import round_half_up, sql_ident

# Expected first-digit shares used by the reference (digit: share).
BENFORD_EXPECTED = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}

# Chi-square cut-offs (df = 8) and the risk wording.
RISK_MODERATE_AT = 15.5
RISK_HIGH_AT = 20.1
RISK_MESSAGES = {
    "low": "Data follows Benford's Law - no significant anomalies detected",
    "moderate": "Mild deviation from Benford's Law - review recommended",
    "high": "Significant deviation from Benford's Law - potential fraud or data manipulation",
}


def _expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, p) for d, p in BENFORD_EXPECTED.items()], "digit INT, expected DOUBLE")


def _digit_counts(df: DataFrame, column: str) -> DataFrame:
    x = F.col(sql_ident(column))
    v = x.try_cast("double")
    text = F.regexp_replace(F.trim(x.cast("string")), "^[+]?0*", "")
    return (df.where((v >= 1) & (v < float("inf")))  # NaN sorts above infinity
            .select(F.substring(text, 1, 1).try_cast("int").alias("digit"))
            .groupBy("digit").agg(F.count(F.lit(1)).alias("count")))


def benford_digits(df: DataFrame, column: str, table_name: str | None = None) -> DataFrame:
    """Nine rows: digit, count, observed_pct, expected_pct, deviation (2 dp).

    The digit histogram has at most nine groups (partial aggregation), so joining
    it with the nine expected shares is a join of two tiny frames.
    """
    spark = df.sparkSession
    counts = F.broadcast(_digit_counts(df, column))
    j = _expected(spark).join(counts, "digit", "left").select(
        "digit", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"), "expected")
    total = F.sum("count").over(Window.partitionBy())  # nine rows: bounded
    obs = F.try_divide(F.col("count").cast("double"), total.cast("double"))
    obs = F.coalesce(obs, F.lit(0.0))
    return j.select(
        F.lit(table_name).cast("string").alias("table_name"),
        F.lit(column).alias("column_name"),
        "digit",
        "count",
        round_half_up(obs * 100, 2).alias("observed_pct"),
        round_half_up(F.col("expected") * 100, 2).alias("expected_pct"),
        round_half_up((obs - F.col("expected")) * 100, 2).alias("deviation"),
    )


def benford_summary(df: DataFrame, column: str, table_name: str | None = None) -> DataFrame:
    """total_values_analyzed, chi-square (observed digits only, as the reference),
    chi_square_full (all nine digits), risk level and message."""
    spark = df.sparkSession
    counts = F.broadcast(_digit_counts(df, column))
    j = _expected(spark).join(counts, "digit", "left").select(
        "digit", F.coalesce(F.col("count"), F.lit(0)).cast("double").alias("o"), "expected")
    total = F.sum("o").over(Window.partitionBy())
    j = j.select("*", (F.col("expected") * total).alias("e"))
    term = F.try_divide(F.pow(F.col("o") - F.col("e"), 2), F.col("e"))
    a = j.agg(
        F.sum("o").cast("bigint").alias("total_values_analyzed"),
        F.sum(F.when(F.col("o") > 0, term)).alias("chi_obs"),
        F.sum(term).alias("chi_full"),
        F.count_if(F.col("o") > 0).alias("digits_observed"),
    )
    chi = F.coalesce(F.col("chi_obs"), F.lit(0.0))
    level = (F.when(F.col("total_values_analyzed") == 0, F.lit(None))
             .when(chi < RISK_MODERATE_AT, "low").when(chi < RISK_HIGH_AT, "moderate").otherwise("high"))
    msg = F.create_map(*[x for k, v in RISK_MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    return a.select(
        F.lit(table_name).cast("string").alias("table_name"),
        F.lit(column).alias("column_name"),
        "total_values_analyzed",
        "digits_observed",
        F.when(F.col("total_values_analyzed") > 0, round_half_up(chi, 4)).alias("chi_square_statistic"),
        F.when(F.col("total_values_analyzed") > 0, round_half_up("chi_full", 4)).alias("chi_square_full"),
        level.alias("risk_level"),
        msg[level].alias("risk_message"),
    )

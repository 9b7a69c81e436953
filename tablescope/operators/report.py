"""Q13-Q16: per-table quality record, summary grid, traffic-light bands, check log.

``table_quality`` fuses completeness, key uniqueness and freshness of one table
into a single aggregate, i.e. one scan per table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import (
    attach_scalars,
    is_string_type,
    is_temporal_type,
    round_half_up,
    sql_ident,
    sql_ratio,
    sql_round_half_up,
    sql_str,
)
from tablescope.functions.aggregates import union_all
from tablescope.operators.profile import column_profile, null_rates

# Fixed values (ours): band and verdict thresholds.
COMPLETENESS_GOOD = 95.0
COMPLETENESS_WARN = 80.0
NULL_PCT_BAD = 10.0
UNIQUENESS_WARN = 0.95
FRESH_PASS_DAYS = 1.0
FRESH_WARN_DAYS = 7.0


def table_quality(df: DataFrame, table_name: str, pk: list[str] | None = None, ts_column: str | None = None,
                  as_of: str | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Q13 for one table: row_count, overall_completeness, columns_with_nulls,
    max_null_pct, pk uniqueness, freshness.

    Null rates come from codegen-sized single-row aggregates (column chunks); the
    key's distinct count and the timestamp range are separate single-row
    aggregates over only their columns, attached as scalar subqueries (no join).
    ``rates`` (total_rows, null_rate per column) saves the null pass where it is known.
    """
    cols = list(df.columns)
    rates = null_rates(df, cols) if rates is None else rates
    units = "sum(CAST(floor(null_rate * 10000.0D + 0.5D) AS BIGINT))"
    overall = sql_round_half_up(f"1.0D - (CAST({units} AS DOUBLE) / 10000.0D) / {float(len(cols))!r}D", 4)
    pk_text = sql_str(",".join(pk)) if pk else "CAST(NULL AS STRING)"
    out = rates.selectExpr(
        "max(total_rows) AS row_count", f"{overall} AS overall_completeness",
        "count_if(null_rate > 0) AS columns_with_nulls",
        f"{sql_round_half_up('max(null_rate) * 100', 1)} AS max_null_pct", f"{pk_text} AS pk_columns")
    if pk:
        key = ", ".join(sql_ident(c) for c in pk)
        u = df.selectExpr(f"count(DISTINCT struct({key})) AS unique_pk_rows")
        out = attach_scalars(out, u).selectExpr(
            "*", f"{sql_round_half_up(sql_ratio('unique_pk_rows', 'row_count'), 4)} AS pk_uniqueness_rate")
    else:
        out = out.selectExpr("*", "CAST(NULL AS BIGINT) AS unique_pk_rows", "CAST(NULL AS DOUBLE) AS pk_uniqueness_rate")
    if ts_column:
        c = sql_ident(ts_column)
        text = is_string_type(df.schema[ts_column].dataType)
        v = f"try_cast({c} AS TIMESTAMP_NTZ)" if text else c
        rng = df.selectExpr(f"CAST(max({v}) AS TIMESTAMP_NTZ) AS freshness_latest",
                            f"CAST(min({v}) AS TIMESTAMP_NTZ) AS freshness_oldest")
        named = sql_str(ts_column)
        if text:  # text that never parses is no timestamp
            named = f"CASE WHEN freshness_latest IS NOT NULL THEN {named} END"
        out = attach_scalars(out, rng).selectExpr(
            "*", f"{named} AS freshness_column",
            f"CAST(timestampdiff(MICROSECOND, freshness_latest, CAST({sql_str(as_of)} AS TIMESTAMP_NTZ)) AS DOUBLE)"
            " / 86400000000.0D AS freshness_age_days")
    else:
        out = out.selectExpr("*", "CAST(NULL AS STRING) AS freshness_column",
                             "CAST(NULL AS TIMESTAMP_NTZ) AS freshness_latest",
                             "CAST(NULL AS TIMESTAMP_NTZ) AS freshness_oldest",
                             "CAST(NULL AS DOUBLE) AS freshness_age_days")
    return out.selectExpr(f"{sql_str(table_name)} AS table_name", "row_count", "overall_completeness",
                          "CAST(columns_with_nulls AS BIGINT) AS columns_with_nulls", "max_null_pct", "pk_columns",
                          "unique_pk_rows", "pk_uniqueness_rate", "freshness_column", "freshness_latest",
                          "freshness_oldest", "freshness_age_days")


# Fixed values (ours): name fragments that mark a freshness column when none is given.
TIMESTAMP_NAME_HINTS = ("timestamp", "datetime", "date", "at", "time", "ts")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def pick_timestamp_column(df: DataFrame) -> str | None:
    """First timestamp/date-typed column; else the first string column one of whose name's
    parts ("created_at": created, at) is a hint. Its values are read as timestamps where
    they parse; a column of which none does has no freshness. Else None."""
    for f in df.schema.fields:
        if is_temporal_type(f.dataType):
            return f.name
    for f in df.schema.fields:
        parts = [p.lower() for p in _NAME_PART.findall(f.name)]
        if is_string_type(f.dataType) and any(p in TIMESTAMP_NAME_HINTS for p in parts) and parts[:1] != ["at"]:
            return f.name
    return None


def quality_report(tables: dict[str, DataFrame], pks: dict[str, list[str]], ts_columns: dict[str, str] | None,
                   as_of: str, counts: DataFrame | None = None) -> DataFrame:
    """Q13 for every table (one fused aggregate each), unioned. With ``ts_columns=None``
    the freshness column of each table is picked from its schema. ``counts``
    (``profile.quality_counts`` of the same tables) saves the null pass."""
    if ts_columns is None:
        ts_columns = {t: c for t, df in tables.items() if (c := pick_timestamp_column(df))}
    known = lambda t: None if counts is None else counts.where(F.col("table_name") == t).withColumnRenamed("row_count", "total_rows")
    parts = [table_quality(df, t, pks.get(t), ts_columns.get(t), as_of, known(t)) for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("freshness_age_days", round_half_up("freshness_age_days", 6))


def column_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Q13, per column: null_count, distinct_count, text min and max, mean and sample
    standard deviation (null where a column has no numbers)."""
    parts = [column_profile(df, metrics=("nulls", "distinct", "text_range", "moments")).select(
        F.lit(t).alias("table_name"), "ordinal", "column_name", "null_count", "distinct_count", "min_value", "max_value",
        round_half_up("mean_value", 4).alias("mean_value"), round_half_up("std_dev", 4).alias("std_dev"))
        for t, df in tables.items()]
    return union_all(parts)


def _pct_text(c: Column) -> Column:
    return F.concat(round_half_up(c * 100, 1).cast("string"), F.lit("%"))


def quality_summary(report: DataFrame) -> DataFrame:
    """Q14: completeness %, PK uniqueness % or 'N/A', latest record."""
    return report.select(
        "table_name", "row_count",
        _pct_text(F.col("overall_completeness")).alias("completeness"),
        F.coalesce(_pct_text(F.col("pk_uniqueness_rate")), F.lit("N/A")).alias("pk_uniqueness"),
        F.coalesce(F.date_format("freshness_latest", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("latest_record"))


def completeness_band(pct: Column) -> Column:
    return F.when(pct >= COMPLETENESS_GOOD, "good").when(pct >= COMPLETENESS_WARN, "warn").otherwise("bad")


def null_band(pct: Column) -> Column:
    return F.when(pct > NULL_PCT_BAD, "bad").when(pct > 0, "warn").otherwise("good")


def quality_bands(overview: DataFrame) -> DataFrame:
    """Q15: bands on the 1-dp percentages of ``quality_overview`` or ``null_overview`` rows."""
    comp = round_half_up(F.col("overall_completeness") * 100, 1)
    nul = round_half_up(F.col("null_rate") * 100, 1)
    return overview.select("table_name", "column_name", comp.alias("completeness_pct"),
                           completeness_band(comp).alias("completeness_band"), nul.alias("null_pct"),
                           null_band(nul).alias("null_band"))


def _details(table: Column, check: Column, issues: Column) -> Column:
    """``{"table":...,"check":...,"issues":n}`` built by concatenation, so the text is
    byte-identical whatever JSON writer reads it back."""
    return F.concat(F.lit('{"table":"'), table, F.lit('","check":"'), check, F.lit('","issues":'),
                    issues.cast("string"), F.lit("}"))


def dq_check_log(report: DataFrame, integrity: DataFrame | None) -> DataFrame:
    """Q16: table x {null_check, uniqueness_check, freshness_check,
    referential_integrity} -> pass / warning / fail with JSON details.

    Built from ``quality_report`` and ``referential_integrity`` outputs (thresholds
    are ours; the reference only fixes the vocabulary)."""
    t = F.col("table_name")
    nulls = report.select(t, F.lit("null_check").alias("check_type"),
                          F.when(F.col("columns_with_nulls") == 0, "pass")
                          .when(F.col("max_null_pct") <= NULL_PCT_BAD, "warning").otherwise("fail").alias("check_result"),
                          F.col("columns_with_nulls").cast("bigint").alias("issues"))
    uniq = report.where(F.col("pk_columns").isNotNull()).select(
        t, F.lit("uniqueness_check").alias("check_type"),
        F.when(F.col("unique_pk_rows") == F.col("row_count"), "pass")
        .when(F.col("pk_uniqueness_rate") >= UNIQUENESS_WARN, "warning").otherwise("fail").alias("check_result"),
        (F.col("row_count") - F.col("unique_pk_rows")).cast("bigint").alias("issues"))
    age = F.col("freshness_age_days")
    fresh = report.where(F.col("freshness_column").isNotNull()).select(
        t, F.lit("freshness_check").alias("check_type"),
        F.when(age <= FRESH_PASS_DAYS, "pass").when(age <= FRESH_WARN_DAYS, "warning").otherwise("fail")
        .alias("check_result"),
        F.floor(F.greatest(age, F.lit(0.0))).cast("bigint").alias("issues"))
    out = nulls.unionByName(uniq).unionByName(fresh)
    if integrity is not None:
        ri = integrity.groupBy(F.col("child_table").alias("table_name")).agg(
            F.sum("orphan_rows").cast("bigint").alias("issues")).select(
            t, F.lit("referential_integrity").alias("check_type"),
            F.when(F.col("issues") == 0, "pass").otherwise("fail").alias("check_result"), "issues")
        out = out.unionByName(ri)
    return out.select("table_name", "check_type", "check_result", "issues",
                      _details(F.col("table_name"), F.col("check_type"), F.col("issues")).alias("details"))

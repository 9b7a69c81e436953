"""Q1, Q2, Q5, Q12: column profiles from single-row aggregates.

Per-column metrics are aggregate expressions evaluated by single-row
aggregates (partial aggregation on every task, one small buffer merged at the
end — no shuffle of data). They are packed into codegen-sized chunks split by
column (see ``functions.aggregates``), with string-buffer aggregates (text
min/max) in chunks of their own. Distinct counts come from one pass of narrow
(ordinal, 128-bit hash) rows (``column_counts``), exact or as a bounded sketch. The
wide results become long form with ``inline(array(named_struct...))`` and are
matched on the column ordinal, a frame bounded by the schema width. Aggregates and
rows are written as SQL expression strings, so building the plan costs one driver
call per chunk.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, MapType, VariantType

from tablescope.functions.aggregates import FIELDS, chunked_agg_sql, long_rows_sql, union_all
from tablescope.functions.exprs import (
    completeness,
    is_boolean_type,
    is_numeric_type,
    is_orderable,
    is_string_type,
    is_temporal_type,
    rate_units,
    ratio,
    round_half_up,
    sql_ident,
    sql_ratio,
    sql_round_half_up,
    sql_str,
)

METRICS = ("nulls", "distinct", "text_range", "typed_range", "moments")
_WEIGHTS = {"nulls": FIELDS["count_if"], "text_range": 2 * FIELDS["min"], "typed_range": 2 * FIELDS["min"],
            "moments": FIELDS["avg"] + FIELDS["stddev"] + 2 * FIELDS["count"]}


def _moments(dt, name: str, i: int) -> list[str]:
    """Mean and sample stddev as double, or nulls (SQL expression strings).

    Numeric types cast directly. Strings count only when *every* non-null value
    casts (all-or-nothing, like a failed ``::numeric`` cast); ``try_cast`` keeps
    a bad value from failing the job under ANSI mode. Dates, timestamps,
    booleans and nested types get no moments.
    """
    c = sql_ident(name)
    if is_numeric_type(dt):
        return [f"avg(CAST({c} AS DOUBLE)) AS __m{i}", f"stddev_samp(CAST({c} AS DOUBLE)) AS __s{i}"]
    if is_string_type(dt):
        v = f"try_cast({c} AS DOUBLE)"
        guard = f"count({c}) = count({v})"
        return [f"CASE WHEN {guard} THEN avg({v}) END AS __m{i}",
                f"CASE WHEN {guard} THEN stddev_samp({v}) END AS __s{i}"]
    return [f"CAST(NULL AS DOUBLE) AS __m{i}", f"CAST(NULL AS DOUBLE) AS __s{i}"]


def _hashes_sql(name: str, dtype) -> tuple[str, str]:
    """Two independent 64-bit hashes of a value, null for null. Equal values hash alike:
    -0.0 as 0.0, maps by their sorted entries."""
    c = sql_ident(name)
    if isinstance(dtype, MapType):
        v = f"array_sort(map_entries({c}))"
    elif isinstance(dtype, (FloatType, DoubleType)):
        v = f"({c} + CAST(0 AS {dtype.simpleString()}))"
    elif isinstance(dtype, VariantType):
        v = f"to_json({c})"
    else:
        v = c
    return tuple(f"CASE WHEN {c} IS NOT NULL THEN {h} END" for h in (f"xxhash64({v})", f"xxhash64('second', {v})"))


def column_counts(df: DataFrame, columns: Iterable[str] | None = None, distinct: str = "exact",
                  rsd: float = 0.05) -> DataFrame:
    """Long form (ordinal, column_name, total_rows, null_count, distinct_count) in one scan.

    Every row becomes one narrow row a column: its ordinal and a 128-bit hash of the
    value, so long texts and arrays never travel. These are counted per (ordinal, hash)
    with map-side aggregation (a hot value is one row a task), and the counts give rows,
    nulls and distinct values at once. ``exact`` is exact up to a collision of 128-bit
    hashes; ``approx`` is HyperLogLog++ with relative standard deviation ``rsd`` and
    shuffles one sketch a column and task. The plan is the same for every size.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be 'exact' or 'approx'")
    cols = list(columns) if columns is not None else list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for i, c in enumerate(cols):
        h1, h2 = _hashes_sql(c, types[c])
        rows.append(f"named_struct('ordinal', {i + 1}, 'h1', {h1}, 'h2', {h2})")
    long = df.selectExpr(long_rows_sql(rows))
    if distinct == "exact":
        g = long.groupBy("ordinal", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).groupBy("ordinal").agg(
            F.sum("n").alias("total_rows"), F.sum(F.when(F.col("h1").isNull(), F.col("n"))).alias("null_count"),
            F.count("h1").alias("distinct_count"))
    else:
        g = long.groupBy("ordinal").agg(
            F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("h1").isNull()).alias("null_count"),
            F.approx_count_distinct("h1", rsd).alias("distinct_count"))
    names = df.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(cols)], "ordinal INT, column_name STRING")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return names.join(g, "ordinal", "left").select("ordinal", "column_name", zero("total_rows"), zero("null_count"),
                                                   zero("distinct_count"))


def _fixed_width(dt) -> bool:
    """Types whose min/max buffer is fixed-width, so a hash aggregate stays in codegen."""
    if isinstance(dt, DecimalType):
        return dt.precision <= 18
    return is_numeric_type(dt) or is_temporal_type(dt) or is_boolean_type(dt)


def column_profile(df: DataFrame, columns: Iterable[str] | None = None,
                   metrics: Iterable[str] = METRICS, distinct: str = "exact", rsd: float = 0.05) -> DataFrame:
    """Long-form profile: one row per column.

    Output: ordinal, column_name, total_rows, null_count, distinct_count,
    min_value, max_value (text form, lexicographic), min_typed, max_typed (text of
    the typed min/max), mean_value, std_dev. Metrics not requested are null.

    Aggregates with fixed-width buffers (null counts, moments, numeric/temporal
    min/max) and those with string buffers (text min/max) are packed into separate
    chunks: a string buffer makes Spark fall back to an interpreted sort-based
    aggregate, which would otherwise drag the numeric metrics out of codegen too.
    The parts are merged per column ordinal (a frame bounded by the column count).
    """
    cols = list(columns) if columns is not None else list(df.columns)
    if not cols:
        raise ValueError("no columns to profile")
    want = set(metrics)
    types = {f.name: f.dataType for f in df.schema.fields}
    fixed, fixed_w, strings, strings_w = [], [], [], []
    for i, name in enumerate(cols):
        c = sql_ident(name)
        dt = types[name]
        fg: list[str] = []
        sg: list[str] = []
        if "nulls" in want:
            fg.append(f"count_if({c} IS NULL) AS __n{i}")
        if "text_range" in want:
            sg += [f"min(CAST({c} AS STRING)) AS __lo{i}", f"max(CAST({c} AS STRING)) AS __hi{i}"]
        if "typed_range" in want and is_orderable(dt):
            rng = [f"min({c}) AS __tlo{i}", f"max({c}) AS __thi{i}"]
            (fg if _fixed_width(dt) else sg).extend(rng)
        if "moments" in want:
            fg += _moments(dt, name, i)
        fixed.append(fg)
        fixed_w.append(sum(_WEIGHTS[m] for m in ("nulls", "moments") if m in want)
                       + (_WEIGHTS["typed_range"] if "typed_range" in want and _fixed_width(dt) else 0))
        strings.append(sg)
        strings_w.append(len(sg))

    def pick(names: set[str], prefix: str, i: int, cast: str) -> str:
        n = f"{prefix}{i}"
        return f"CAST({n} AS {cast})" if n in names else f"CAST(NULL AS {cast})"

    def long_rows(groups, weights, with_total: bool) -> list[DataFrame]:
        parts = []
        common = ["count(1) AS __total"] if with_total else []
        for idx, wide in chunked_agg_sql(df, groups, weights, common=common):
            if not with_total and not any(groups[i] for i in idx):
                continue
            names = {e.rsplit(" AS ", 1)[1] for i in idx for e in groups[i]}
            total = "__total" if with_total else "CAST(NULL AS BIGINT)"
            structs = [
                f"named_struct('ordinal', {i + 1}, 'column_name', {sql_str(cols[i])}, 'total_rows', {total}, "
                f"'null_count', {pick(names, '__n', i, 'BIGINT')}, "
                f"'min_value', {pick(names, '__lo', i, 'STRING')}, 'max_value', {pick(names, '__hi', i, 'STRING')}, "
                f"'min_typed', {pick(names, '__tlo', i, 'STRING')}, 'max_typed', {pick(names, '__thi', i, 'STRING')}, "
                f"'mean_value', {pick(names, '__m', i, 'DOUBLE')}, 'std_dev', {pick(names, '__s', i, 'DOUBLE')})"
                for i in (idx or range(len(cols)))]
            parts.append(wide.selectExpr(long_rows_sql(structs)))
        return parts

    parts = long_rows(fixed, fixed_w, with_total=True)
    string_parts = long_rows(strings, strings_w, with_total=False) if any(strings) else []
    long = union_all(parts)
    if string_parts:
        fields = ["total_rows", "null_count", "min_value", "max_value", "min_typed", "max_typed", "mean_value",
                  "std_dev"]
        # each field is non-null in exactly one part per column; max() picks it
        long = union_all([long] + string_parts).groupBy("ordinal", "column_name").agg(
            *[F.max(f).alias(f) for f in fields])
    if "distinct" in want:
        d = column_counts(df, cols, distinct, rsd).select("ordinal", "distinct_count")
        long = long.join(d, "ordinal", "left")  # one row per column on both sides
    else:
        long = long.withColumn("distinct_count", F.lit(None).cast("bigint"))
    return long.select("ordinal", "column_name", "total_rows", "null_count", "distinct_count", "min_value",
                       "max_value", "min_typed", "max_typed", "mean_value", "std_dev")


def column_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Q1: total_rows, null_count, null_rate (4 dp) per column.

    An empty table reports 0 rows and a null rate of null (not the 0/1 trick).
    """
    p = column_profile(df, columns, metrics=("nulls",))
    return p.select(
        "ordinal", "column_name", "total_rows", "null_count",
        round_half_up(ratio("null_count", "total_rows"), 4).alias("null_rate"),
    )


def column_stats(df: DataFrame, columns: Iterable[str] | None = None, distinct: str = "exact") -> DataFrame:
    """Q2: distinct_count, text min/max, typed min/max, mean and sample stddev."""
    p = column_profile(df, columns, metrics=("distinct", "text_range", "typed_range", "moments"), distinct=distinct)
    return p.select("ordinal", "column_name", "distinct_count", "min_value", "max_value",
                    "min_typed", "max_typed", "mean_value", "std_dev")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (ordinal, column_name, total_rows, null_count, null_rate[4 dp, 0 when
    empty]). Built from the same chunked aggregates as ``column_profile(metrics=("nulls",))``
    so plans that need both share one computation (exchange reuse)."""
    p = column_profile(df, columns, metrics=("nulls",))
    rate = sql_round_half_up(sql_ratio("null_count", "total_rows"), 4)
    return p.selectExpr("ordinal", "column_name", "total_rows", "null_count", f"coalesce({rate}, 0.0D) AS null_rate")


def table_completeness(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Q5: per-column null rate (4 dp) and overall = round(1 - mean(rounded rates), 4).

    The overall value is a mean over the long frame (one row per column). An
    empty table has rates 0.0 and completeness 1.0.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    rates = null_rates(df, cols).drop("null_count")
    # the window spans one row per column (bounded by the schema width)
    overall = completeness(F.sum(rate_units("null_rate")).over(Window.partitionBy()), len(cols))
    return rates.select("total_rows", overall.alias("overall_completeness"), "ordinal", "column_name", "null_rate")


def quality_counts(tables: dict[str, DataFrame], distinct: str = "exact", schema_name: str = "main") -> DataFrame:
    """Per table and column: row, null and distinct counts, null rate (4 dp) and the
    table's completeness. One scan per table; every other quality record can be derived
    from it."""
    parts = []
    for tname, df in tables.items():
        rate = F.coalesce(round_half_up(ratio("null_count", "total_rows"), 4), F.lit(0.0))
        p = column_counts(df, distinct=distinct).withColumn("null_rate", rate)
        # one row per column: the window is bounded by the schema width
        overall = completeness(F.sum(rate_units("null_rate")).over(Window.partitionBy()), len(df.columns))
        parts.append(p.select(
            F.lit(schema_name).alias("schema_name"), F.lit(tname).alias("table_name"),
            F.col("total_rows").alias("row_count"), overall.alias("overall_completeness"),
            "ordinal", "column_name", "null_count", "null_rate", "distinct_count"))
    return union_all(parts)


def quality_overview(tables: dict[str, DataFrame], distinct: str = "exact", schema_name: str = "main",
                     skip_empty: bool = True) -> DataFrame:
    """Q12: per table and column: null_rate (4 dp), distinct_count, completeness.

    Empty tables are skipped, as in the dashboard (unless ``skip_empty=False``).
    ``distinct="approx"`` (HyperLogLog++) for very large data.
    """
    out = quality_counts(tables, distinct, schema_name).drop("null_count")
    return out.where(F.col("row_count") > 0) if skip_empty else out


def null_overview(tables: dict[str, DataFrame], skip_empty: bool = True) -> DataFrame:
    """The part of ``quality_overview`` that needs null counts only: no distinct pass."""
    parts = []
    for tname, df in tables.items():
        p = table_completeness(df).select(F.lit(tname).alias("table_name"), F.col("total_rows").alias("row_count"),
                                          "overall_completeness", "column_name", "null_rate")
        parts.append(p.where(F.col("row_count") > 0) if skip_empty else p)
    return union_all(parts)

"""Registered profiling / quality queries (Q1-Q16, J6) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions import ranks
from tablescope.functions.exprs import round_half_up
from tablescope.operators import benford, correlation, distribution, freshness, keys, outliers, profile, report
from tablescope.operators.constraints import ForeignKey, foreign_keys, primary_keys
from tablescope.plans import bindings as B
from tablescope.plans.base import (
    ALL_TABLES,
    DOC_LABEL_COLUMNS,
    DOC_LABEL_SQL,
    R,
    TABLE_COLUMNS,
    q,
    query,
    tables,
    union_all,
)

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]
DOC_TEXT = ["text", "lang", "source"]
PK_TABLES = [("orders", ["o_orderkey"]), ("customer", ["c_custkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]),
             ("conversations", ["conv_id", "turn"])]
FRESH = [("events", "ts", B.AS_OF_EVENTS), ("orders", "o_orderdate", B.AS_OF_ORDERS)]
BENFORD = [("events", "value"), ("lineitem", "l_extendedprice")]
CORR_COLS = LINEITEM_NUMERIC + ["l_net", "l_const"]


def completeness_sql(rates: list[str]) -> str:
    """SQL twin of ``functions.exprs.completeness`` over 4-dp rates."""
    units = " + ".join(f"floor(CAST({r} AS DOUBLE) * 10000 + 0.5)" for r in rates)
    return R(f"1.0 - (CAST(({units}) AS DOUBLE) / 10000.0) / {float(len(rates))}", 4)


def _doc_labels(spark, sf):
    t = tables(spark, sf, "documents", "labels")
    return B.documents_with_labels(t["documents"], t["labels"])


# --- Q1 -------------------------------------------------------------------------------

def _sql_column_nulls() -> str:
    parts = [f"SELECT {i + 1} AS ordinal, {q(c)} AS column_name, count(*) AS total_rows, "
             f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
             f"{R(f'(count(*) FILTER (WHERE {c} IS NULL)) / count(*)', 4)} AS null_rate FROM {DOC_LABEL_SQL} d"
             for i, c in enumerate(DOC_LABEL_COLUMNS)]
    return union_all(parts)


@query("column_nulls", _sql_column_nulls())
def q_column_nulls(spark, sf):
    return profile.column_nulls(_doc_labels(spark, sf))


# --- Q2 -------------------------------------------------------------------------------

def _sql_stats(table: str, cols: list[str], numeric: bool) -> str:
    parts = []
    for i, c in enumerate(cols):
        if numeric:
            mean, sd = f"avg(CAST({c} AS DOUBLE))", f"stddev_samp(CAST({c} AS DOUBLE))"
        else:
            guard = f"count({c}) = count(TRY_CAST({c} AS DOUBLE))"
            mean = f"CASE WHEN {guard} THEN avg(TRY_CAST({c} AS DOUBLE)) END"
            sd = f"CASE WHEN {guard} THEN stddev_samp(TRY_CAST({c} AS DOUBLE)) END"
        parts.append(
            f"SELECT {i + 1} AS ordinal, {q(c)} AS column_name, count(DISTINCT {c}) AS distinct_count, "
            f"min(CAST({c} AS VARCHAR)) AS min_value, max(CAST({c} AS VARCHAR)) AS max_value, "
            f"CAST(min({c}) AS VARCHAR) AS min_typed, CAST(max({c}) AS VARCHAR) AS max_typed, "
            f"{R(mean, 4)} AS mean_value, {R(sd, 4)} AS std_dev FROM {table}")
    return union_all(parts)


def _rounded_stats(df):
    return df.withColumn("mean_value", round_half_up("mean_value", 4)).withColumn("std_dev",
                                                                                 round_half_up("std_dev", 4))


@query("column_stats_numeric", _sql_stats("lineitem", LINEITEM_NUMERIC, True))
def q_column_stats_numeric(spark, sf):
    return _rounded_stats(profile.column_stats(tables(spark, sf, "lineitem")["lineitem"], LINEITEM_NUMERIC))


@query("column_stats_text", _sql_stats("documents", DOC_TEXT, False))
def q_column_stats_text(spark, sf):
    return _rounded_stats(profile.column_stats(tables(spark, sf, "documents")["documents"], DOC_TEXT))


# --- Q3 -------------------------------------------------------------------------------

def _sql_pk() -> str:
    parts = []
    for t, pk in PK_TABLES:
        cols = ", ".join(pk)
        u = f"(SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {t}))"
        parts.append(f"SELECT {q(t)} AS table_name, {q(','.join(pk))} AS pk_columns, count(*) AS total_rows, "
                     f"{u} AS unique_pk_rows, count(*) - {u} AS duplicate_rows, "
                     f"{R(f'{u} / count(*)', 4)} AS uniqueness_rate FROM {t}")
    return union_all(parts)


@query("pk_uniqueness", _sql_pk())
def q_pk_uniqueness(spark, sf):
    t = tables(spark, sf, *[n for n, _ in PK_TABLES])
    out = None
    for n, pk in PK_TABLES:
        p = keys.pk_uniqueness(t[n], pk, n)
        out = p if out is None else out.unionByName(p)
    return out


# --- Q4 -------------------------------------------------------------------------------

def _sql_freshness() -> str:
    return union_all([
        f"SELECT {q(t)} AS table_name, {q(c)} AS timestamp_column, max({c}) AS latest_record, "
        f"min({c}) AS oldest_record, "
        f"{R(f'(epoch_us(TIMESTAMP {q(a)}) - epoch_us(max({c}))) / 86400000000.0', 6)} AS age_days FROM {t}"
        for t, c, a in FRESH])


@query("freshness", _sql_freshness())
def q_freshness(spark, sf):
    t = tables(spark, sf, "events", "orders")
    out = None
    for n, c, a in FRESH:
        f = freshness.freshness(t[n], c, a, n).withColumn("age_days", round_half_up("age_days", 6))
        out = f if out is None else out.unionByName(f)
    return out


# --- Q5 -------------------------------------------------------------------------------

def _sql_completeness() -> str:
    rates = ", ".join(f"coalesce({R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 4)}, 0.0) AS r{i}"
                      for i, c in enumerate(DOC_LABEL_COLUMNS))
    overall = completeness_sql([f"r{i}" for i in range(len(DOC_LABEL_COLUMNS))])
    head = f"WITH w AS (SELECT count(*) AS total_rows, {rates} FROM {DOC_LABEL_SQL} d)\n"
    return head + union_all([
        f"SELECT total_rows, {overall} AS overall_completeness, {i + 1} AS ordinal, {q(c)} AS column_name, "
        f"CAST(r{i} AS DOUBLE) AS null_rate FROM w" for i, c in enumerate(DOC_LABEL_COLUMNS)])


@query("table_completeness", _sql_completeness())
def q_table_completeness(spark, sf):
    return profile.table_completeness(_doc_labels(spark, sf))


# --- Q6 / Q7 ----------------------------------------------------------------------------

_EV = ("v AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL), "
       "s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM v)")

SQL_ZSCORE = f"""WITH {_EV}
SELECT 'events' AS table_name, 'value' AS column_name, CAST(3.0 AS DOUBLE) AS threshold,
  {R('coalesce(m, 0)', 4)} AS mean, {R('coalesce(sd, 0)', 4)} AS stddev, count(*) AS total_rows,
  CAST(CASE WHEN sd IS NULL OR sd = 0 THEN 0 ELSE count(*) FILTER (WHERE abs((x - m) / sd) > 3.0) END AS BIGINT)
    AS outlier_count,
  coalesce({R('CAST(CASE WHEN sd IS NULL OR sd = 0 THEN 0 ELSE count(*) FILTER (WHERE abs((x - m) / sd) > 3.0) END * 100 AS DOUBLE) / count(*)', 2)}, 0.0)
    AS outlier_percentage,
  CASE WHEN sd IS NULL OR sd = 0 THEN {q(outliers.ZERO_STDDEV_NOTE)} END AS note
FROM v, s GROUP BY m, sd"""

SQL_ZSAMPLE = f"""WITH {_EV}
SELECT x AS value, {R('abs((x - m) / sd)', 2)} AS zscore FROM v, s
WHERE abs((x - m) / sd) > 3.0 ORDER BY abs((x - m) / sd) DESC, x ASC LIMIT 5"""

SQL_IQR = f"""WITH v AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
p AS (SELECT coalesce(quantile_cont(x, 0.25), 0) AS q1, coalesce(quantile_cont(x, 0.75), 0) AS q3 FROM v),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM p)
SELECT 'events' AS table_name, 'value' AS column_name, CAST(1.5 AS DOUBLE) AS multiplier,
  {R('q1', 4)} AS q1, {R('q3', 4)} AS q3, {R('iqr', 4)} AS iqr, {R('lo', 4)} AS lower_bound,
  {R('hi', 4)} AS upper_bound, count(*) AS total_rows, count(*) FILTER (WHERE x < lo OR x > hi) AS outlier_count,
  coalesce({R('CAST(count(*) FILTER (WHERE x < lo OR x > hi) * 100 AS DOUBLE) / count(*)', 2)}, 0.0)
    AS outlier_percentage
FROM v, b GROUP BY q1, q3, iqr, lo, hi"""


@query("outliers_zscore", SQL_ZSCORE)
def q_outliers_zscore(spark, sf):
    return outliers.outliers_zscore(tables(spark, sf, "events")["events"], "value", 3.0, "events")


@query("outliers_zscore_sample", SQL_ZSAMPLE)
def q_outliers_zscore_sample(spark, sf):
    return outliers.outliers_zscore_sample(tables(spark, sf, "events")["events"], "value", 3.0, 5)


@query("outliers_iqr", SQL_IQR)
def q_outliers_iqr(spark, sf):
    return outliers.outliers_iqr(tables(spark, sf, "events")["events"], "value", 1.5, table_name="events")


# every row's exact rank by its value (largest first) and percent rank
@query("value_ranks", f"""SELECT event_id, value, CASE WHEN value IS NOT NULL THEN rank() OVER w END AS rank,
  CASE WHEN value IS NOT NULL THEN {R('percent_rank() OVER w', 6)} END AS percent_rank
FROM events WINDOW w AS (PARTITION BY value IS NULL ORDER BY value DESC)""")
def q_value_ranks(spark, sf):
    ev = tables(spark, sf, "events")["events"].select("event_id", "value")
    return ranks.with_ranks(ev, "value", descending=True).withColumn("percent_rank", round_half_up("percent_rank", 6))


# --- Q8 -------------------------------------------------------------------------------

SQL_DISTRIBUTION = f"""WITH v AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
a AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, var_samp(x) AS var, min(x) AS lo, max(x) AS hi,
        quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50,
        quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90 FROM v),
m AS (SELECT avg(power(x - a.mean, 3)) AS m3, avg(power(x - a.mean, 4)) AS m4 FROM v, a),
k AS (SELECT a.*, coalesce(m3 / nullif(power(sd, 3), 0), 0) AS skew,
        coalesce(m4 / nullif(power(sd, 4), 0) - 3, 0) AS kurt FROM a, m)
SELECT 'events' AS table_name, 'value' AS column_name, n AS total_rows, {R('mean', 4)} AS mean,
  {R('p50', 4)} AS median, {R('sd', 4)} AS stddev, {R('var', 4)} AS variance, {R('lo', 4)} AS "min",
  {R('hi', 4)} AS "max", {R('hi - lo', 4)} AS "range", {R('skew', 4)} AS skewness,
  (CASE WHEN abs(skew) < 0.5 THEN 'symmetric' WHEN abs(skew) < 1 THEN 'moderately skewed' ELSE 'highly skewed' END)
    || ' (' || (CASE WHEN skew > 0 THEN 'right' WHEN skew < 0 THEN 'left' ELSE 'none' END) || ')'
    AS skewness_interpretation,
  {R('kurt', 4)} AS kurtosis,
  CASE WHEN abs(kurt) < 1 THEN 'mesokurtic (normal)' WHEN kurt > 1 THEN 'leptokurtic (heavy tails)'
       ELSE 'platykurtic (light tails)' END AS kurtosis_interpretation,
  {R('p10', 4)} AS p10, {R('p25', 4)} AS p25, {R('p50', 4)} AS p50, {R('p75', 4)} AS p75, {R('p90', 4)} AS p90
FROM k"""


@query("distribution_stats", SQL_DISTRIBUTION)
def q_distribution_stats(spark, sf):
    return distribution.distribution_stats(tables(spark, sf, "events")["events"], "value", table_name="events")


# --- Q9 -------------------------------------------------------------------------------

_EXPECTED = "e(digit, expected) AS (SELECT * FROM (VALUES " + ", ".join(
    f"({d}, CAST({p} AS DOUBLE))" for d, p in benford.BENFORD_EXPECTED.items()) + "))"


def _benford_cte(t: str, c: str) -> str:
    return (f"WITH {_EXPECTED}, c AS (SELECT CAST(left(CAST({c} AS VARCHAR), 1) AS INTEGER) AS digit, "
            f"count(*) AS cnt FROM {t} WHERE {c} IS NOT NULL AND CAST({c} AS DOUBLE) >= 1 GROUP BY 1), "
            f"j AS (SELECT e.digit, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt, e.expected, "
            f"sum(coalesce(c.cnt, 0)) OVER () AS total FROM e LEFT JOIN c ON e.digit = c.digit)")


def _sql_benford_digits() -> str:
    parts = []
    for t, c in BENFORD:
        obs = "coalesce(CAST(cnt AS DOUBLE) / CAST(total AS DOUBLE), 0.0)"
        parts.append(f"SELECT * FROM ({_benford_cte(t, c)} SELECT {q(t)} AS table_name, {q(c)} AS column_name, "
                     f"digit, cnt AS count, {R(obs + ' * 100', 2)} AS observed_pct, "
                     f"{R('expected * 100', 2)} AS expected_pct, {R(f'({obs} - expected) * 100', 2)} AS deviation "
                     f"FROM j)")
    return union_all(parts)


def _sql_benford_summary() -> str:
    parts = []
    lvl = ("CASE WHEN total_values_analyzed = 0 THEN NULL WHEN coalesce(chi_obs, 0) < 15.5 THEN 'low' "
           "WHEN coalesce(chi_obs, 0) < 20.1 THEN 'moderate' ELSE 'high' END")
    msg = "CASE " + " ".join(f"WHEN {lvl} = {q(k)} THEN {q(v)}" for k, v in benford.RISK_MESSAGES.items()) + " END"
    for t, c in BENFORD:
        parts.append(
            f"SELECT * FROM ({_benford_cte(t, c)}, "
            f"x AS (SELECT digit, CAST(cnt AS DOUBLE) AS o, expected * total AS ex FROM j), "
            f"a AS (SELECT CAST(sum(o) AS BIGINT) AS total_values_analyzed, "
            f"sum(CASE WHEN o > 0 THEN power(o - ex, 2) / nullif(ex, 0) END) AS chi_obs, "
            f"sum(power(o - ex, 2) / nullif(ex, 0)) AS chi_full, count(*) FILTER (WHERE o > 0) AS digits_observed "
            f"FROM x) "
            f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, total_values_analyzed, digits_observed, "
            f"CASE WHEN total_values_analyzed > 0 THEN {R('coalesce(chi_obs, 0)', 4)} END AS chi_square_statistic, "
            f"CASE WHEN total_values_analyzed > 0 THEN {R('chi_full', 4)} END AS chi_square_full, "
            f"{lvl} AS risk_level, {msg} AS risk_message FROM a)")
    return union_all(parts)


@query("benford_digits", _sql_benford_digits())
def q_benford_digits(spark, sf):
    t = tables(spark, sf, "events", "lineitem")
    return benford.benford_digits(t["events"], "value", "events").unionByName(
        benford.benford_digits(t["lineitem"], "l_extendedprice", "lineitem"))


@query("benford_summary", _sql_benford_summary())
def q_benford_summary(spark, sf):
    t = tables(spark, sf, "events", "lineitem")
    return benford.benford_summary(t["events"], "value", "events").unionByName(
        benford.benford_summary(t["lineitem"], "l_extendedprice", "lineitem"))


# --- Q10 / Q11 --------------------------------------------------------------------------

def _lineitem_const(spark, sf):
    li = tables(spark, sf, "lineitem")["lineitem"]
    return li.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("l_const", F.lit(1.0))


def _corr_wide_sql() -> str:
    exprs = []
    for i, a in enumerate(CORR_COLS):
        for j in range(i + 1, len(CORR_COLS)):
            b = CORR_COLS[j]
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            exprs.append(
                f"covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / nullif("
                f"stddev_samp(CASE WHEN {both} THEN CAST({a} AS DOUBLE) END) * "
                f"stddev_samp(CASE WHEN {both} THEN CAST({b} AS DOUBLE) END), 0) AS r_{i}_{j}")
    return (f"w AS (SELECT {', '.join(exprs)} FROM (SELECT *, l_extendedprice * (1 - l_discount) AS l_net, CAST(1.0 AS DOUBLE) AS l_const FROM lineitem))")


def _sql_corr_matrix() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j in range(i + 1, len(CORR_COLS)):
            b = CORR_COLS[j]
            r = R(f"coalesce(r_{i}_{j}, 0)", 4)
            parts.append(f"SELECT {q(a)} AS column_1, {q(b)} AS column_2, {r} AS correlation FROM w")
            parts.append(f"SELECT {q(b)} AS column_1, {q(a)} AS column_2, {r} AS correlation FROM w")
    for a in CORR_COLS:
        parts.append(f"SELECT {q(a)} AS column_1, {q(a)} AS column_2, CAST(1.0 AS DOUBLE) AS correlation")
    return f"WITH {_corr_wide_sql()}\n" + union_all(parts)


def _sql_corr_pairs() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j in range(i + 1, len(CORR_COLS)):
            b = CORR_COLS[j]
            parts.append(f"SELECT {q(a)} AS column_1, {q(b)} AS column_2, coalesce(r_{i}_{j}, 0) AS r FROM w")
    return (f"WITH {_corr_wide_sql()}, p AS ({union_all(parts)})\n"
            f"SELECT column_1, column_2, {R('r', 4)} AS correlation, "
            f"CASE WHEN abs(r) > 0.7 THEN (CASE WHEN r > 0.7 THEN 'strong positive' ELSE 'strong negative' END) "
            f"WHEN abs(r) > 0.5 THEN (CASE WHEN r > 0.5 THEN 'moderate positive' ELSE 'moderate negative' END) END "
            f"AS strength FROM p WHERE abs(r) > 0.5")


@query("correlation_matrix", _sql_corr_matrix())
def q_correlation_matrix(spark, sf):
    return correlation.correlation_matrix(_lineitem_const(spark, sf), CORR_COLS)


@query("correlation_pairs", _sql_corr_pairs())
def q_correlation_pairs(spark, sf):
    return correlation.correlation_pairs(_lineitem_const(spark, sf), CORR_COLS)


# --- Q12 ------------------------------------------------------------------------------

def _sql_quality_overview() -> str:
    parts = []
    for t in ALL_TABLES:
        cols = [c for c, _ in TABLE_COLUMNS[t]]
        rates = [R(f"(count(*) FILTER (WHERE {c} IS NULL)) / count(*)", 4) for c in cols]
        overall = completeness_sql(rates)
        for i, c in enumerate(cols):
            parts.append(f"SELECT 'main' AS schema_name, {q(t)} AS table_name, count(*) AS row_count, "
                         f"{overall} AS overall_completeness, {i + 1} AS ordinal, {q(c)} AS column_name, "
                         f"{rates[i]} AS null_rate, count(DISTINCT {c}) AS distinct_count FROM {t} "
                         f"HAVING count(*) > 0")
    return union_all(parts)


SQL_QUALITY_OVERVIEW = _sql_quality_overview()


@query("quality_overview", SQL_QUALITY_OVERVIEW)
def q_quality_overview(spark, sf):
    return profile.quality_overview(tables(spark, sf))


# --- Q13-Q16, J6 ------------------------------------------------------------------------

REPORT_AS_OF = B.AS_OF_EVENTS


def _pk_map() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in sorted(B.CONSTRAINT_ROWS, key=lambda r: (r[0], r[2], r[3])):
        if r[1] == "pk":
            out.setdefault(r[0], []).append(r[4])
    return out


def _fk_list() -> list[ForeignKey]:
    groups: dict[tuple[str, str], list] = {}
    for r in sorted(B.CONSTRAINT_ROWS, key=lambda r: (r[0], r[2], r[3])):
        if r[1] == "fk":
            groups.setdefault((r[0], r[2]), []).append(r)
    return [ForeignKey(n, t, tuple(r[4] for r in rs), rs[0][5], tuple(r[6] for r in rs))
            for (t, n), rs in sorted(groups.items())]


def _report(spark, sf):
    t = tables(spark, sf)
    cons = B.constraints(spark)
    return t, cons, report.quality_report(t, primary_keys(cons), B.TS_COLUMNS, REPORT_AS_OF)


def _sql_report_table(t: str) -> str:
    cols = [c for c, _ in TABLE_COLUMNS[t]]
    pk = _pk_map().get(t)
    ts = B.TS_COLUMNS.get(t)
    rates = [f"coalesce({R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 4)}, 0.0)" for c in cols]
    overall = completeness_sql(rates)
    nnull = " + ".join(f"(CASE WHEN {r} > 0 THEN 1 ELSE 0 END)" for r in rates)
    maxr = f"greatest({', '.join(rates)})" if len(rates) > 1 else rates[0]
    if pk:
        u = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(pk)} FROM {t}))"
        pk_sql = f"{q(','.join(pk))} AS pk_columns, {u} AS unique_pk_rows, {R(f'{u} / count(*)', 4)} AS pk_uniqueness_rate"
    else:
        pk_sql = ("CAST(NULL AS VARCHAR) AS pk_columns, CAST(NULL AS BIGINT) AS unique_pk_rows, "
                  "CAST(NULL AS DOUBLE) AS pk_uniqueness_rate")
    if ts:
        ts_sql = (f"{q(ts)} AS freshness_column, max({ts}) AS freshness_latest, min({ts}) AS freshness_oldest, "
                  f"{R(f'(epoch_us(TIMESTAMP {q(REPORT_AS_OF)}) - epoch_us(max({ts}))) / 86400000000.0', 6)} "
                  f"AS freshness_age_days")
    else:
        ts_sql = ("CAST(NULL AS VARCHAR) AS freshness_column, CAST(NULL AS TIMESTAMP) AS freshness_latest, "
                  "CAST(NULL AS TIMESTAMP) AS freshness_oldest, CAST(NULL AS DOUBLE) AS freshness_age_days")
    return (f"SELECT {q(t)} AS table_name, count(*) AS row_count, {overall} AS overall_completeness, "
            f"CAST({nnull} AS BIGINT) AS columns_with_nulls, {R(f'{maxr} * 100', 1)} AS max_null_pct, "
            f"{pk_sql}, {ts_sql} FROM {t}")


SQL_REPORT = union_all([_sql_report_table(t) for t in ALL_TABLES])


@query("quality_report", SQL_REPORT)
def q_quality_report(spark, sf):
    return _report(spark, sf)[2]


def _pct_sql(c: str) -> str:
    return f"CAST({R(f'{c} * 100', 1)} AS VARCHAR) || '%'"


REPORTED = ("customer", "orders", "events", "labels", "nation")


def _sql_column_report(t: str) -> list[str]:
    out = []
    for i, (c, ty) in enumerate(TABLE_COLUMNS[t]):
        number = ty in ("BIGINT", "INTEGER", "DOUBLE")
        moments = [R(f"{f}(CAST({c} AS DOUBLE))", 4) if number else "CAST(NULL AS DOUBLE)" for f in ("avg", "stddev_samp")]
        text = f"CAST({c} AS VARCHAR)"
        out.append(f"SELECT {q(t)} AS table_name, {i + 1} AS ordinal, {q(c)} AS column_name, count(*) - count({c}) AS null_count, "
                   f"count(DISTINCT {c}) AS distinct_count, min({text}) AS min_value, max({text}) AS max_value, "
                   f"{moments[0]} AS mean_value, {moments[1]} AS std_dev FROM {t}")
    return out


@query("quality_report_columns", union_all([x for t in REPORTED for x in _sql_column_report(t)]))
def q_quality_report_columns(spark, sf):
    return report.column_report(tables(spark, sf, *REPORTED))


@query("quality_summary", f"""WITH r AS ({SQL_REPORT})
SELECT table_name, row_count, {_pct_sql('overall_completeness')} AS completeness,
  coalesce({_pct_sql('pk_uniqueness_rate')}, 'N/A') AS pk_uniqueness,
  coalesce(strftime(freshness_latest, '%Y-%m-%d %H:%M:%S'), 'N/A') AS latest_record FROM r""")
def q_quality_summary(spark, sf):
    return report.quality_summary(_report(spark, sf)[2])


@query("quality_bands", f"""WITH o AS ({SQL_QUALITY_OVERVIEW}),
b AS (SELECT table_name, column_name, {R('overall_completeness * 100', 1)} AS completeness_pct,
        {R('null_rate * 100', 1)} AS null_pct FROM o)
SELECT table_name, column_name, completeness_pct,
  CASE WHEN completeness_pct >= 95.0 THEN 'good' WHEN completeness_pct >= 80.0 THEN 'warn' ELSE 'bad' END
    AS completeness_band, null_pct,
  CASE WHEN null_pct > 10.0 THEN 'bad' WHEN null_pct > 0 THEN 'warn' ELSE 'good' END AS null_band FROM b""")
def q_quality_bands(spark, sf):
    return report.quality_bands(profile.null_overview(tables(spark, sf)))


def _fk_checks() -> list[ForeignKey]:
    name, child, cols, parent, pcols = B.DOC_LABEL_FK
    return _fk_list() + [ForeignKey(name, child, cols, parent, pcols)]


def _sql_integrity(fks: list[ForeignKey]) -> str:
    parts = []
    for fk in fks:
        nn = " AND ".join(f"c.{c} IS NOT NULL" for c in fk.columns)
        on = " AND ".join(f"c.{c} = p.{rc}" for c, rc in fk.pairs)
        keycols = ", ".join(f"c.{c}" for c in fk.columns)
        orph = (f"FROM {fk.table} c WHERE {nn} AND NOT EXISTS (SELECT 1 FROM {fk.ref_table} p WHERE {on})")
        parts.append(
            f"SELECT {q(fk.name)} AS constraint_name, {q(fk.table)} AS child_table, "
            f"{q(','.join(fk.columns))} AS child_columns, {q(fk.ref_table)} AS parent_table, "
            f"{q(','.join(fk.ref_columns))} AS parent_columns, "
            f"(SELECT count(*) FROM {fk.table}) AS child_rows, "
            f"(SELECT count(*) FROM {fk.table} c WHERE NOT ({nn})) AS null_fk_rows, "
            f"(SELECT count(*) {orph}) AS orphan_rows, "
            f"(SELECT count(*) FROM (SELECT DISTINCT {keycols} {orph})) AS orphan_keys, "
            f"CASE WHEN (SELECT count(*) {orph}) = 0 THEN 'pass' ELSE 'fail' END AS result")
    return union_all(parts)


@query("referential_integrity", _sql_integrity(_fk_checks()))
def q_referential_integrity(spark, sf):
    return keys.referential_integrity(tables(spark, sf), _fk_checks())


@query("dq_check_log", f"""WITH r AS ({SQL_REPORT}), ri AS ({_sql_integrity(_fk_list())}),
c AS (
  SELECT table_name, 'null_check' AS check_type,
    CASE WHEN columns_with_nulls = 0 THEN 'pass' WHEN max_null_pct <= 10.0 THEN 'warning' ELSE 'fail' END
      AS check_result, CAST(columns_with_nulls AS BIGINT) AS issues FROM r
  UNION ALL
  SELECT table_name, 'uniqueness_check',
    CASE WHEN unique_pk_rows = row_count THEN 'pass' WHEN pk_uniqueness_rate >= 0.95 THEN 'warning' ELSE 'fail' END,
    CAST(row_count - unique_pk_rows AS BIGINT) FROM r WHERE pk_columns IS NOT NULL
  UNION ALL
  SELECT table_name, 'freshness_check',
    CASE WHEN freshness_age_days <= 1.0 THEN 'pass' WHEN freshness_age_days <= 7.0 THEN 'warning' ELSE 'fail' END,
    CAST(floor(greatest(freshness_age_days, 0.0)) AS BIGINT) FROM r WHERE freshness_column IS NOT NULL
  UNION ALL
  SELECT child_table, 'referential_integrity', CASE WHEN sum(orphan_rows) = 0 THEN 'pass' ELSE 'fail' END,
    CAST(sum(orphan_rows) AS BIGINT) FROM ri GROUP BY child_table)
SELECT table_name, check_type, check_result, issues,
  '{{"table":"' || table_name || '","check":"' || check_type || '","issues":' || CAST(issues AS VARCHAR) || '}}'
    AS details FROM c""")
def q_dq_check_log(spark, sf):
    t, cons, rep = _report(spark, sf)
    return report.dq_check_log(rep, keys.referential_integrity(t, foreign_keys(cons)))

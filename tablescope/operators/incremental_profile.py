"""Q2/Q12 kept up to date: profiles of partitions that merge into the profile of a table.

Every partition of a table stored as ``<column>=<value>`` folders has one stored row a
column: counts, smallest and largest value, mean and sum of squared deviations, a HyperLogLog
sketch of the distinct values and a KLL sketch of the quantiles. Rows of all partitions merge
exactly (counts, range, moments by the parallel formula) or within the sketches' errors
(DISTINCT_ERROR, QUANTILE_ERROR: three standard errors). A run reads only partitions whose files
are new or other than at the last run; which ones follows from the files' names, sizes and
times, without reading a column. It rewrites their rows alone, so a run that is repeated after
a lost executor or driver gives the same store.

Numbers have mean, deviation and quantiles; NaN makes them NaN, as Q2's. Values are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.aggregates import long_rows_sql
from tablescope.functions.exprs import is_numeric_type, is_orderable, sql_ident, sql_str
from tablescope.operators.fingerprint import _hashable

#: Log2 of the HyperLogLog buckets (standard error 1.04 / sqrt(2^12) = 1.6 %) and k of the KLL
#: sketch (rank error 1.33 % at 99 % confidence); errors below are three times as wide.
LG_K, KLL_K = 12, 200
DISTINCT_ERROR, QUANTILE_ERROR = 0.049, 0.04


def partition_signatures(table: DataFrame, partition: str) -> DataFrame:
    """(part, signature): a hash over the files of each partition. Only footers are read."""
    files = table.select(F.col(partition).cast("string").alias("part"), F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    return files.groupBy("part").agg(F.md5(F.concat_ws(",", F.sum(F.col("f").cast("decimal(38,0)")).cast("string"), F.count(F.lit(1)).cast("string"))).alias("signature"))


def profile_partitions(df: DataFrame, partition: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row a partition and column, from one aggregate with map-side partial results:
    a task sends one row a partition."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (columns if columns is not None else types) if c != partition]
    if not cols:
        raise ValueError("no columns to profile")
    aggs, rows = [], []
    for i, c in enumerate(cols):
        x, dtype = sql_ident(c), types[c]
        number = f"CAST({x} AS DOUBLE)" if is_numeric_type(dtype) else "CAST(NULL AS DOUBLE)"
        text = f"CAST({x} AS STRING)" if is_orderable(dtype) else "CAST(NULL AS STRING)"
        value = f"CASE WHEN {x} IS NOT NULL THEN xxhash64({_hashable(x, dtype)}) END"
        parts = {
            "null_count": f"count_if({x} IS NULL)", "min_value": f"min({text})", "max_value": f"max({text})",
            "n": f"count({number})", "mean": f"avg({number})", "m2": f"var_pop({number}) * count({number})", "low": f"min({number})", "high": f"max({number})",
            "hll": f"hll_sketch_agg({value}, {LG_K})", "kll": f"kll_sketch_agg_double({number}, {KLL_K})" if is_numeric_type(dtype) else "CAST(NULL AS BINARY)",
        }
        aggs += [F.expr(sql).alias(f"{name}{i}") if "NULL AS BINARY" not in sql else F.expr("max(CAST(NULL AS BINARY))").alias(f"{name}{i}") for name, sql in parts.items()]
        rows.append(f"named_struct('ordinal', {i + 1}, 'column_name', {sql_str(c)}, 'total_rows', total, " + ", ".join(f"'{name}', {name}{i}" for name in parts) + ")")
    wide = df.groupBy(F.col(partition).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("total"), *aggs)
    return wide.selectExpr("part", long_rows_sql(rows))


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing stored yet


def update_profile(table: DataFrame, partition: str, store: str, columns: Iterable[str] | None = None) -> list[str | None]:
    """Bring the profile at ``store`` up to date with ``table`` (read from files partitioned by
    ``partition``) and return the partitions that were read, by name."""
    spark = table.sparkSession
    now = partition_signatures(table, partition)
    old = _stored(spark, store)
    if old is not None:
        known = old.select(F.col("part").alias("was"), F.col("signature").alias("before")).distinct()
        now = now.join(known, F.col("part").eqNullSafe(F.col("was")) & (F.col("signature") == F.col("before")), "left_anti")
    # names of partitions, which the driver lists for every scan of the table anyway
    todo = {r["part"]: r["signature"] for r in now.collect()}
    if todo:
        dtype = table.schema[partition].dataType
        named = [F.lit(p).cast(dtype) for p in todo if p is not None]
        wanted = F.col(partition).isin(named) if named else F.lit(False)
        if None in todo:
            wanted = wanted | F.col(partition).isNull()
        signed = spark.createDataFrame(list(todo.items()), "name STRING, signature STRING")
        rows = profile_partitions(table.where(wanted), partition, columns).join(signed, F.col("part").eqNullSafe(F.col("name"))).drop("name")
        # folders are named by a hash: a partition's name can be any text, or null
        (rows.withColumn("key", F.md5(F.coalesce("part", F.lit("null")))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(store))
    return sorted(todo, key=lambda p: (p is None, p))


def stored_profile(table: DataFrame, partition: str, store: str) -> DataFrame:
    """The stored rows of the partitions as ``table`` has them now: those that are gone, or
    were changed since, are left out."""
    now = partition_signatures(table, partition).withColumnsRenamed({"part": "now", "signature": "present"})
    rows = table.sparkSession.read.parquet(store).drop("key")
    return rows.join(now, F.col("part").eqNullSafe(F.col("now")) & (F.col("signature") == F.col("present")), "left_semi")


def merged_profile(parts: DataFrame, probs: Iterable[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row a column over all partitions: total_rows, null_count, null_rate, min_value,
    max_value (text, as Q2), low, high, mean_value, std_dev (sample), distinct_approx and
    quantiles (numbers only). Bounded by partitions times columns."""
    grid = ", ".join(f"{float(p)!r}D" for p in probs)
    g = parts.groupBy("ordinal", "column_name")
    means = g.agg(F.sum("n").alias("all_n"), F.expr("try_divide(sum(mean * n), sum(n))").alias("all_mean"))
    spread = F.expr("sum(CASE WHEN n > 0 THEN m2 + n * (mean - all_mean) * (mean - all_mean) END)").alias("m2")
    merged = parts.join(means, ["ordinal", "column_name"]).groupBy("ordinal", "column_name").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("null_count").alias("null_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.first("all_n").alias("n"), F.first("all_mean").alias("mean_value"), spread,
        F.expr("hll_sketch_estimate(hll_union_agg(hll, false))").alias("distinct_approx"), F.expr("kll_merge_agg_double(kll)").alias("kll"))
    return merged.selectExpr(
        "ordinal", "column_name", "total_rows", "null_count", "try_divide(CAST(null_count AS DOUBLE), total_rows) AS null_rate", "min_value", "max_value", "low", "high",
        "mean_value", "CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END AS std_dev", "distinct_approx", f"CASE WHEN n > 0 THEN kll_sketch_get_quantile_double(kll, array({grid})) END AS quantiles")

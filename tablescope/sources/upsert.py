"""Idempotent loads expressed as joins (parquet tables have no MERGE).

* ``replace`` — insert-or-replace: rows of ``updates`` win, other base rows stay.
* ``ignore``  — insert-or-ignore: base rows win, only new keys are added.
* ``update``  — update-on-conflict of ``update_cols`` only; other columns keep the
  base value, new keys are inserted.
* ``append``  — plain append.

All but ``append`` are one full outer join on the key columns, each side read once.
Keys match null-safely (a null key is a key like any other), and ``updates`` must hold
one row a key: the last by ``order_by`` where that is given, else a second row raises
an error. So applying the same ``updates`` twice gives the same result.

``upsert`` gives the merged frame, ``upsert_versioned`` writes it as a whole new version,
``upsert_partitions`` rewrites only the partitions that hold a key of ``updates``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tablescope.functions.exprs import sql_ident
from tablescope.sources.tables import _filesystem


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], mode: str = "replace",
           update_cols: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    if mode == "append":
        return base.unionByName(updates.select(*[F.col(sql_ident(c)) for c in base.columns]))
    if mode not in ("replace", "ignore", "update"):
        raise ValueError(f"unknown upsert mode {mode!r}")
    k = [f"__k{i}" for i in range(len(keys))]
    one = _one_row_a_key(updates, base.columns, keys, k, order_by)
    b = base.select(F.struct(*[F.col(sql_ident(c)) for c in base.columns]).alias("__b"),
                    *[F.col(sql_ident(c)).alias(n) for c, n in zip(keys, k)])
    same = None
    for n in k:
        cond = b[n].eqNullSafe(one[n])
        same = cond if same is None else same & cond
    j = b.join(one, same, "full_outer").select("__b", "__u")
    newer = {"replace": set(base.columns), "ignore": set(),
             "update": set(update_cols or [c for c in base.columns if c not in keys])}[mode]
    old, new = F.col("__b"), F.col("__u")
    return j.select(*[
        F.when(new.isNotNull() if c in newer else old.isNull(), new.getField(c)).otherwise(old.getField(c)).alias(c)
        for c in base.columns])


def _one_row_a_key(updates: DataFrame, columns: list[str], keys: list[str], names: list[str],
                   order_by: list[str] | None) -> DataFrame:
    """(names..., __u): the row of each key as a struct."""
    row = F.struct(*[F.col(sql_ident(c)) for c in columns])
    by = [F.col(sql_ident(c)).alias(n) for c, n in zip(keys, names)]
    if order_by:
        best = F.max_by(row, F.struct(*[F.col(sql_ident(c)) for c in order_by]))
        return updates.groupBy(*by).agg(best.alias("__u"))
    once = updates.groupBy(*by).agg(F.first(row).alias("__u"), F.count(F.lit(1)).alias("__n"))
    twice = F.raise_error(F.lit("updates hold more than one row of a key; give order_by"))
    return once.select(*names, F.when(F.col("__n") == 1, F.col("__u")).otherwise(twice).alias("__u"))


def upsert_versioned(spark, base_path: str, updates: DataFrame, keys: list[str], target_root: str,
                     version: str, mode: str = "replace", update_cols: list[str] | None = None,
                     fmt: str = "parquet", order_by: list[str] | None = None) -> str:
    """Apply ``upsert`` to the table at ``base_path`` and write the result as a new
    version ``<target_root>/version=<version>``; returns that path.

    The input is never overwritten in place (Spark would read and delete the same
    files), and a retried job rewrites the same version folder, so re-running after a
    lost executor or driver gives the same table. ``target_root`` should be shared
    storage (e.g. under the cluster's ``spark.checkpoint.dir``), never a
    machine-local folder.
    """
    import os

    out = os.path.join(target_root, f"version={version}")
    if os.path.abspath(out) == os.path.abspath(base_path):
        raise ValueError("the new version must not overwrite its input")
    base = spark.read.format(fmt).load(base_path)
    upsert(base, updates, keys, mode, update_cols, order_by).write.mode("overwrite").format(fmt).save(out)
    return out


def upsert_partitions(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], partition_by: dict[str, str],
                      staging: str, version: str, mode: str = "replace", update_cols: list[str] | None = None,
                      order_by: list[str] | None = None) -> DataFrame:
    """Apply ``updates`` to the partitioned Parquet table at ``path``, rewriting only the
    partitions that hold one of its keys; returns the values of the partitions rewritten.

    ``partition_by`` maps partition columns to SQL expressions over ``keys`` (``{"month":
    "date_format(date, 'yyyy-MM')"}``, or ``{"region": "region"}``), so a key's partition
    follows from the key and the scan of the table is pruned to the partitions of the updates.
    Other partitions are neither read nor written: their files keep their bytes. The table
    has the columns of ``updates``, and the partition columns beside them (further ones are an
    error); a ``path`` that does not exist yet is an empty table.

    The merged partitions are first written to ``staging/version=<version>`` (shared storage)
    and then put in place from there by dynamic partition overwrite. A run that is lost can
    be repeated with the same ``version`` at any point: a complete staged result is put in
    place again and the table, perhaps half replaced, is not read for it. So a version stands
    for one set of updates (``append`` included), and versions are applied in order. Two
    runs on one table must not overlap.

    A null partition value is a partition of its own; empty strings in partition columns
    become null, as in every table laid out in folders. Empty updates change nothing. Partition
    values (one row a folder touched, which the driver lists anyway) prune the scan.
    """
    columns = updates.columns
    clash = [c for c, e in partition_by.items() if c in columns and e.strip("`") != c]
    if clash or not partition_by:
        raise ValueError(f"partition columns need a name of their own or to be a key: {clash}")
    updates.select(*[F.col(sql_ident(k)) for k in keys]).selectExpr(*partition_by.values())  # an error unless keys decide
    updates = _placed(updates, partition_by)
    stage = f"{staging.rstrip('/')}/version={version}"
    if not _exists(spark, f"{stage}/_SUCCESS"):
        old = _touched(spark, path, updates, list(partition_by))
        upsert(old, updates, keys, mode, update_cols, order_by).write.mode("overwrite").parquet(stage)
    merged = spark.read.schema(updates.schema).parquet(stage)
    by = [F.col(sql_ident(c)) for c in partition_by]
    # one task a partition, but AQE splits one that is large
    (merged.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
    return merged.select(*by).distinct()


def _placed(updates: DataFrame, partition_by: dict[str, str]) -> DataFrame:
    """``updates`` with their partition columns, empty strings as null."""
    out = updates.withColumns({c: F.expr(e) for c, e in partition_by.items()})
    text = [f.name for f in out.schema if f.name in partition_by and isinstance(f.dataType, StringType)]
    return out.withColumns({c: F.nullif(F.col(sql_ident(c)), F.lit("")) for c in text})


def _touched(spark: SparkSession, path: str, updates: DataFrame, partition_by: list[str]) -> DataFrame:
    """The rows of the table in partitions that ``updates`` have, pruned at the scan."""
    touched = updates.select(*partition_by).distinct().collect()
    pruned = F.lit(bool(touched))
    for c in partition_by:
        values = {r[c] for r in touched}
        one = F.col(sql_ident(c)).isin(*[v for v in values if v is not None])
        pruned = pruned & (one | F.col(sql_ident(c)).isNull() if None in values else one)
    old = _existing(spark, path, updates.schema).where(pruned)
    if len(partition_by) == 1:
        return old
    # the values of each column alone also let mixtures through
    marks = spark.createDataFrame(touched, updates.select(*partition_by).schema)
    same = [old[sql_ident(c)].eqNullSafe(marks[sql_ident(c)]) for c in partition_by]
    return old.join(marks, same, "left_semi")


def _existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as it is, its partition values in the types of ``schema`` ('01' stays text);
    an error if it has further columns, which a rewrite would lose."""
    try:
        further = set(spark.read.parquet(path).columns) - set(schema.names)
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        further, table = set(), spark.createDataFrame([], schema)
    if further:
        raise ValueError(f"the updates lack columns of the table: {sorted(further)}")
    return table.select(*[F.col(sql_ident(c)) for c in schema.names])


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)

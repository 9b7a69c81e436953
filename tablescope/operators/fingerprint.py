"""Fingerprints of a table's content beside the structural one, and their diff.

A partition's fingerprint is an additive hash of the multiset of its rows: two 64-bit hashes
a row, summed modulo 2^64, and the number of rows. Sums do not depend on the order of rows, on
files or on the order of columns, and fingerprints of parts add up to that of the whole; a
row that stands twice counts twice. One changed value changes the sums except for a chance of
about 2^-128. It is one scan with map-side sums: a task sends one row a partition.

Row hashes cover names and nulls: Spark's hash skips a null, so every value goes in with its
column's name and whether it is null, arrays with their size and maps as sorted entries.
-0.0 counts as 0.0 and all NaN are one value.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType, VariantType

from tablescope.functions.exprs import sql_ident, sql_str

#: A sum of signed 64-bit hashes in DECIMAL(38,0) is exact for 10^18 rows.
_WRAP = "CAST(18446744073709551616 AS DECIMAL(38,0))"


def _hashable(expr: str, dtype: DataType, depth: int = 0) -> str:
    """SQL for a value whose hash tells unequal values apart, nulls at any depth included."""
    if isinstance(dtype, ArrayType):
        v = f"e{depth}"
        item = f"named_struct('n', {v} IS NULL, 'v', {_hashable(v, dtype.elementType, depth + 1)})"
        return f"named_struct('s', size({expr}), 'e', transform({expr}, {v} -> {item}))"
    if isinstance(dtype, MapType):
        v = f"e{depth}"
        item = f"named_struct('k', {_hashable(f'{v}.key', dtype.keyType, depth + 1)}, 'n', {v}.value IS NULL, 'v', {_hashable(f'{v}.value', dtype.valueType, depth + 1)})"
        # entries in the order of their keys' hashes: keys need not be sortable
        hashed = f"transform(map_entries({expr}), {v} -> named_struct('h', xxhash64({item}), 'g', xxhash64('second', {item})))"
        return f"named_struct('s', size({expr}), 'e', array_sort({hashed}))"
    if isinstance(dtype, StructType):
        parts = []
        for f in dtype.fields:
            at = f"{expr}.{sql_ident(f.name)}"
            parts.append(f"'n', {at} IS NULL, 'v', {_hashable(at, f.dataType, depth)}")
        return "named_struct(" + ", ".join(p.replace("'n'", f"'n{i}'", 1).replace("'v'", f"'v{i}'", 1) for i, p in enumerate(parts)) + ")" if parts else "0"
    if isinstance(dtype, (FloatType, DoubleType)):
        return f"({expr} + CAST(0 AS {dtype.simpleString()}))"
    if isinstance(dtype, VariantType):
        return f"to_json({expr})"
    return expr


def row_hashes(df: DataFrame, columns: Iterable[str] | None = None) -> tuple[str, str]:
    """SQL for two 64-bit hashes of a row; the order of columns does not matter."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = sorted(columns if columns is not None else types)
    args = ", ".join(f"{sql_str(c)}, {sql_ident(c)} IS NULL, {_hashable(sql_ident(c), types[c])}" for c in cols) or "0"
    return f"xxhash64({args})", f"xxhash64('second', {args})"


def content_fingerprint(df: DataFrame, partition: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """(part, n_rows, sum1, sum2) per value of the SQL expression ``partition`` as text (one
    row with a null part without it, also for an empty table). ``columns``: those hashed."""
    first, second = row_hashes(df, columns)
    part = f"CAST({partition} AS STRING)" if partition else "CAST(NULL AS STRING)"
    rows = df.selectExpr(f"{part} AS part", f"CAST({first} AS DECIMAL(38,0)) AS h1", f"CAST({second} AS DECIMAL(38,0)) AS h2")
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.expr(f"pmod(coalesce(sum(h{i}), 0), {_WRAP})").alias(f"sum{i}") for i in (1, 2)]]
    out = rows.groupBy("part").agg(*aggs) if partition else rows.agg(*aggs).withColumn("part", F.lit(None).cast("string"))
    return out.select("part", "n_rows", *[F.col(f"sum{i}").cast("decimal(20,0)").alias(f"sum{i}") for i in (1, 2)])


def combined(fingerprints: DataFrame) -> DataFrame:
    """The whole's (n_rows, sum1, sum2) from those of its parts."""
    return fingerprints.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *[
        F.expr(f"CAST(pmod(coalesce(sum(sum{i}), 0), {_WRAP}) AS DECIMAL(20,0))").alias(f"sum{i}") for i in (1, 2)])


def content_hash(fingerprints: DataFrame) -> DataFrame:
    """``fingerprints`` with the sums and the row count as one MD5 text, ``content_hash``."""
    return fingerprints.withColumn("content_hash", F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("sum1").cast("string"), F.col("sum2").cast("string"))))


def table_fingerprints(tables: dict[str, DataFrame], partitions: dict[str, str] | None = None) -> DataFrame:
    """(table_name, part, n_rows, sum1, sum2) of every table, one scan each."""
    out = None
    for name, df in tables.items():
        fp = content_fingerprint(df, (partitions or {}).get(name)).select(F.lit(name).alias("table_name"), "*")
        out = fp if out is None else out.unionByName(fp)
    return out


def content_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_name, part, change, old_rows, new_rows): partitions that were added, removed or
    changed between two frames of ``table_fingerprints``; equal ones are omitted."""
    a, b = (side.select(F.struct("table_name", "part").alias(f"{name}_key"), F.struct("n_rows", "sum1", "sum2").alias(name)) for side, name in ((old, "old"), (new, "new")))
    j = a.join(b, F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer").select(F.coalesce("old_key", "new_key").alias("key"), "old", "new").select("key.*", "old", "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.select("table_name", "part", change.alias("change"), F.col("old.n_rows").alias("old_rows"), F.col("new.n_rows").alias("new_rows")).where("change IS NOT NULL")

"""Catalog metadata as DataFrames; counts are Spark jobs.

Schemas are metadata the driver already holds (``df.schema``); they become
small frames. Row counts are aggregates over the tables (parquet ``count(*)``
reads no column data). Keys come from the declared ``constraints`` frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.functions.aggregates import union_all
from tablescope.functions.exprs import round_half_up, sql_ident, type_name
from tablescope.operators.constraints import foreign_keys, primary_keys
from tablescope.operators.profile import null_rates

COLUMN_DDL = ("table_name STRING, ordinal_position INT, column_name STRING, data_type STRING, nullable BOOLEAN, "
              "default_value STRING")

DEFAULT_SCHEMA = "main"


def schema_of(table: str, default: str = DEFAULT_SCHEMA) -> str:
    """Schema of a table name: what stands before the last dot ("sales.orders"), so tables
    of one name in two schemas stay apart."""
    return table.rpartition(".")[0] or default

# System schemas hidden from schema listings (plus any "pg_" prefix).
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "sys", "system")


def schemas_df(spark: SparkSession, exclude: tuple[str, ...] = SYSTEM_SCHEMAS) -> DataFrame:
    """Catalog databases minus system ones."""
    rows = [(d.name, d.description) for d in spark.catalog.listDatabases()]
    df = spark.createDataFrame(rows, "schema_name STRING, description STRING")
    return df.where(~F.col("schema_name").isin(*exclude) & ~F.col("schema_name").startswith("pg_"))


def tables_df(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Tables of a catalog database, sorted by name."""
    rows = [(t.name, t.database, t.tableType, t.isTemporary) for t in spark.catalog.listTables(schema)]
    df = spark.createDataFrame(rows, "table_name STRING, schema_name STRING, table_type STRING, is_temporary BOOLEAN")
    return df.orderBy("table_name")


def schema_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Column metadata of every table (name, position, Spark type name, nullability and
    the default that a catalog table declares)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i + 1, f.name, type_name(f.dataType), bool(f.nullable), (f.metadata or {}).get("CURRENT_DEFAULT"))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, COLUMN_DDL)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row count per table (one count job per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
             for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, row_count, null_count): what the data says of each column."""
    parts = [null_rates(df, list(df.columns)).select(
        F.lit(t).alias("table_name"), "column_name", F.col("total_rows").alias("row_count"), "null_count")
        for t, df in tables.items()]
    return union_all(parts)


def columns_df(tables: dict[str, DataFrame], constraints: DataFrame) -> DataFrame:
    """Columns with key flags and the referenced column of an FK."""
    cols = schema_columns(tables)
    keyed = constraints.where(F.col("kind").isin("pk", "fk")).groupBy("table_name", "column").agg(
        F.max(F.col("kind") == "pk").alias("is_primary_key"),
        F.max(F.col("kind") == "fk").alias("is_foreign_key"),
        F.min(F.when(F.col("kind") == "fk", F.concat_ws(".", "ref_table", "ref_column"))).alias("foreign_key_ref"),
    ).withColumnRenamed("column", "column_name")
    out = cols.join(keyed, ["table_name", "column_name"], "left")
    return out.select(
        "table_name", "ordinal_position", "column_name", "data_type", "nullable", "default_value",
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
        F.coalesce("is_foreign_key", F.lit(False)).alias("is_foreign_key"),
        "foreign_key_ref",
    )


def foreign_keys_df(constraints: DataFrame) -> DataFrame:
    """C4: one row per (column, referenced column) pair, composite keys expanded."""
    return constraints.where(F.col("kind") == "fk").select(
        "table_name", F.col("name").alias("constraint_name"), "position", F.col("column").alias("column_name"),
        "ref_table", F.col("ref_column").alias("ref_column"))


def tables_overview(tables: dict[str, DataFrame], schema_name: str = DEFAULT_SCHEMA) -> DataFrame:
    """C7 (+C12): schema, table, row_count, column_count (one count per table; the
    column count is schema metadata, a literal)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(schema_of(t, schema_name)).alias("schema_name"), F.lit(t).alias("table_name"), "row_count",
        F.lit(len(df.columns)).alias("column_count")) for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview_from_quality(quality_all: DataFrame) -> DataFrame:
    """C7 derived from an unfiltered ``quality_overview(..., skip_empty=False)``: the
    row count and column count per table without another pass over the data."""
    return quality_all.groupBy("schema_name", "table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).cast("int").alias("column_count"))


def tables_by_schema(overview: DataFrame) -> DataFrame:
    """Tables grouped by schema (names sorted), with table count and total rows.
    One row per schema; each list is bounded by the catalog."""
    return overview.groupBy("schema_name").agg(
        F.array_sort(F.collect_list("table_name")).alias("tables"),
        F.count(F.lit(1)).alias("table_count"), F.sum("row_count").alias("total_rows"))


def table_size_top(overview: DataFrame, n: int = 8) -> DataFrame:
    """C11: top-n tables by rows with bar width = rows / max(rows) * 100 (1 dp).

    ``overview`` has one row per table (bounded by the catalog), so the global
    window over it is cheap.
    """
    w = Window.partitionBy()
    return (overview.select("table_name", "row_count",
                            F.sum("row_count").over(w).alias("total_rows"),
                            F.count(F.lit(1)).over(w).alias("table_count"),
                            round_half_up(F.col("row_count") * 100.0 / F.greatest(F.max("row_count").over(w), F.lit(1)),
                                          1).alias("bar_pct"))
            .orderBy(F.col("row_count").desc(), "table_name").limit(n))


def constraints_summary(tables: dict[str, DataFrame], constraints: DataFrame) -> DataFrame:
    """Each declared constraint with its columns, validated against the data.

    ``violations``: pk -> rows minus distinct key tuples without a null (so a null key is
    a violation); unique -> rows without a null minus their distinct tuples (nulls are
    never equal); fk -> orphan rows; not_null -> null rows; check -> rows where it is
    false. Each check is one aggregate over its table.
    """
    from tablescope.operators.keys import orphan_counts

    grouped: dict[tuple[str, str, str], list] = {}
    for r in sorted(constraints.collect(), key=lambda r: (r["table_name"], r["kind"], r["name"], r["position"])):
        grouped.setdefault((r["table_name"], r["kind"], r["name"]), []).append(r)
    parts = []
    for (table, kind, name), rs in grouped.items():
        cols = [r["column"] for r in rs]
        df = tables[table]
        if kind in ("pk", "unique"):
            key = [F.col(sql_ident(c)) for c in cols]
            whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in key])
            tuples = F.count_distinct(F.when(whole, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])))
            rows = F.count(F.lit(1)) if kind == "pk" else F.count_if(whole)
            v = df.agg((rows - tuples).alias("violations"))
        elif kind == "fk":
            v = orphan_counts(df, tables[rs[0]["ref_table"]], cols, [r["ref_column"] for r in rs]).select(
                F.col("orphan_rows").alias("violations"))
        elif kind == "not_null":
            v = df.agg(F.count_if(F.col(sql_ident(cols[0])).isNull()).alias("violations"))
        elif kind == "check":
            v = df.agg(F.count_if(~F.expr(rs[0]["expression"])).alias("violations"))
        else:
            v = df.agg(F.lit(None).cast("bigint").alias("violations"))
        parts.append(v.select(
            F.lit(table).alias("table_name"), F.lit(kind).alias("kind"), F.lit(name).alias("constraint_name"),
            F.lit(",".join(cols)).alias("columns"),
            F.lit(rs[0]["ref_table"]).cast("string").alias("ref_table"),
            F.lit(",".join(r["ref_column"] for r in rs) if kind == "fk" else None).cast("string").alias("ref_columns"),
            F.lit(rs[0]["expression"]).cast("string").alias("expression"),
            F.col("violations").cast("bigint").alias("violations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_snapshot(tables: dict[str, DataFrame], constraints: DataFrame, schema_name: str = DEFAULT_SCHEMA) -> DataFrame:
    """One row per table — columns[], primary_keys[], foreign_keys[], row_count; a table
    name with a dot ("schema.table") brings its own schema.

    Arrays are ordered by ordinal/position (``array_sort`` over structs), never by
    the arrival order of ``collect_list``.
    """
    cols = columns_df(tables, constraints)
    col_agg = cols.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "data_type", "nullable",
                                             "is_primary_key", "is_foreign_key"))).alias("__cols"))
    pk = primary_keys(constraints)
    fks = foreign_keys(constraints)
    spark = cols.sparkSession
    keys = spark.createDataFrame(
        [(t, pk.get(t, []), [f"{c}->{fk.ref_table}.{rc}" for fk in fks if fk.table == t for c, rc in fk.pairs])
         for t in tables],
        "table_name STRING, primary_keys ARRAY<STRING>, foreign_keys ARRAY<STRING>")
    counts = row_counts(tables)
    out = col_agg.join(keys, "table_name").join(counts, "table_name")
    return out.select(
        F.when(F.col("table_name").contains("."), F.regexp_replace("table_name", r"\.[^.]*$", ""))
        .otherwise(F.lit(schema_name)).alias("schema_name"), "table_name", "row_count",
        F.size("__cols").alias("column_count"),
        F.transform("__cols", lambda s: s.dropFields("ordinal_position")).alias("columns"),
        "primary_keys", "foreign_keys",
    )


def _key_text(columns: DataFrame) -> Column:
    """What a column is as a key, where ``columns`` says so: "PK", its reference, both."""
    parts = []
    if "is_primary_key" in columns.columns:
        parts.append(F.when(F.col("is_primary_key"), "PK"))
    if "foreign_key_ref" in columns.columns:
        parts.append(F.col("foreign_key_ref"))
    return F.concat_ws(",", *parts) if parts else F.lit("")


def schema_fingerprint(columns: DataFrame) -> DataFrame:
    """Structural MD5 per table over sorted ``name:type:nullable:key`` entries.

    Row counts are *not* hashed (a data change is not a schema change).
    """
    entry = F.concat_ws(":", "column_name", "data_type", F.col("nullable").cast("string"), _key_text(columns))
    return columns.groupBy("table_name").agg(
        F.md5(F.concat_ws("|", F.array_sort(F.collect_list(entry)))).alias("schema_hash"),
        F.count(F.lit(1)).alias("column_count"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed, of another type, of another nullability or another
    part in keys between two column snapshots; the first that holds is named.

    Inputs have (table_name, column_name, data_type[, nullable, is_primary_key,
    foreign_key_ref]); unchanged columns are omitted.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        nullable = F.col("nullable") if "nullable" in df.columns else F.lit(None).cast("boolean")
        return df.select("table_name", "column_name", F.col("data_type").alias(f"{name}_type"),
                         nullable.alias(f"{name}_nullable"), _key_text(df).alias(f"{name}_key"))

    j = side(old, "old").join(side(new, "new"), ["table_name", "column_name"], "full_outer")
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when(F.col("old_type") != F.col("new_type"), "type_changed")
              .when(F.col("old_nullable") != F.col("new_nullable"), "nullability_changed")
              .when(F.col("old_key") != F.col("new_key"), "key_changed"))
    return j.select("table_name", "column_name", change.alias("change"), "old_type", "new_type").where(
        F.col("change").isNotNull())


def change_impact(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, affected_rows): values that a schema change touches. For a
    removed column those that are lost, for an added one those that are filled, for another
    type those that the cast changes or cannot hold."""
    parts = []
    for t in sorted(set(old) | set(new)):
        types = [{f.name: f.dataType for f in side[t].schema.fields} if t in side else {} for side in (old, new)]
        for c in dict.fromkeys([*types[0], *types[1]]):
            x = F.col(sql_ident(c))
            if c in types[0] and c in types[1]:
                if types[0][c] == types[1][c]:
                    continue
                back = x.try_cast(types[1][c]).try_cast(types[0][c])
                n = old[t].agg(F.count_if(x.isNotNull() & ~x.eqNullSafe(back)).alias("affected_rows"))
            else:
                n = (old if c in types[0] else new)[t].agg(F.count(x).alias("affected_rows"))
            parts.append(n.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "affected_rows"))
    return union_all(parts) if parts else None

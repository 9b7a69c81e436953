"""Q3 key uniqueness and J6 referential integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import ratio, round_half_up, sql_ident
from tablescope.operators.constraints import ForeignKey


def pk_uniqueness(df: DataFrame, pk: list[str], table_name: str | None = None) -> DataFrame:
    """Q3: distinct key tuples over rows (4 dp).

    ``count(DISTINCT struct(...))`` counts tuples with null members as values —
    ``count(DISTINCT a, b)`` would silently drop them. Partial aggregation removes
    duplicates on each task before the shuffle, so a hot key costs one row per task.
    """
    key = F.struct(*[F.col(sql_ident(c)).alias(f"k{i}") for i, c in enumerate(pk)])
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(key).alias("unique_pk_rows"))
    return out.select(
        F.lit(table_name).cast("string").alias("table_name"),
        F.lit(",".join(pk)).alias("pk_columns"),
        "total_rows",
        "unique_pk_rows",
        (F.col("total_rows") - F.col("unique_pk_rows")).alias("duplicate_rows"),
        round_half_up(ratio("unique_pk_rows", "total_rows"), 4).alias("uniqueness_rate"),
    )


def orphan_counts(child: DataFrame, parent: DataFrame, columns: list[str], ref_columns: list[str],
                  count_parents: bool = False) -> DataFrame:
    """Child rows whose (non-null) key has no parent row: one row of counts. With
    ``count_parents`` also the parent's rows, from the same scan of it.

    One scan of each side: the child is reduced to (key, rows), nulls included, with a
    partial aggregate, so a key that holds a third of the table becomes one row per task
    before any shuffle; then its keys are joined with the parent's distinct keys (a null
    never matches) and all counts come from that frame.
    """
    n = range(len(columns))
    child_keys = child.groupBy(*[F.col(sql_ident(c)).alias(f"__k{i}") for i, c in enumerate(columns)]).agg(
        F.count(F.lit(1)).alias("__rows"))
    parent_keys = parent.select(*[F.col(sql_ident(c)).alias(f"__k{i}") for i, c in enumerate(ref_columns)])
    found = (parent_keys.groupBy(*parent_keys.columns).agg(F.count(F.lit(1)).alias("__found")) if count_parents
             else parent_keys.distinct().withColumn("__found", F.lit(1)))
    # both sides are shuffled by the key already, so keeping childless parents costs no exchange
    j = child_keys.join(found, [f"__k{i}" for i in n], "full_outer" if count_parents else "left")
    null = reduce(lambda a, b: a | b, [F.col(f"__k{i}").isNull() for i in n])
    orphan = ~null & F.col("__found").isNull()
    rows = lambda cond, c="__rows": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    parents = [rows(F.lit(True), "__found").alias("parent_rows")] if count_parents else []
    return j.agg(rows(F.lit(True)).alias("child_rows"), rows(null).alias("null_fk_rows"),
                 rows(orphan).alias("orphan_rows"), F.count_if(orphan).alias("orphan_keys"), *parents)


def referential_integrity(tables: dict[str, DataFrame], fks: list[ForeignKey], count_parents: bool = False) -> DataFrame:
    """Per foreign key — child rows, null-key rows, orphan rows and keys, verdict; with
    ``count_parents`` the parent's rows too."""
    parts = []
    for fk in fks:
        counts = orphan_counts(tables[fk.table], tables[fk.ref_table], list(fk.columns), list(fk.ref_columns), count_parents)
        parts.append(counts.select(
            F.lit(fk.name).alias("constraint_name"),
            F.lit(fk.table).alias("child_table"),
            F.lit(",".join(fk.columns)).alias("child_columns"),
            F.lit(fk.ref_table).alias("parent_table"),
            F.lit(",".join(fk.ref_columns)).alias("parent_columns"),
            "child_rows", "null_fk_rows", "orphan_rows", "orphan_keys",
            F.when(F.col("orphan_rows") == 0, "pass").otherwise("fail").alias("result"),
            *(["parent_rows"] if count_parents else []),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Foreign-key lineage as node and edge frames.

Only one-hop questions are asked of the graph (neighbours, isolated tables), so
plain joins/filters on the edge frame are enough — no graph library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.operators.constraints import ForeignKey

ARROW = " → "


def lineage_edges(constraints: DataFrame) -> DataFrame:
    """L2: one edge per FK column pair: source, target, label ``col → ref_col``.
    Edges without a target table are dropped."""
    fk = constraints.where((F.col("kind") == "fk") & F.col("ref_table").isNotNull() & (F.col("ref_table") != ""))
    return fk.select(
        F.col("table_name").alias("source"), F.col("ref_table").alias("target"),
        F.concat_ws(ARROW, "column", "ref_column").alias("label"),
        F.col("name").alias("constraint_name"), "position")


def lineage_nodes(overview: DataFrame, edges: DataFrame) -> DataFrame:
    """L1: id, schema, row_count, column_count, with graph totals and degrees."""
    out_deg = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_deg = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    nodes = overview.select(F.col("table_name").alias("id"), F.col("schema_name").alias("schema"),
                            "row_count", "column_count")
    n_rel = edges.agg(F.count(F.lit(1))).scalar()
    n_tab = F.count(F.lit(1)).over(Window.partitionBy())  # one row a table; a subquery would count all tables again
    return (nodes.join(out_deg, "id", "left").join(in_deg, "id", "left")
            .select("id", "schema", "row_count", "column_count",
                    F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
                    n_tab.alias("table_count"), n_rel.alias("relationship_count")))


def lineage_neighbors(edges: DataFrame, table: str) -> DataFrame:
    """L3: upstream (tables ``table`` references) and downstream (tables referencing it)."""
    up = edges.where(F.col("source") == table).select(
        F.lit("upstream").alias("direction"), F.col("target").alias("table_name"), "label")
    down = edges.where(F.col("target") == table).select(
        F.lit("downstream").alias("direction"), F.col("source").alias("table_name"), "label")
    return up.unionByName(down).select(F.lit(table).alias("focus_table"), "direction", "table_name", "label")


def lineage_isolated(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """L4: tables that neither reference nor are referenced (both degrees 0).

    ``nodes`` is ``lineage_nodes`` output, which already carries the degrees; no
    further join is needed. ``edges`` is accepted for symmetry and unused."""
    return nodes.where((F.col("out_degree") == 0) & (F.col("in_degree") == 0)).select(
        F.col("id").alias("table_name"), "row_count")


def lineage_columns(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """HAS_COLUMN edges with key flags, plus the graph's load statistics: tables,
    columns and relationships (one a pair of key columns)."""
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    n_tables = columns.agg(F.count_distinct("table_name")).scalar()
    n_columns = columns.agg(F.count(F.lit(1))).scalar()
    return columns.select("table_name", "column_name", "data_type", "is_primary_key", "is_foreign_key",
                          n_tables.alias("table_count"), n_columns.alias("column_count"),
                          n_edges.alias("relationship_count"))


def er_columns(columns: DataFrame) -> DataFrame:
    """ER listing — TYPE (upper-cased, cut at '('), column, PK/FK marks."""
    t = F.upper(F.split_part(F.col("data_type"), F.lit("("), F.lit(1)))
    return columns.select(
        F.regexp_replace("table_name", r"\.", "_").alias("table_id"), "ordinal_position",
        t.alias("type_name"), "column_name",
        F.when(F.col("is_primary_key"), "PK").otherwise("").alias("pk_mark"),
        F.when(F.col("is_foreign_key"), "FK").otherwise("").alias("fk_mark"))


def fk_join_preview(tables: dict[str, DataFrame], fk: ForeignKey, n: int = 20, width: int = 3) -> DataFrame:
    """First ``width`` columns of each side joined along an FK, ``n`` rows in a
    total order (distributed top-k; the cap is the feature)."""
    a, b = tables[fk.table], tables[fk.ref_table]
    cond = None
    for c, rc in fk.pairs:
        e = a[c] == b[rc]
        cond = e if cond is None else cond & e
    sel = [a[c].alias(f"a_{c}") for c in a.columns[:width]] + [b[c].alias(f"b_{c}") for c in b.columns[:width]]
    j = a.join(b, cond, "inner").select(*sel)
    return j.orderBy(*j.columns).limit(n)

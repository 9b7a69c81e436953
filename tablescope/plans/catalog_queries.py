"""Registered catalog, lineage, dictionary and export queries with their DuckDB oracles.

Metadata frames (schemas, declared keys) are joined with row counts computed
over the tables, so every query reads the given data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import numeric_columns, ratio, round_half_up
from tablescope.operators import catalog, dictionary, fingerprint, incremental_profile, keys, kpi, lineage, profile, report
from tablescope.operators.constraints import primary_keys
from tablescope.plans import bindings as B
from tablescope.plans.base import ALL_TABLES, R, TABLE_COLUMNS, q, query, tables, type_case, union_all
from tablescope.plans.quality_queries import REPORT_AS_OF, SQL_QUALITY_OVERVIEW, SQL_REPORT, _fk_list
from tablescope.session import materialize, shared_dir
from tablescope.sources import sinks
from tablescope.sources.tables import list_tables, load_tables

# --- shared SQL fragments ---------------------------------------------------------------

COUNTS_SQL = union_all([f"SELECT {q(t)} AS table_name, count(*) AS row_count FROM {t}" for t in ALL_TABLES])
COLS_SQL = union_all([
    f"SELECT {q(t)} AS table_name, CAST(row_number() OVER () AS INTEGER) AS ordinal_position, column_name, "
    f"{type_case('column_type')} AS data_type, \"null\" = 'YES' AS nullable FROM (DESCRIBE {t})" for t in ALL_TABLES])


def _sqlv(v) -> str:
    return "NULL" if v is None else (str(v) if isinstance(v, int) else q(v))


CONS_SQL = ("SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(_sqlv(x) for x in r[:7]) + ")" for r in B.CONSTRAINT_ROWS)
    + ") AS v(table_name, kind, name, position, col, ref_table, ref_column)")

KEYED_SQL = f"""cols AS ({COLS_SQL}), cons AS ({CONS_SQL}), counts AS ({COUNTS_SQL}),
flags AS (SELECT table_name, col AS column_name, bool_or(kind = 'pk') AS is_primary_key,
            bool_or(kind = 'fk') AS is_foreign_key,
            min(CASE WHEN kind = 'fk' THEN ref_table || '.' || ref_column END) AS foreign_key_ref
          FROM cons WHERE kind IN ('pk', 'fk') GROUP BY table_name, col),
keyed AS (SELECT c.table_name, c.ordinal_position, c.column_name, c.data_type, c.nullable,
            coalesce(f.is_primary_key, false) AS is_primary_key, coalesce(f.is_foreign_key, false) AS is_foreign_key,
            f.foreign_key_ref
          FROM cols c LEFT JOIN flags f ON f.table_name = c.table_name AND f.column_name = c.column_name)"""

EDGES_SQL = ("SELECT table_name AS source, ref_table AS target, col || ' → ' || ref_column AS label, "
             "name AS constraint_name, position FROM cons WHERE kind = 'fk' AND ref_table IS NOT NULL AND ref_table <> ''")


def _base(spark, sf):
    t = tables(spark, sf)
    cons = B.constraints(spark)
    return t, cons, catalog.columns_df(t, cons)


def _with_counts(df, t):
    return df.join(catalog.row_counts(t), "table_name", "left")


NULLS_SQL = "nulls AS (" + union_all([
    f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count FROM {t}"
    for t in ALL_TABLES for c, _ in TABLE_COLUMNS[t]]) + ")"


def _with_nulls(df, t):
    """Metadata of columns beside what the data says: rows and observed nulls."""
    return df.join(catalog.column_nulls(t), ["table_name", "column_name"], "left")


def _with_integrity(edges, t, fks):
    """Edges beside what the data says of the keys ``fks``: rows of both sides, orphan rows,
    rows a parent. One scan of each side of a key gives all of it."""
    ri = keys.referential_integrity(t, fks, count_parents=True).select(
        "constraint_name", F.col("child_rows").alias("source_rows"), F.col("parent_rows").alias("target_rows"), "orphan_rows")
    fan = round_half_up(ratio("source_rows", "target_rows"), 4).alias("fan_out")
    return edges.join(ri, "constraint_name", "left").select(*edges.columns, "source_rows", "target_rows", "orphan_rows", fan)


INTEGRITY_SQL = "ri AS (" + union_all([
    f"SELECT {q(fk.name)} AS constraint_name, (SELECT count(*) FROM {fk.table}) AS source_rows, "
    f"(SELECT count(*) FROM {fk.ref_table}) AS target_rows, (SELECT count(*) FROM {fk.table} c WHERE "
    + " AND ".join(f"c.{c} IS NOT NULL" for c in fk.columns)
    + f" AND NOT EXISTS (SELECT 1 FROM {fk.ref_table} p WHERE "
    + " AND ".join(f"c.{c} = p.{rc}" for c, rc in fk.pairs) + ")) AS orphan_rows" for fk in _fk_list()]) + ")"
_FACTS = f"ri.source_rows, ri.target_rows, ri.orphan_rows, {R('CAST(ri.source_rows AS DOUBLE) / ri.target_rows', 4)} AS fan_out"


# --- C1-C12 ---------------------------------------------------------------------------

@query("catalog_tables", union_all([
    f"SELECT {q(t)} AS table_name, 'BASE TABLE' AS table_type, count(*) AS row_count FROM {t}" for t in ALL_TABLES]))
def q_catalog_tables(spark, sf):
    """The base tables that the source holds, with row counts."""
    t = load_tables(spark, sf)
    return catalog.row_counts(t).select("table_name", F.lit("BASE TABLE").alias("table_type"), "row_count")


@query("catalog_columns", f"""WITH {KEYED_SQL}, {NULLS_SQL}
SELECT keyed.*, CAST(NULL AS VARCHAR) AS default_value, nulls.row_count, nulls.null_count
FROM keyed LEFT JOIN nulls ON nulls.table_name = keyed.table_name AND nulls.column_name = keyed.column_name""")
def q_catalog_columns(spark, sf):
    t, cons, cols = _base(spark, sf)
    return _with_nulls(cols, t)


def _sql_constraints() -> str:
    groups: dict[tuple[str, str, str], list] = {}
    for r in sorted(B.CONSTRAINT_ROWS, key=lambda r: (r[0], r[1], r[2], r[3])):
        groups.setdefault((r[0], r[1], r[2]), []).append(r)
    parts = []
    for (t, kind, name), rs in groups.items():
        cols = [r[4] for r in rs]
        if kind in ("pk", "unique"):
            v = f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {t}))"
        elif kind == "fk":
            nn = " AND ".join(f"c.{c} IS NOT NULL" for c in cols)
            on = " AND ".join(f"c.{c} = p.{r[6]}" for c, r in zip(cols, rs))
            v = f"(SELECT count(*) FROM {t} c WHERE {nn} AND NOT EXISTS (SELECT 1 FROM {rs[0][5]} p WHERE {on}))"
        elif kind == "not_null":
            v = f"(SELECT count(*) FROM {t} WHERE {cols[0]} IS NULL)"
        elif kind == "check":
            v = f"(SELECT count(*) FROM {t} WHERE NOT ({rs[0][7]}))"
        else:
            v = "CAST(NULL AS BIGINT)"
        ref_cols = ",".join(r[6] for r in rs) if kind == "fk" else None
        parts.append(f"SELECT {q(t)} AS table_name, {q(kind)} AS kind, {q(name)} AS constraint_name, "
                     f"{q(','.join(cols))} AS columns, CAST({_sqlv(rs[0][5])} AS VARCHAR) AS ref_table, "
                     f"CAST({_sqlv(ref_cols)} AS VARCHAR) AS ref_columns, CAST({_sqlv(rs[0][7])} AS VARCHAR) AS expression, "
                     f"CAST({v} AS BIGINT) AS violations")
    return union_all(parts)


@query("catalog_constraints", _sql_constraints())
def q_catalog_constraints(spark, sf):
    t, cons, _ = _base(spark, sf)
    return catalog.constraints_summary(t, cons)


@query("table_row_counts", COUNTS_SQL)
def q_table_row_counts(spark, sf):
    return catalog.row_counts(tables(spark, sf))


OVERVIEW_SQL = (f"SELECT 'main' AS schema_name, c.table_name, c.row_count, CAST(k.n AS INTEGER) AS column_count "
                f"FROM ({COUNTS_SQL}) c JOIN (SELECT table_name, count(*) AS n FROM ({COLS_SQL}) GROUP BY table_name) k "
                f"ON k.table_name = c.table_name")


@query("tables_overview", OVERVIEW_SQL)
def q_tables_overview(spark, sf):
    return catalog.tables_overview(tables(spark, sf))


@query("tables_by_schema", f"""SELECT schema_name, string_agg(table_name, ',' ORDER BY table_name) AS tables,
  count(*) AS table_count, CAST(sum(row_count) AS BIGINT) AS total_rows FROM ({OVERVIEW_SQL}) GROUP BY schema_name""")
def q_tables_by_schema(spark, sf):
    g = catalog.tables_by_schema(catalog.tables_overview(tables(spark, sf)))
    return g.select("schema_name", F.concat_ws(",", "tables").alias("tables"), "table_count", "total_rows")


@query("table_roles", union_all([f"SELECT {q(r)} AS role, {q(t)} AS table_name, count(*) AS row_count FROM {t}"
                                 for r, t in (("orders", "orders"), ("customers", "customer"), ("products", "lineitem"))]))
def q_table_roles(spark, sf):
    """K8: which of the source's tables plays which part, by name, with its rows."""
    roles = kpi.match_table_roles(list_tables(spark, sf))
    counts = catalog.row_counts(tables(spark, sf, *roles.values()))
    named = spark.createDataFrame(list(roles.items()), "role STRING, table_name STRING")
    return named.join(counts, "table_name").select("role", "table_name", "row_count")


@query("snapshot_roundtrip", f"""WITH cols AS ({COLS_SQL}), counts AS ({COUNTS_SQL})
SELECT cols.*, CAST(NULL AS VARCHAR) AS default_value, counts.row_count
FROM cols JOIN counts ON counts.table_name = cols.table_name""")
def q_snapshot_roundtrip(spark, sf):
    """The schema snapshot as it is read back after being saved twice."""
    t = tables(spark, sf)
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.save_snapshot(catalog.schema_columns(t), path, "now")
    return _with_counts(sinks.load_snapshot(spark, path, "now"), t)


# orders as they were, and after a month was dropped, every 5,000th order became dearer and
# the orders of another month were delivered twice
MONTH = "date_format(o_orderdate, 'yyyy-MM')"
CHANGES_SQL = """m AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS part FROM orders),
n AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 5000 = 7 THEN 1 ELSE 0 END AS o_totalprice,
        o_orderdate, o_orderpriority, part FROM m WHERE part <> '1995-03'
      UNION ALL SELECT * FROM m WHERE part = '1996-02')"""


@query("content_diff", f"""WITH {CHANGES_SQL},
d AS (SELECT part FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM n) UNION SELECT part FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM m)),
a AS (SELECT part, count(*) AS c FROM m GROUP BY part), b AS (SELECT part, count(*) AS c FROM n GROUP BY part)
SELECT 'orders' AS table_name, d.part, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' ELSE 'changed' END AS change,
  a.c AS old_rows, b.c AS new_rows
FROM d LEFT JOIN a ON a.part = d.part LEFT JOIN b ON b.part = d.part""")
def q_content_diff(spark, sf):
    """Months of orders whose content differs between two saved fingerprints."""
    old = tables(spark, sf, "orders")["orders"]
    dearer = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5000 == 7, 1).otherwise(0)
    new = old.where(f"{MONTH} <> '1995-03'").withColumn("o_totalprice", dearer).unionByName(old.where(f"{MONTH} = '1996-02'"))
    path = f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
    for name, df in (("old", old), ("new", new)):
        sinks.save_snapshot(fingerprint.table_fingerprints({"orders": df}, {"orders": MONTH}), path, name)
    return fingerprint.content_diff(*(sinks.load_snapshot(spark, path, name) for name in ("old", "new")))


def _sql_merged_profile() -> str:
    parts = []
    for i, (c, kind) in enumerate(TABLE_COLUMNS["orders"]):
        number = f"CAST({c} AS DOUBLE)" if kind in ("BIGINT", "INTEGER", "DOUBLE") else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT {i + 1} AS ordinal, {q(c)} AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
                     f"min(CAST({c} AS VARCHAR)) AS min_value, max(CAST({c} AS VARCHAR)) AS max_value, "
                     f"{R(f'avg({number})', 4)} AS mean_value, {R(f'stddev_samp({number})', 2)} AS std_dev FROM orders")
    return union_all(parts)


@query("incremental_profile", _sql_merged_profile())
def q_incremental_profile(spark, sf):
    """Q2/Q12: the profile of orders from stored profiles of its years, made in two runs: the
    second reads only the years that were added (or whose files changed)."""
    orders = tables(spark, sf, "orders")["orders"].withColumn("year", F.year("o_orderdate"))
    root = f"{shared_dir(spark)}/profile-{uuid.uuid4().hex}"
    for part, mode in (("year < 1997", "overwrite"), ("year >= 1997", "append")):
        orders.where(part).write.mode(mode).partitionBy("year").parquet(f"{root}/orders")
        table = spark.read.parquet(f"{root}/orders")
        incremental_profile.update_profile(table, "year", f"{root}/store")
    done = incremental_profile.merged_profile(incremental_profile.stored_profile(table, "year", f"{root}/store"))
    return done.select("ordinal", "column_name", "total_rows", "null_count", "min_value", "max_value",
                       round_half_up("mean_value", 4).alias("mean_value"), round_half_up("std_dev", 2).alias("std_dev"))


@query("table_size_top8", f"""WITH o AS ({OVERVIEW_SQL})
SELECT table_name, row_count, CAST(sum(row_count) OVER () AS BIGINT) AS total_rows, count(*) OVER () AS table_count,
  {R('CAST(row_count AS DOUBLE) * 100.0 / greatest(max(row_count) OVER (), 1)', 1)} AS bar_pct
FROM o ORDER BY row_count DESC, table_name LIMIT 8""")
def q_table_size_top8(spark, sf):
    return catalog.table_size_top(catalog.tables_overview(tables(spark, sf)), 8)


@query("schema_snapshot", f"""WITH {KEYED_SQL},
c AS (SELECT table_name, CAST(count(*) AS INTEGER) AS column_count,
        string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal_position) AS columns
      FROM keyed GROUP BY table_name),
pk AS (SELECT table_name, string_agg(col, ',' ORDER BY position) AS primary_keys FROM cons WHERE kind = 'pk'
       GROUP BY table_name),
fk AS (SELECT table_name, string_agg(col || '->' || ref_table || '.' || ref_column, ',' ORDER BY name, position)
         AS foreign_keys FROM cons WHERE kind = 'fk' GROUP BY table_name)
SELECT 'main' AS schema_name, c.table_name, counts.row_count, c.column_count, c.columns,
  coalesce(pk.primary_keys, '') AS primary_keys, coalesce(fk.foreign_keys, '') AS foreign_keys
FROM c JOIN counts ON counts.table_name = c.table_name LEFT JOIN pk ON pk.table_name = c.table_name
LEFT JOIN fk ON fk.table_name = c.table_name""")
def q_schema_snapshot(spark, sf):
    t, cons, _ = _base(spark, sf)
    s = catalog.schema_snapshot(t, cons)
    return s.select("schema_name", "table_name", "row_count", "column_count",
                    F.concat_ws(",", F.transform("columns", lambda c: F.concat(c["column_name"], F.lit(":"),
                                                                               c["data_type"]))).alias("columns"),
                    F.concat_ws(",", "primary_keys").alias("primary_keys"),
                    F.concat_ws(",", "foreign_keys").alias("foreign_keys"))


_ENTRY = ("column_name || ':' || data_type || ':' || CASE WHEN nullable THEN 'true' ELSE 'false' END || ':' || "
          "concat_ws(',', CASE WHEN is_primary_key THEN 'PK' END, foreign_key_ref)")


@query("schema_fingerprint", f"""WITH {KEYED_SQL}
SELECT k.table_name, md5(string_agg({_ENTRY}, '|' ORDER BY {_ENTRY})) AS schema_hash,
  count(*) AS column_count, max(counts.row_count) AS row_count
FROM keyed k JOIN counts ON counts.table_name = k.table_name GROUP BY k.table_name""")
def q_schema_fingerprint(spark, sf):
    t, cons, cols = _base(spark, sf)
    fp = catalog.schema_fingerprint(cols)
    return fp.join(catalog.row_counts(t), "table_name")


def _migrated(t: dict) -> dict:
    """A schema migration expressed as Spark transformations of the tables."""
    new = dict(t)
    new["orders"] = t["orders"].withColumn("o_year", F.year("o_orderdate").cast("int"))
    new["lineitem"] = t["lineitem"].withColumn("l_quantity", F.col("l_quantity").cast("int")).drop("l_linestatus")
    return new


_NEW_COLS_SQL = union_all([
    f"SELECT {q(t)} AS table_name, column_name, {type_case('column_type')} AS data_type FROM (DESCRIBE {src})"
    for t, src in [(t, {"orders": "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders",
                        "lineitem": "SELECT * EXCLUDE (l_linestatus, l_quantity), CAST(l_quantity AS INTEGER) "
                                    "AS l_quantity FROM lineitem"}.get(t, t)) for t in ALL_TABLES]])


@query("schema_diff", f"""WITH o AS ({COLS_SQL}), n AS ({_NEW_COLS_SQL}),
j AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.column_name, n.column_name) AS column_name,
        o.data_type AS old_type, n.data_type AS new_type
      FROM o FULL OUTER JOIN n ON o.table_name = n.table_name AND o.column_name = n.column_name)
SELECT table_name, column_name,
  CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed'
       WHEN old_type <> new_type THEN 'type_changed' END AS change, old_type, new_type,
  CASE column_name WHEN 'o_year' THEN (SELECT count(o_orderdate) FROM orders) WHEN 'l_linestatus' THEN (SELECT count(l_linestatus) FROM lineitem)
    ELSE (SELECT count(*) FROM lineitem WHERE l_quantity <> floor(l_quantity)) END AS affected_rows
FROM j
WHERE old_type IS NULL OR new_type IS NULL OR old_type <> new_type""")
def q_schema_diff(spark, sf):
    t = tables(spark, sf)
    new = _migrated(t)
    diff = catalog.schema_diff(catalog.schema_columns(t), catalog.schema_columns(new))
    return diff.join(catalog.change_impact(t, new), ["table_name", "column_name"], "left")


# --- L1-L6, J3 ------------------------------------------------------------------------

def _edges(spark):
    return lineage.lineage_edges(B.constraints(spark))


@query("lineage_edges", f"""WITH cons AS ({CONS_SQL}), e AS ({EDGES_SQL}), {INTEGRITY_SQL}
SELECT e.*, {_FACTS} FROM e LEFT JOIN ri ON ri.constraint_name = e.constraint_name""")
def q_lineage_edges(spark, sf):
    return _with_integrity(_edges(spark), tables(spark, sf), _fk_list())


NODES_SQL = f"""cons AS ({CONS_SQL}), e AS ({EDGES_SQL}), o AS ({OVERVIEW_SQL}),
nodes AS (SELECT o.table_name AS id, o.schema_name AS schema, o.row_count, o.column_count,
  CAST(coalesce((SELECT count(*) FROM e WHERE e.source = o.table_name), 0) AS BIGINT) AS out_degree,
  CAST(coalesce((SELECT count(*) FROM e WHERE e.target = o.table_name), 0) AS BIGINT) AS in_degree,
  (SELECT count(*) FROM o) AS table_count, (SELECT count(*) FROM e) AS relationship_count FROM o)"""


@query("lineage_nodes", f"WITH {NODES_SQL} SELECT * FROM nodes")
def q_lineage_nodes(spark, sf):
    return lineage.lineage_nodes(catalog.tables_overview(tables(spark, sf)), _edges(spark))


FOCUS = "orders"


@query("lineage_neighbors", f"""WITH cons AS ({CONS_SQL}), e AS ({EDGES_SQL}), {INTEGRITY_SQL},
x AS (SELECT e.*, {_FACTS} FROM e LEFT JOIN ri ON ri.constraint_name = e.constraint_name)
SELECT {q(FOCUS)} AS focus_table, 'upstream' AS direction, target AS table_name, label, target_rows AS row_count, orphan_rows, fan_out
FROM x WHERE source = {q(FOCUS)}
UNION ALL SELECT {q(FOCUS)}, 'downstream', source, label, source_rows, orphan_rows, fan_out FROM x WHERE target = {q(FOCUS)}""")
def q_lineage_neighbors(spark, sf):
    t = tables(spark, sf)
    edges = _edges(spark)
    facts = _with_integrity(edges, t, [fk for fk in _fk_list() if FOCUS in (fk.table, fk.ref_table)])
    near = lineage.lineage_neighbors(edges, FOCUS)
    other = F.when(F.col("source") == FOCUS, F.col("target")).otherwise(F.col("source"))
    facts = facts.where((F.col("source") == FOCUS) | (F.col("target") == FOCUS)).select(
        other.alias("table_name"), "label", "orphan_rows", "fan_out",
        F.when(F.col("source") == FOCUS, F.col("target_rows")).otherwise(F.col("source_rows")).alias("row_count"))
    return near.join(facts, ["table_name", "label"], "left").select(
        "focus_table", "direction", "table_name", "label", "row_count", "orphan_rows", "fan_out")


@query("lineage_isolated", f"""WITH {NODES_SQL}
SELECT id AS table_name, row_count FROM nodes WHERE id NOT IN (SELECT source FROM e UNION SELECT target FROM e)""")
def q_lineage_isolated(spark, sf):
    nodes = lineage.lineage_nodes(catalog.tables_overview(tables(spark, sf)), _edges(spark))
    return lineage.lineage_isolated(nodes, _edges(spark))


@query("lineage_columns", f"""WITH {KEYED_SQL}, {NULLS_SQL}, e AS ({EDGES_SQL})
SELECT k.table_name, k.column_name, k.data_type, k.is_primary_key, k.is_foreign_key,
  (SELECT count(DISTINCT table_name) FROM keyed) AS table_count, (SELECT count(*) FROM keyed) AS column_count,
  (SELECT count(*) FROM e) AS relationship_count, nulls.row_count, nulls.null_count
FROM keyed k LEFT JOIN nulls ON nulls.table_name = k.table_name AND nulls.column_name = k.column_name""")
def q_lineage_columns(spark, sf):
    t, cons, cols = _base(spark, sf)
    return _with_nulls(lineage.lineage_columns(cols, lineage.lineage_edges(cons)), t)


@query("er_columns", f"""WITH {KEYED_SQL}, {NULLS_SQL}
SELECT replace(k.table_name, '.', '_') AS table_id, k.ordinal_position, upper(split_part(k.data_type, '(', 1)) AS type_name,
  k.column_name, CASE WHEN k.is_primary_key THEN 'PK' ELSE '' END AS pk_mark,
  CASE WHEN k.is_foreign_key THEN 'FK' ELSE '' END AS fk_mark, nulls.row_count, nulls.null_count
FROM keyed k LEFT JOIN nulls ON nulls.table_name = k.table_name AND nulls.column_name = k.column_name""")
def q_er_columns(spark, sf):
    t, cons, cols = _base(spark, sf)
    facts = catalog.column_nulls(t).withColumn("table_id", F.regexp_replace("table_name", r"\.", "_")).drop("table_name")
    return lineage.er_columns(cols).join(facts, ["table_id", "column_name"], "left")


@query("fk_join_preview", """SELECT a.l_orderkey AS a_l_orderkey, a.l_partkey AS a_l_partkey, a.l_suppkey AS a_l_suppkey,
  b.o_orderkey AS b_o_orderkey, b.o_custkey AS b_o_custkey, b.o_orderstatus AS b_o_orderstatus
FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey
ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 20""")
def q_fk_join_preview(spark, sf):
    t = tables(spark, sf, "lineitem", "orders")
    fk = next(f for f in _fk_list() if f.name == "lineitem_orders_fk")
    return lineage.fk_join_preview(t, fk, 20, 3)


# --- D1-D8, J5 ------------------------------------------------------------------------

def _rule_sql(col: str, rules, default: str, pk: str | None = None) -> str:
    whens = []
    for frags, text in rules:
        cond = " OR ".join(f"contains(lower({col}), {q(f)})" for f in frags)
        whens.append(f"WHEN {cond} THEN {q(text)}")
    if pk is not None:
        whens.append(f"WHEN coalesce({pk}, false) THEN {q(dictionary.PK_DESCRIPTION)}")
    return f"CASE {' '.join(whens)} ELSE {q(default)} END"


DESC_SQL = _rule_sql("column_name", dictionary.DESCRIPTION_RULES, dictionary.DEFAULT_DESCRIPTION, "is_primary_key")
USE_SQL = _rule_sql("column_name", dictionary.BUSINESS_USE_RULES, dictionary.DEFAULT_BUSINESS_USE)
DOCS_COLS_SQL = (f"SELECT table_name, ordinal_position, column_name, data_type, nullable, is_primary_key, "
                 f"{DESC_SQL} AS description, {USE_SQL} AS business_use FROM keyed")


@query("docs_columns", f"""WITH {KEYED_SQL}, {NULLS_SQL}, d AS ({DOCS_COLS_SQL})
SELECT d.*, nulls.row_count, nulls.null_count FROM d LEFT JOIN nulls ON nulls.table_name = d.table_name AND nulls.column_name = d.column_name""")
def q_docs_columns(spark, sf):
    t, cons, cols = _base(spark, sf)
    return _with_nulls(dictionary.document_columns(cols), t)


FACTS_SQL = """facts AS (SELECT k.table_name, count(*) AS column_count, count(*) FILTER (WHERE nullable) AS nullable_count,
    bool_or(is_primary_key) AS has_pk,
    bool_or(contains(lower(column_name), 'timestamp') OR contains(lower(column_name), 'date')) AS has_time,
    bool_or(contains(lower(column_name), 'price') OR contains(lower(column_name), 'value')) AS has_money,
    max(counts.row_count) AS row_count
  FROM keyed k JOIN counts ON counts.table_name = k.table_name GROUP BY k.table_name)"""

_KNOWN_DESC = "CASE table_name " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in dictionary.TABLE_DESCRIPTIONS.items()) + " END"
_KNOWN_Q = "CASE table_name " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in dictionary.TABLE_QUERIES.items()) + " END"
TABLES_DOC_SQL = (f"SELECT table_name, column_count, row_count, coalesce({_KNOWN_DESC}, 'Data table with ' || "
                  f"column_count || ' columns and ' || format('{{:,}}', row_count) || ' records.') "
                  f"AS business_description, coalesce({_KNOWN_Q}, 'SELECT * FROM ' || table_name || "
                  f"' LIMIT 10' || chr(10) || 'SELECT COUNT(*) FROM ' || table_name) AS suggested_queries FROM facts")


@query("docs_tables", f"WITH {KEYED_SQL}, {FACTS_SQL} {TABLES_DOC_SQL}")
def q_docs_tables(spark, sf):
    t, cons, cols = _base(spark, sf)
    return dictionary.document_tables(cols, catalog.tables_overview(t))


@query("docs_fallback", f"""WITH {KEYED_SQL}, {FACTS_SQL}
SELECT k.table_name, 'This table contains ' || max(facts.row_count) || ' records for ' || k.table_name || '.' AS business_summary,
  string_agg(column_name || '=' || data_type, ',' ORDER BY column_name) AS column_descriptions,
  'Join with related tables using foreign keys,Check data quality metrics before analysis' AS usage_recommendations
FROM keyed k JOIN facts ON facts.table_name = k.table_name GROUP BY k.table_name""")
def q_docs_fallback(spark, sf):
    t, cons, cols = _base(spark, sf)
    d = dictionary.fallback_documentation(cols, catalog.tables_overview(t))
    pairs = F.transform(F.array_sort(F.map_entries("column_descriptions")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return d.select("table_name", "business_summary", F.concat_ws(",", pairs).alias("column_descriptions"),
                    F.concat_ws(",", "usage_recommendations").alias("usage_recommendations"))


_SCALE = dictionary.INSIGHT_SCALE.split("{rows}")


@query("docs_insights", f"""WITH {KEYED_SQL}, {FACTS_SQL}, e AS ({EDGES_SQL}),
rel AS (SELECT source AS table_name, string_agg(target, ', ' ORDER BY constraint_name, position, target) AS targets
        FROM e WHERE position = 1 GROUP BY source),
f AS (SELECT facts.*, rel.targets FROM facts LEFT JOIN rel ON rel.table_name = facts.table_name),
x AS (
  SELECT table_name, 0 AS position, {q(dictionary.INSIGHT_RELATIONSHIPS)} || targets AS insight FROM f WHERE targets IS NOT NULL
  UNION ALL SELECT table_name, 1, {q(dictionary.INSIGHT_TIME)} FROM f WHERE has_time
  UNION ALL SELECT table_name, 2, {q(dictionary.INSIGHT_FINANCIAL)} FROM f WHERE has_money
  UNION ALL SELECT table_name, 3, {q(_SCALE[0])} || format('{{:,}}', row_count) || {q(_SCALE[1])} FROM f
    WHERE row_count > {dictionary.LARGE_TABLE_ROWS})
SELECT table_name, CAST(position AS INTEGER) AS position, insight FROM x""")
def q_docs_insights(spark, sf):
    t, cons, cols = _base(spark, sf)
    return dictionary.document_insights(cols, catalog.tables_overview(t), lineage.lineage_edges(cons))


_NUL = dictionary.NOTE_NULLABLE.split("{n}")


@query("docs_quality_notes", f"""WITH {KEYED_SQL}, {FACTS_SQL},
x AS (
  SELECT table_name, 0 AS position, {q(_NUL[0])} || nullable_count || {q(_NUL[1])} AS note FROM facts WHERE nullable_count > 0
  UNION ALL SELECT table_name, 1, {q(dictionary.NOTE_NO_PK)} FROM facts WHERE NOT coalesce(has_pk, false)
  UNION ALL SELECT table_name, 2, {q(dictionary.NOTE_EMPTY)} FROM facts WHERE row_count = 0)
SELECT table_name, CAST(position AS INTEGER) AS position, note FROM x""")
def q_docs_quality_notes(spark, sf):
    t, cons, cols = _base(spark, sf)
    return dictionary.document_quality_notes(cols, catalog.tables_overview(t))


DICT_SQL = f"""qo AS ({SQL_QUALITY_OVERVIEW}), dc AS ({DOCS_COLS_SQL}),
dict AS (SELECT k.table_name, k.ordinal_position, k.column_name, k.data_type, k.nullable, k.is_primary_key,
           k.is_foreign_key, qo.null_rate, qo.distinct_count, dc.description, dc.business_use
         FROM keyed k LEFT JOIN qo ON qo.table_name = k.table_name AND qo.column_name = k.column_name
         LEFT JOIN dc ON dc.table_name = k.table_name AND dc.column_name = k.column_name)"""


def _dictionary(spark, sf):
    """Shared inputs of the composite dictionary queries: one profile of every table
    gives the per-column quality, the per-table overview and the quality report."""
    t, cons, cols = _base(spark, sf)
    # one row per column of every table: small, and reused by every part of the
    # export, so it is checkpointed to the shared folder once
    counts = materialize(profile.quality_counts(t))
    quality = counts.drop("null_count").where(F.col("row_count") > 0)
    docs = dictionary.document_columns(cols)
    return t, cons, cols, quality, docs, dictionary.data_dictionary(cols, quality, docs), \
        catalog.overview_from_quality(counts), counts


@query("data_dictionary", f"WITH {KEYED_SQL}, {DICT_SQL} SELECT * FROM dict")
def q_data_dictionary(spark, sf):
    return _dictionary(spark, sf)[5]


@query("table_digest", f"""WITH {KEYED_SQL}, {FACTS_SQL}, {DICT_SQL}, td AS ({TABLES_DOC_SQL}),
tq AS (SELECT DISTINCT table_name, overall_completeness FROM qo),
lines AS (SELECT table_name, count(*) AS n,
  string_agg(CASE WHEN ordinal_position <= 20 THEN '`' || column_name || '` (' || data_type || ')' ||
    CASE WHEN is_primary_key THEN ' [PK]' ELSE '' END || CASE WHEN is_foreign_key THEN ' [FK]' ELSE '' END ||
    ': ' || coalesce(description, '') END, chr(10) ORDER BY ordinal_position) AS column_lines
  FROM dict GROUP BY table_name)
SELECT l.table_name, td.business_description AS summary, td.row_count,
  coalesce(CAST({R('tq.overall_completeness * 100', 1)} AS VARCHAR) || '%', 'N/A') AS completeness,
  l.column_lines, CAST(greatest(l.n - 20, 0) AS INTEGER) AS more_columns
FROM lines l JOIN td ON td.table_name = l.table_name LEFT JOIN tq ON tq.table_name = l.table_name""")
def q_table_digest(spark, sf):
    t, cons, cols, quality, docs, dic, overview, _ = _dictionary(spark, sf)
    tq = quality.select("table_name", "overall_completeness").distinct()
    return dictionary.table_digest(dic, dictionary.document_tables(cols, overview), tq)


@query("stat_highlights", union_all([
    f"SELECT {q(c)} AS column_name, min(CAST({c} AS VARCHAR)) AS min_value, max(CAST({c} AS VARCHAR)) AS max_value, "
    f"{R(f'avg(CAST({c} AS DOUBLE))', 2)} AS mean, {R(f'stddev_samp(CAST({c} AS DOUBLE))', 2)} AS std_dev FROM lineitem"
    for c in [c for c, ty in TABLE_COLUMNS['lineitem'] if ty in ('BIGINT', 'INTEGER', 'DOUBLE')]]))
def q_stat_highlights(spark, sf):
    li = tables(spark, sf, "lineitem")["lineitem"]
    # D8 needs the text range and moments only — no distinct counts
    return dictionary.stat_highlights(profile.column_profile(li, metrics=("text_range", "moments")))


# --- S4, S5 -----------------------------------------------------------------------------

def _numeric_stats(t: dict) -> DataFrame:
    """Text range and moments of the numeric columns of every table (D8's input)."""
    parts = []
    for name, df in t.items():
        cols = numeric_columns(df)
        if cols:
            p = profile.column_profile(df, cols, metrics=("text_range", "moments"))
            parts.append(p.select(F.lit(name).alias("table_name"), "column_name", "min_value", "max_value", "mean_value", "std_dev"))
    return profile.union_all(parts)


def _document_inputs(spark, sf):
    t, cons, cols, quality, docs, _, overview, counts = _dictionary(spark, sf)
    # one row per table, read by several parts of the document
    rep = materialize(report.quality_report(t, primary_keys(cons), B.TS_COLUMNS, REPORT_AS_OF, counts))
    tdoc = dictionary.document_tables(cols, overview)
    stats = materialize(_numeric_stats(t))  # one row a numeric column
    return cols, docs, quality, rep, tdoc, lineage.lineage_edges(cons), stats, dictionary.fallback_documentation(cols, overview)


STATS_SQL = "stats AS (" + union_all([
    f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, min(CAST({c} AS VARCHAR)) AS min_value, max(CAST({c} AS VARCHAR)) AS max_value, "
    f"avg(CAST({c} AS DOUBLE)) AS mean_value, stddev_samp(CAST({c} AS DOUBLE)) AS std_dev FROM {t}"
    for t in ALL_TABLES for c, ty in TABLE_COLUMNS[t] if ty in ("BIGINT", "INTEGER", "DOUBLE")]) + ")"
DOCUMENT_SQL = f"{KEYED_SQL}, {FACTS_SQL}, {DICT_SQL}, td AS ({TABLES_DOC_SQL}), rep AS ({SQL_REPORT}), e AS ({EDGES_SQL}), {STATS_SQL}"


@query("dictionary_export", f"""WITH {DOCUMENT_SQL}
SELECT 'testdata' AS database, d.table_name, d.ordinal_position, d.column_name AS name, d.data_type AS type, d.nullable,
  d.is_primary_key, d.is_foreign_key, k.foreign_key_ref, d.null_rate, d.distinct_count, s.min_value, s.max_value,
  {R('s.mean_value', 4)} AS mean_value, {R('s.std_dev', 4)} AS std_dev, d.description, d.business_use,
  CAST((SELECT count(*) FROM e WHERE e.source = d.table_name) AS INTEGER) AS n_foreign_keys, rep.row_count,
  rep.overall_completeness, rep.pk_columns, rep.pk_uniqueness_rate, rep.freshness_column, rep.freshness_latest,
  rep.freshness_age_days, td.business_description, td.suggested_queries, 2 AS n_recommendations
FROM dict d JOIN keyed k ON k.table_name = d.table_name AND k.column_name = d.column_name
JOIN rep ON rep.table_name = d.table_name JOIN td ON td.table_name = d.table_name
LEFT JOIN stats s ON s.table_name = d.table_name AND s.column_name = d.column_name""")
def q_dictionary_export(spark, sf):
    """The nested dictionary document that ``export_json`` writes, one row a column."""
    doc = sinks.dictionary_document(*_document_inputs(spark, sf), database="testdata")
    c = doc.select("database", "table_name", F.inline("columns"), F.size("foreign_keys").alias("n_foreign_keys"), "quality.*",
                   "documentation.business_description", "documentation.suggested_queries",
                   F.size("documentation.usage_recommendations").alias("n_recommendations"))
    return c.withColumns({m: round_half_up(m, 4) for m in ("mean_value", "std_dev")})


def _md(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


_PCT = lambda c: f"CAST({R(f'{c} * 100', 1)} AS VARCHAR) || '%'"


@query("dictionary_markdown", f"""WITH {DOCUMENT_SQL},
cl AS (SELECT table_name, string_agg('| `' || column_name || '` | `' || data_type || '` | ' || CASE WHEN nullable THEN 'Yes' ELSE 'No' END
    || ' | ' || CASE WHEN is_primary_key THEN '✓' ELSE '' END || ' | ' || CASE WHEN is_foreign_key THEN '✓' ELSE '' END || ' | '
    || coalesce({_PCT('null_rate')}, '-') || ' | ' || coalesce(CAST(distinct_count AS VARCHAR), '-') || ' | ' || coalesce(description, '') || ' |',
    chr(10) ORDER BY ordinal_position) AS x FROM dict GROUP BY table_name),
hl AS (SELECT d.table_name, string_agg('| `' || d.column_name || '` | ' || s.min_value || ' | ' || s.max_value || ' | '
    || printf('%.2f', {R('s.mean_value', 2)}) || ' | ' || coalesce(printf('%.2f', {R('s.std_dev', 2)}), '-') || ' |', chr(10) ORDER BY d.ordinal_position) AS x
  FROM dict d JOIN stats s ON s.table_name = d.table_name AND s.column_name = d.column_name WHERE s.mean_value IS NOT NULL GROUP BY d.table_name),
rl AS (SELECT source AS table_name, string_agg('- `' || source || '.' || split_part(label, ' → ', 1) || '` → `' || target || '.' || split_part(label, ' → ', 2) || '`',
    chr(10) ORDER BY constraint_name, position) AS x FROM e GROUP BY source),
rt AS (SELECT table_name, string_agg('`' || target || '`', ', ' ORDER BY target) AS x FROM (SELECT DISTINCT source AS table_name, target FROM e) GROUP BY table_name),
sq AS (SELECT table_name, string_agg('```sql' || chr(10) || l || chr(10) || '```' || chr(10), chr(10) ORDER BY i) AS x
  FROM (SELECT table_name, unnest(string_split(suggested_queries, chr(10))) AS l, generate_subscripts(string_split(suggested_queries, chr(10)), 1) AS i FROM td) GROUP BY table_name)
SELECT rep.table_name, concat_ws(chr(10), '## Table: `' || rep.table_name || '`' || chr(10), '> ' || td.business_description || chr(10),
  '### Quality Metrics' || chr(10), '| Metric | Value |', '|--------|-------|',
  '| Row Count | ' || format('{{:,}}', rep.row_count) || ' |', '| Overall Completeness | ' || {_PCT('rep.overall_completeness')} || ' |',
  '| PK Uniqueness | ' || {_PCT('rep.pk_uniqueness_rate')} || ' |', '| Latest Record | ' || strftime(rep.freshness_latest, '%Y-%m-%d %H:%M:%S') || ' |', '',
  {_md("'### Columns' || chr(10)", "'| Column | Type | Nullable | PK | FK | Null Rate | Distinct | Description |'", "'|--------|------|----------|----|----|-----------|----------|-------------|'", "cl.x", "''")},
  {_md("'### Relationships' || chr(10)", "rl.x", "''")}, '**Related Tables:** ' || rt.x || chr(10),
  {_md("'### Usage Recommendations' || chr(10)", "'- Join with related tables using foreign keys'", "'- Check data quality metrics before analysis'", "''")},
  {_md("'### Statistical Highlights' || chr(10)", "'| Column | Min | Max | Mean | Std Dev |'", "'|--------|-----|-----|------|---------|'", "hl.x", "''")},
  {_md("'### Suggested Queries' || chr(10)", "sq.x")}, '---' || chr(10)) AS markdown
FROM rep JOIN td ON td.table_name = rep.table_name JOIN cl ON cl.table_name = rep.table_name JOIN sq ON sq.table_name = rep.table_name
LEFT JOIN hl ON hl.table_name = rep.table_name LEFT JOIN rl ON rl.table_name = rep.table_name LEFT JOIN rt ON rt.table_name = rep.table_name""")
def q_dictionary_markdown(spark, sf):
    """One Markdown section per table."""
    return sinks.dictionary_markdown(*_document_inputs(spark, sf))

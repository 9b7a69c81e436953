"""Dictionary export (JSON, Markdown) and schema snapshots.

The dictionary is built as frames (one row per table) and written by Spark's
writers; nothing passes through the driver. Documents are metadata-sized (one
row per table, bounded columns per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import round_half_up


# Headings, table heads and marks of the Markdown document.
TITLE = "# Data Dictionary: {database}"
CONTENTS = "## Table of Contents\n"
CONTENTS_LINE = "- [{table}](#{anchor})"
RULE = "---\n"
SECTION = "## Table: `{table}`\n"
SUMMARY = "> {summary}\n"
METRICS = ("### Quality Metrics\n", "| Metric | Value |", "|--------|-------|")
METRIC_ROWS = ("Row Count", "Overall Completeness", "PK Uniqueness", "Latest Record")
COLUMNS = ("### Columns\n", "| Column | Type | Nullable | PK | FK | Null Rate | Distinct | Description |",
           "|--------|------|----------|----|----|-----------|----------|-------------|")
RELATIONSHIPS = "### Relationships\n"
RELATED = "**Related Tables:** "
RECOMMENDATIONS = "### Usage Recommendations\n"
HIGHLIGHTS = ("### Statistical Highlights\n", "| Column | Min | Max | Mean | Std Dev |", "|--------|-----|-----|------|---------|")
QUERIES = "### Suggested Queries\n"
FENCE = ("```sql\n", "\n```\n")
CHECK = "✓"


def _per_column(columns: DataFrame, docs_columns: DataFrame, quality: DataFrame, stats: DataFrame) -> DataFrame:
    key = ["table_name", "column_name"]
    return (columns.join(quality.select(*key, "null_rate", "distinct_count"), key, "left")
            .join(docs_columns.select(*key, "description", "business_use"), key, "left")
            .join(stats.select(*key, "min_value", "max_value", "mean_value", "std_dev"), key, "left"))


def dictionary_document(columns: DataFrame, docs_columns: DataFrame, quality: DataFrame, report: DataFrame,
                        tables_doc: DataFrame, edges: DataFrame, stats: DataFrame, fallback: DataFrame,
                        database: str = "database") -> DataFrame:
    """S4 content: one nested row per table — schema, quality and documentation.

    ``columns`` = catalog.columns_df, ``docs_columns`` = dictionary.document_columns,
    ``quality`` = quality_overview, ``report`` = quality_report,
    ``tables_doc`` = dictionary.document_tables, ``edges`` = lineage_edges, ``stats`` =
    (table_name, column_name, min_value, max_value, mean_value, std_dev), ``fallback`` =
    dictionary.fallback_documentation.
    """
    per_cols = _per_column(columns, docs_columns, quality, stats).groupBy("table_name").agg(F.array_sort(F.collect_list(
        F.struct("ordinal_position", F.col("column_name").alias("name"), F.col("data_type").alias("type"), "nullable",
                 "is_primary_key", "is_foreign_key", "foreign_key_ref", "null_rate", "distinct_count", "min_value",
                 "max_value", "mean_value", "std_dev", "description", "business_use"))).alias("columns"))
    fks = edges.groupBy(F.col("source").alias("table_name")).agg(F.array_sort(F.collect_list(F.struct(
        "constraint_name", "position", F.split_part("label", F.lit(" → "), F.lit(1)).alias("column"),
        F.col("target").alias("ref_table"), F.split_part("label", F.lit(" → "), F.lit(2)).alias("ref_column")))
    ).alias("foreign_keys"))
    rep = report.select("table_name", F.struct("row_count", "overall_completeness", "pk_columns",
                                               "pk_uniqueness_rate", "freshness_column", "freshness_latest",
                                               "freshness_age_days").alias("quality"))
    doc = tables_doc.select("table_name", "business_description", "suggested_queries").join(
        fallback.select("table_name", "usage_recommendations"), "table_name", "left").select(
        "table_name", F.struct("business_description", "suggested_queries", "usage_recommendations").alias("documentation"))
    return (per_cols.join(fks, "table_name", "left").join(rep, "table_name", "left").join(doc, "table_name", "left")
            .select(F.lit(database).alias("database"), "table_name", "columns",
                    F.coalesce("foreign_keys", F.array()).alias("foreign_keys"), "quality", "documentation"))


def export_json(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the dictionary as JSON lines (one table per line)."""
    document.orderBy("table_name").write.mode(mode).json(path)


def _pct1(c: Column) -> Column:
    return F.concat(round_half_up(c * 100, 1).cast("string"), F.lit("%"))


def _cells(*cells: Column) -> Column:
    """One row of a Markdown table; a null cell makes no row."""
    return F.concat(F.lit("| "), *[x for i, c in enumerate(cells) for x in ((F.lit(" | "), c) if i else (c,))], F.lit(" |"))


def _listed(df: DataFrame, key: Column, order: list[str], line: Column, name: str) -> DataFrame:
    """The lines of each table in order, as one text."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("l")))).getField("l")
    return df.groupBy(key.alias("table_name")).agg(F.concat_ws("\n", lines).alias(name))


def _block(heads: tuple[str, ...], lines: Column) -> Column:
    """Heads, lines and an empty line; nothing where there are no lines."""
    return F.when(lines.isNotNull(), F.concat_ws("\n", *map(F.lit, heads), lines, F.lit("")))


def dictionary_markdown(columns: DataFrame, docs_columns: DataFrame, quality: DataFrame, report: DataFrame,
                        tables_doc: DataFrame, edges: DataFrame, stats: DataFrame, fallback: DataFrame) -> DataFrame:
    """One Markdown section per table (table_name, markdown); inputs as for
    ``dictionary_document``."""
    yes = lambda c, a, b: F.when(F.col(c), F.lit(a)).otherwise(F.lit(b))
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    col = _per_column(columns, docs_columns, quality, stats)
    line = _cells(code(F.col("column_name")), code(F.col("data_type")), yes("nullable", "Yes", "No"),
                  yes("is_primary_key", CHECK, ""), yes("is_foreign_key", CHECK, ""),
                  F.coalesce(_pct1(F.col("null_rate")), F.lit("-")), F.coalesce(F.col("distinct_count").cast("string"), F.lit("-")),
                  F.coalesce(F.col("description"), F.lit("")))
    two = lambda c: F.format_string("%.2f", round_half_up(c, 2))
    high = _cells(code(F.col("column_name")), F.coalesce("min_value", F.lit("-")), F.coalesce("max_value", F.lit("-")), two("mean_value"),
                  F.when(F.col("std_dev").isNotNull(), two("std_dev")).otherwise("-"))
    side = [F.split_part("label", F.lit(" → "), F.lit(i)) for i in (1, 2)]
    rel = F.concat(F.lit("- "), code(F.concat(F.col("source"), F.lit("."), side[0])), F.lit(" → "),
                   code(F.concat(F.col("target"), F.lit("."), side[1])))
    table = F.col("table_name")
    related = edges.groupBy(F.col("source").alias("table_name")).agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_set("target")), code)).alias("__related"))
    j = _listed(col, table, ["ordinal_position"], line, "__columns")
    for part in (_listed(col.where("mean_value IS NOT NULL"), table, ["ordinal_position"], high, "__high"),
                 _listed(edges, F.col("source"), ["constraint_name", "position"], rel, "__rels"), related, report,
                 tables_doc.select("table_name", "business_description", "suggested_queries"),
                 fallback.select("table_name", "usage_recommendations")):
        j = j.join(part, "table_name", "left")
    name = [F.lit(x) for x in METRIC_ROWS]
    metrics = F.concat_ws("\n", *map(F.lit, METRICS), _cells(name[0], F.format_number("row_count", 0)),
                          _cells(name[1], _pct1(F.col("overall_completeness"))), _cells(name[2], _pct1(F.col("pk_uniqueness_rate"))),
                          _cells(name[3], F.date_format("freshness_latest", "yyyy-MM-dd HH:mm:ss")), F.lit(""))
    recommended = F.concat_ws("\n", F.transform("usage_recommendations", lambda r: F.concat(F.lit("- "), r)))
    queries = F.concat_ws("\n", F.transform(F.split("suggested_queries", "\n"), lambda q: F.concat(F.lit(FENCE[0]), q, F.lit(FENCE[1]))))
    head, foot = SECTION.split("{table}")
    quote = SUMMARY.split("{summary}")
    md = F.concat_ws("\n", F.concat(F.lit(head), table, F.lit(foot)),
                     F.concat(F.lit(quote[0]), F.col("business_description"), F.lit(quote[1])),
                     metrics, _block(COLUMNS, F.col("__columns")), _block((RELATIONSHIPS,), F.col("__rels")),
                     F.concat(F.lit(RELATED), F.col("__related"), F.lit("\n")),
                     _block((RECOMMENDATIONS,), F.when(F.size("usage_recommendations") > 0, recommended)),
                     _block(HIGHLIGHTS, F.col("__high")),
                     F.when(F.col("suggested_queries").isNotNull(), F.concat_ws("\n", F.lit(QUERIES), queries)), F.lit(RULE))
    return j.select("table_name", md.alias("markdown"))


def write_markdown(sections: DataFrame, path: str, database: str = "database") -> None:
    """Write title, contents list and sections as one text file, tables in name order: one
    task, whose rows are bounded by the number of tables."""
    link = CONTENTS_LINE.split("{table}")
    middle, end = link[1].split("{anchor}")
    names = sections.select("table_name", F.lit(1).alias("part"), F.concat(
        F.lit(link[0]), "table_name", F.lit(middle), F.regexp_replace(F.lower("table_name"), " ", "-"), F.lit(end)).alias("markdown"))
    fixed = sections.sparkSession.createDataFrame(
        [("", 0, f"{TITLE.format(database=database)}\n\n{RULE}\n{CONTENTS}"), ("", 2, f"\n{RULE}")], "table_name STRING, part INT, markdown STRING")
    body = sections.select("table_name", F.lit(3).alias("part"), "markdown")
    fixed.unionByName(names).unionByName(body).orderBy("part", "table_name").coalesce(1).select("markdown") \
        .write.mode("overwrite").text(path)


def save_snapshot(columns: DataFrame, path: str, snapshot_id: str) -> None:
    """Write a column snapshot under ``snapshot_id=<id>`` (parquet, partitioned).
    Saving one id again replaces that snapshot and leaves the others."""
    (columns.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path))


def load_snapshot(spark, path: str, snapshot_id: str) -> DataFrame:
    """Read one snapshot back (partition pruning on ``snapshot_id``)."""
    return spark.read.parquet(path).where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")

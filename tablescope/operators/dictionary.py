"""Rule-based data dictionary.

Descriptions come from ordered name rules (first match wins) written as
``when`` chains, so documenting a catalog is one projection over the columns
frame; no model or Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import round_half_up

# Column-description rules, in evaluation order (name fragment(s) -> text).
DESCRIPTION_RULES = [
    (("_id",), "Unique identifier field"),
    (("_date", "timestamp"), "Temporal tracking field"),
    (("name",), "Descriptive name field"),
    (("count", "qty"), "Quantity counter"),
    (("price", "value", "amount"), "Monetary value field"),
    (("zip", "postal"), "Location identifier"),
    (("city", "state"), "Geographic location field"),
    (("status",), "Status indicator field"),
]
PK_DESCRIPTION = "Primary key - unique row identifier"
DEFAULT_DESCRIPTION = "Data field"

# Business-use rules, in evaluation order.
BUSINESS_USE_RULES = [
    (("price", "value"), "Revenue analytics"),
    (("date", "timestamp"), "Trend analysis, SLA monitoring"),
    (("status",), "Operational dashboards"),
    (("customer",), "Customer analytics, segmentation"),
    (("product",), "Inventory management, catalog"),
    (("seller",), "Vendor performance analysis"),
    (("review", "score"), "Customer satisfaction metrics"),
]
DEFAULT_BUSINESS_USE = "General data field"

# Descriptions of well-known table names.
TABLE_DESCRIPTIONS = {
    "customers": "Stores customer information including unique identifiers, contact details, and location data.",
    "orders": "Contains order transactions with status tracking, timestamps for purchase, approval, and delivery.",
    "order_items": "Individual items within each order, tracking product, seller, price, and shipping costs.",
    "products": "Product catalog with category classifications and physical dimensions.",
    "sellers": "Seller profiles with location information for marketplace vendors.",
    "payments": "Payment transactions linked to orders, tracking payment type, installments, and amounts.",
    "reviews": "Customer reviews and satisfaction scores for completed orders.",
    "geolocation": "Geographic coordinate mapping for Brazilian zip codes.",
    "product_categories": "Product taxonomy with English translations of category names.",
}

# Suggested queries of well-known table names.
TABLE_QUERIES = {
    "customers": "SELECT city, COUNT(*) as customer_count FROM customers GROUP BY city ORDER BY customer_count DESC LIMIT 10",
    "orders": "SELECT order_status, COUNT(*) FROM orders GROUP BY order_status",
    "order_items": "SELECT product_id, COUNT(*) as times_ordered, SUM(price) as total_revenue FROM order_items GROUP BY product_id ORDER BY total_revenue DESC LIMIT 10",
    "payments": "SELECT payment_type, COUNT(*), AVG(payment_value) FROM payments GROUP BY payment_type",
    "reviews": "SELECT review_score, COUNT(*) FROM reviews GROUP BY review_score ORDER BY review_score",
}

# Insight and quality-note wording; large-table threshold.
INSIGHT_RELATIONSHIPS = "**Relationships:** Connects to "
INSIGHT_TIME = "**Time-series:** Contains temporal data suitable for trend analysis"
INSIGHT_FINANCIAL = "**Financial:** Contains monetary values - ensure proper decimal handling"
INSIGHT_SCALE = "**Scale:** Large dataset ({rows} rows) - consider partitioning"
NOTE_NULLABLE = "{n} columns allow NULL values - check for missing data"
NOTE_NO_PK = "No primary key defined - verify data uniqueness"
NOTE_EMPTY = "Empty table - verify data load completed"
LARGE_TABLE_ROWS = 10000


def _contains_any(name: Column, frags: tuple[str, ...]) -> Column:
    cond = None
    for f in frags:
        c = name.contains(f)
        cond = c if cond is None else cond | c
    return cond


def _rule_chain(name: Column, rules, default: str, last: tuple[Column, str] | None = None) -> Column:
    expr = None
    for frags, text in rules:
        cond = _contains_any(name, frags)
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    if last is not None:
        expr = expr.when(last[0], last[1])
    return expr.otherwise(default)


def column_description(name: str | Column, is_pk: str | Column) -> Column:
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    pk = F.col(is_pk) if isinstance(is_pk, str) else is_pk
    return _rule_chain(n, DESCRIPTION_RULES, DEFAULT_DESCRIPTION, (F.coalesce(pk, F.lit(False)), PK_DESCRIPTION))


def business_use(name: str | Column) -> Column:
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    return _rule_chain(n, BUSINESS_USE_RULES, DEFAULT_BUSINESS_USE)


def document_columns(columns: DataFrame) -> DataFrame:
    """D1+D2: description and business use per column (``columns`` = catalog.columns_df)."""
    return columns.select("table_name", "ordinal_position", "column_name", "data_type", "nullable", "is_primary_key",
                          column_description("column_name", "is_primary_key").alias("description"),
                          business_use("column_name").alias("business_use"))


def _table_facts(columns: DataFrame, overview: DataFrame) -> DataFrame:
    lname = F.lower("column_name")
    facts = columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.count_if("nullable").alias("nullable_count"),
        F.max("is_primary_key").alias("has_pk"),
        F.max(lname.contains("timestamp") | lname.contains("date")).alias("has_time"),
        F.max(lname.contains("price") | lname.contains("value")).alias("has_money"))
    return facts.join(overview.select("table_name", "row_count"), "table_name")


def _thousands(c: str | Column) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def document_tables(columns: DataFrame, overview: DataFrame) -> DataFrame:
    """D5+D6: table description (known name, else a generated sentence) and
    suggested queries (known name, else sample + count)."""
    facts = _table_facts(columns, overview)
    known = F.create_map(*[x for k, v in TABLE_DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v))])
    queries = F.create_map(*[x for k, v in TABLE_QUERIES.items() for x in (F.lit(k), F.lit(v))])
    generated = F.format_string("Data table with %d columns and %s records.", F.col("column_count"),
                                _thousands("row_count"))
    default_q = F.concat(F.lit("SELECT * FROM "), F.col("table_name"), F.lit(" LIMIT 10\nSELECT COUNT(*) FROM "),
                         F.col("table_name"))
    return facts.select("table_name", "column_count", "row_count",
                        F.coalesce(known[F.col("table_name")], generated).alias("business_description"),
                        F.coalesce(queries[F.col("table_name")], default_q).alias("suggested_queries"))


# Wording of the generated documentation of a table without a model's text.
FALLBACK_SUMMARY = "This table contains {rows} records for {table}."
FALLBACK_RECOMMENDATIONS = ("Join with related tables using foreign keys", "Check data quality metrics before analysis")


def fallback_documentation(columns: DataFrame, overview: DataFrame) -> DataFrame:
    """D5 without a model: table_name, business_summary, column_descriptions (name to
    type, one entry a column) and usage_recommendations."""
    types = columns.groupBy("table_name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_name", "data_type")))).alias("column_descriptions"))
    head, tail = FALLBACK_SUMMARY.split("{rows}")
    middle, end = tail.split("{table}")
    summary = F.concat(F.lit(head), F.col("row_count").cast("string"), F.lit(middle), F.col("table_name"), F.lit(end))
    return types.join(overview.select("table_name", "row_count"), "table_name").select(
        "table_name", summary.alias("business_summary"), "column_descriptions",
        F.array(*map(F.lit, FALLBACK_RECOMMENDATIONS)).alias("usage_recommendations"))


def document_insights(columns: DataFrame, overview: DataFrame, edges: DataFrame) -> DataFrame:
    """D3: insights in long form (table_name, position, insight)."""
    facts = _table_facts(columns, overview)
    rel = edges.where(F.col("position") == 1).groupBy(F.col("source").alias("table_name")).agg(
        F.concat_ws(", ", F.array_sort(F.collect_list(F.struct("constraint_name", "position", "target")))
                    .getField("target")).alias("targets"))
    f = facts.join(rel, "table_name", "left")
    items = F.array(
        F.when(F.col("targets").isNotNull(), F.concat(F.lit(INSIGHT_RELATIONSHIPS), F.col("targets"))),
        F.when(F.col("has_time"), F.lit(INSIGHT_TIME)),
        F.when(F.col("has_money"), F.lit(INSIGHT_FINANCIAL)),
        F.when(F.col("row_count") > LARGE_TABLE_ROWS,
               F.concat(F.lit(INSIGHT_SCALE.split("{rows}")[0]), _thousands("row_count"),
                        F.lit(INSIGHT_SCALE.split("{rows}")[1]))),
    )
    return f.select("table_name", F.posexplode(items).alias("position", "insight")).where(
        F.col("insight").isNotNull())


def document_quality_notes(columns: DataFrame, overview: DataFrame) -> DataFrame:
    """Quality notes in long form (table_name, position, note)."""
    facts = _table_facts(columns, overview)
    nul = NOTE_NULLABLE.split("{n}")
    items = F.array(
        F.when(F.col("nullable_count") > 0, F.concat(F.lit(nul[0]), F.col("nullable_count").cast("string"),
                                                      F.lit(nul[1]))),
        F.when(~F.coalesce("has_pk", F.lit(False)), F.lit(NOTE_NO_PK)),
        F.when(F.col("row_count") == 0, F.lit(NOTE_EMPTY)),
    )
    return facts.select("table_name", F.posexplode(items).alias("position", "note")).where(F.col("note").isNotNull())


def data_dictionary(columns: DataFrame, quality: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns ⟕ column quality ⟕ descriptions, one row per (table, column).

    ``quality`` is ``quality_overview`` output (null_rate, distinct_count per column
    plus table row_count/completeness); ``docs`` is ``document_columns`` output.
    """
    q = quality.select("table_name", "column_name", "null_rate", "distinct_count")
    d = docs.select("table_name", "column_name", "description", "business_use")
    return (columns.join(q, ["table_name", "column_name"], "left").join(d, ["table_name", "column_name"], "left")
            .select("table_name", "ordinal_position", "column_name", "data_type", "nullable", "is_primary_key",
                    "is_foreign_key", "null_rate", "distinct_count", "description", "business_use"))


def _pct1(c: Column) -> Column:
    """x * 100 to 1 dp as text with a '%' sign."""
    return F.concat(round_half_up(c * 100, 1).cast("string"), F.lit("%"))


def table_digest(dictionary: DataFrame, tables_doc: DataFrame, table_quality: DataFrame, max_cols: int = 20) -> DataFrame:
    """Per table: summary, rows, completeness, the first ``max_cols`` column lines
    and the count of the rest ("... and n more columns")."""
    line = F.concat(F.lit("`"), F.col("column_name"), F.lit("` ("), F.col("data_type"), F.lit(")"),
                    F.when(F.col("is_primary_key"), F.lit(" [PK]")).otherwise(F.lit("")),
                    F.when(F.col("is_foreign_key"), F.lit(" [FK]")).otherwise(F.lit("")),
                    F.lit(": "), F.coalesce(F.col("description"), F.lit("")))
    per = dictionary.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal_position", line.alias("line")))).alias("__lines"))
    j = per.join(tables_doc.select("table_name", "business_description", "row_count"), "table_name") \
        .join(table_quality.select("table_name", "overall_completeness"), "table_name", "left")
    return j.select(
        "table_name", F.col("business_description").alias("summary"), "row_count",
        F.coalesce(_pct1(F.col("overall_completeness")), F.lit("N/A")).alias("completeness"),
        F.concat_ws("\n", F.slice(F.col("__lines").getField("line"), 1, max_cols)).alias("column_lines"),
        F.greatest(F.size("__lines") - max_cols, F.lit(0)).alias("more_columns"))


def stat_highlights(stats: DataFrame) -> DataFrame:
    """Columns that have a mean — min/max (text form), mean and std at 2 dp."""
    return stats.where(F.col("mean_value").isNotNull()).select(
        "column_name", "min_value", "max_value", round_half_up("mean_value", 2).alias("mean"),
        round_half_up("std_dev", 2).alias("std_dev"))

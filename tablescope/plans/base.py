"""Query registry plumbing and SQL text helpers for the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablescope.sources.tables import load_tables


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn

    return deco


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return load_tables(spark, sf_dir, names or ALL_TABLES)


# Column lists of the test tables (DuckDB type names), used to generate oracle SQL.
TABLE_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "INTEGER"), ("r_name", "VARCHAR")],
    "nation": [("n_nationkey", "INTEGER"), ("n_name", "VARCHAR"), ("n_regionkey", "INTEGER")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"),
                 ("c_acctbal", "DOUBLE"), ("c_mktsegment", "VARCHAR")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "VARCHAR"), ("s_nationkey", "INTEGER"), ("s_acctbal", "DOUBLE")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "VARCHAR"), ("p_brand", "VARCHAR"), ("p_type", "VARCHAR"),
             ("p_size", "INTEGER"), ("p_retailprice", "DOUBLE")],
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"),
               ("o_totalprice", "DOUBLE"), ("o_orderdate", "TIMESTAMP"), ("o_orderpriority", "VARCHAR")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"),
                 ("l_linenumber", "INTEGER"), ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"),
                 ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"), ("l_returnflag", "VARCHAR"),
                 ("l_linestatus", "VARCHAR"), ("l_shipdate", "TIMESTAMP")],
    "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP"), ("user_id", "BIGINT"), ("event_type", "VARCHAR"),
               ("value", "DOUBLE"), ("props", "VARCHAR")],
    "documents": [("doc_id", "BIGINT"), ("text", "VARCHAR"), ("lang", "VARCHAR"), ("source", "VARCHAR"),
                  ("n_chars", "BIGINT")],
    "embeddings": [("vec_id", "BIGINT"), ("embedding", "FLOAT[]"), ("label", "INTEGER")],
    "pages": [("page_id", "BIGINT"), ("url", "VARCHAR"), ("html", "VARCHAR")],
    "benchmark": [("item_id", "BIGINT"), ("text", "VARCHAR")],
    "labels": [("doc_id", "BIGINT"), ("quality", "INTEGER"), ("toxic", "INTEGER")],
    "conversations": [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"), ("text", "VARCHAR")],
}

#: The test tables, in the order of their columns above.
ALL_TABLES = list(TABLE_COLUMNS)

# DuckDB type name -> Spark SQL type name, for catalog oracles.
SPARK_TYPE = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double",
              "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}

DOC_LABEL_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
DOC_LABEL_SQL = ("(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                 "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def R(expr: str, k: int) -> str:
    """SQL twin of ``round_half_up``: floor(x * 10^k + 0.5) / 10^k on a double."""
    s = 10 ** k
    return f"(floor(CAST(({expr}) AS DOUBLE) * {s} + 0.5) / {s})"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def type_case(col: str = "data_type") -> str:
    """SQL CASE mapping DuckDB type names to Spark's."""
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SPARK_TYPE.items())
    return f"CASE {col} {whens} ELSE lower({col}) END"

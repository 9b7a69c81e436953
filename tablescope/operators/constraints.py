"""The declared-keys model.

Spark's session catalog stores no primary/foreign keys for parquet tables, so
keys are an explicit ``constraints`` frame supplied by the user and *validated*
by Spark jobs (pk_uniqueness, referential_integrity):

    table_name, kind ('pk'|'fk'|'unique'|'not_null'|'check'|'index'), name,
    position, column, ref_table, ref_column, expression

One row per (constraint, column); composite keys share ``name`` and are
ordered by ``position``. The frame is metadata (a few rows per table); reading it
on the driver to build query plans is plan construction, not data movement.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CONSTRAINT_DDL = (
    "table_name STRING, kind STRING, name STRING, position INT, column STRING, "
    "ref_table STRING, ref_column STRING, expression STRING"
)


@dataclass(frozen=True)
class ForeignKey:
    name: str
    table: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.columns, self.ref_columns))


def constraints_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CONSTRAINT_DDL)


def _rows(constraints: DataFrame) -> list:
    return sorted(constraints.collect(), key=lambda r: (r["table_name"], r["kind"], r["name"] or "", r["position"] or 0))


def primary_keys(constraints: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in _rows(constraints):
        if r["kind"] == "pk":
            out.setdefault(r["table_name"], []).append(r["column"])
    return out


def foreign_keys(constraints: DataFrame) -> list[ForeignKey]:
    groups: dict[tuple[str, str], list] = {}
    for r in _rows(constraints):
        if r["kind"] == "fk":
            groups.setdefault((r["table_name"], r["name"]), []).append(r)
    fks = []
    for (table, name), rs in sorted(groups.items()):
        fks.append(ForeignKey(name, table, tuple(r["column"] for r in rs), rs[0]["ref_table"],
                              tuple(r["ref_column"] for r in rs)))
    return fks

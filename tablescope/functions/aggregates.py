"""Wide single-row aggregates that stay inside whole-stage codegen.

Spark compiles an aggregate into generated code only while its buffer has at
most ``spark.sql.codegen.maxFields`` (100) fields; beyond that it falls back to
the interpreted path, measured 5-10x slower on a 600k-row table. Profiles over
wide tables therefore pack their per-column aggregates into chunks below that
budget. Chunks split *by column*, so each chunk's parquet scan reads only its
own columns and the total I/O stays one pass over the profiled columns.

Exact ``count(DISTINCT)`` is kept out of these chunks: mixing it with regular
aggregates makes Spark carry every regular buffer through the distinct rewrite
(rows x columns groups), measured ~8x slower than two separate aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_BUDGET = 96

# Aggregation-buffer fields per built-in aggregate.
FIELDS = {"count": 1, "count_if": 1, "min": 1, "max": 1, "sum": 1, "avg": 2, "stddev": 3, "variance": 3,
          "covar": 4, "corr": 6}


def pack(weights: Sequence[int], budget: int = FIELD_BUDGET) -> list[list[int]]:
    """Greedy packing of item indexes into chunks whose weight sum stays <= budget."""
    chunks: list[list[int]] = []
    cur: list[int] = []
    used = 0
    for i, w in enumerate(weights):
        if cur and used + w > budget:
            chunks.append(cur)
            cur, used = [], 0
        cur.append(i)
        used += w
    if cur or not chunks:
        chunks.append(cur)
    return chunks


def chunked_agg(df: DataFrame, groups: Sequence[Sequence[Column]], weights: Sequence[int],
                common: Sequence[Column] = (), budget: int = FIELD_BUDGET) -> list[tuple[list[int], DataFrame]]:
    """One single-row aggregate per chunk of ``groups``; ``common`` expressions
    (e.g. the row count) are added to every chunk. Returns (group indexes, frame)."""
    extra = sum(1 for _ in common)
    out = []
    for idx in pack(weights, budget - extra):
        exprs = [e for i in idx for e in groups[i]]
        out.append((idx, df.agg(*common, *exprs)))
    return out


def chunked_agg_sql(df: DataFrame, groups: Sequence[Sequence[str]], weights: Sequence[int],
                    common: Sequence[str] = (), budget: int = FIELD_BUDGET) -> list[tuple[list[int], DataFrame]]:
    """``chunked_agg`` with aggregates given as SQL expression strings: one
    ``selectExpr`` per chunk, so building the plan of a wide table costs one call per
    chunk instead of several per column and metric."""
    out = []
    for idx in pack(weights, budget - len(common)):
        exprs = [e for i in idx for e in groups[i]]
        out.append((idx, df.selectExpr(*common, *exprs)))
    return out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def literal_rows(rows: Sequence[Column]) -> Column:
    """``inline(array(struct...))``: turn one wide row into several long rows."""
    return F.inline(F.array(*rows))


def long_rows_sql(structs: Sequence[str]) -> str:
    """SQL twin of ``literal_rows`` over ``named_struct(...)`` strings."""
    return "inline(array(" + ", ".join(structs) + "))"

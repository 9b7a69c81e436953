"""Q10/Q11: Pearson correlation matrix in one scan, and the notable pairs.

The k x k cross-products of a batch are one matrix product, so the table is read once as
Arrow batches (``mapInArrow``): built-in aggregates would need either a buffer field or
a row copy for each of the k(k-1)/2 pairs. A task keeps k x k sums, centred on its first
batch's means, and emits one row a pair; tasks are merged pairwise in SQL with the
parallel variance formulas, which lose no digits to large means.

Nulls are pairwise: each coefficient uses the rows where both columns are non-null,
like SQL ``corr``. An undefined coefficient (constant column, fewer than two rows)
becomes 0; NaN or infinity in a pair's rows gives NaN. ``ml.stat.Correlation`` is not
used: it deletes rows listwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import numeric_columns, round_half_up, sql_ident

STRONG = 0.7
MODERATE = 0.5


#: Tasks whose rows of one pair are merged first, so no list grows with the table.
MERGE = 1000
_MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy", "odd")


def _task_moments(k: int):
    """mapInArrow: for each pair i < j the count, means and centred co-moments of the rows
    of this task where both are present; ``odd`` counts those with NaN or infinity."""
    upper = np.triu_indices(k, 1)

    def run(batches):
        from pyspark import TaskContext

        shift, sums = None, [np.zeros((k, k)) for _ in range(5)]
        for batch in batches:
            present = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            odd = ~np.isfinite(x)
            x = np.where(odd, 0.0, x)
            if shift is None:
                shift = (x * present).sum(axis=0) / np.maximum(present.sum(axis=0), 1)
            x = (x - shift) * present
            odd = odd * present
            for total, part in zip(sums, (present.T @ present, x.T @ present, (x * x).T @ present, x.T @ x, odd.T @ present)):
                total += part
        if shift is None:
            return
        n, s, q, p, odd = sums
        size = np.maximum(n, 1)
        mx, my = s / size, s.T / size
        cols = (n, shift[:, None] + mx, shift[None, :] + my, q - s * mx, q.T - s.T * my, p - s * my, odd + odd.T)
        task = np.full(len(upper[0]), TaskContext.get().partitionId() // MERGE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(np.int32)) for v in (task, *upper)] + [pa.array(np.ascontiguousarray(c[upper])) for c in cols],
            ["task", "i", "j", *_MOMENTS])

    return run


def _merged(parts: Column) -> Column:
    """One struct of moments from an array of them."""
    zero = F.struct(*[F.lit(0.0).alias(m) for m in _MOMENTS])

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        cross = a["n"] * share
        return F.struct(
            n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
            (a["cxx"] + b["cxx"] + dx * dx * cross).alias("cxx"), (a["cyy"] + b["cyy"] + dy * dy * cross).alias("cyy"),
            (a["cxy"] + b["cxy"] + dx * dy * cross).alias("cxy"), (a["odd"] + b["odd"]).alias("odd"))

    return F.aggregate(F.filter(parts, lambda b: b["n"] > 0), zero, add)


def correlation_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Upper-triangle pairs (i < j): column_1, column_2, i, j, r (raw, undefined -> 0)."""
    cols = columns or numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("need at least 2 numeric columns for correlation")
    values = df.select(*[F.col(sql_ident(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    schema = "task int, i int, j int, " + ", ".join(f"{m} double" for m in _MOMENTS)
    parts = values.mapInArrow(_task_moments(len(cols)), schema)
    for keys in (("task", "i", "j"), ("i", "j")):
        parts = parts.groupBy(*keys).agg(_merged(F.collect_list(F.struct(*_MOMENTS))).alias("m")).select(*keys, "m.*")
    # the square roots are taken one by one: the product of two small variances underflows
    r = F.try_divide(F.col("cxy"), F.sqrt(F.greatest("cxx", F.lit(0.0))) * F.sqrt(F.greatest("cyy", F.lit(0.0))))
    r = F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(F.coalesce(r, F.lit(0.0)))
    pairs = df.sparkSession.createDataFrame(
        [(cols[i], cols[j], i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))],
        "column_1 STRING, column_2 STRING, i INT, j INT")
    # one row a pair on both sides; a table without rows gives no moments
    return pairs.join(parts.select("i", "j", r.alias("r")), ["i", "j"], "left").select(
        "column_1", "column_2", "i", "j", F.coalesce("r", F.lit(0.0)).alias("r"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Full k x k matrix in long form (column_1, column_2, correlation; 4 dp),
    mirrored, with a unit diagonal."""
    cols = columns or numeric_columns(df)
    upper = correlation_long(df, cols)
    r = round_half_up("r", 4)
    upper_rows = upper.select("column_1", "column_2", r.alias("correlation"))
    mirror = upper.select(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"),
                          r.alias("correlation"))
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols],
                                           "column_1 STRING, column_2 STRING, correlation DOUBLE")
    return upper_rows.unionByName(mirror).unionByName(diag)


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, strong: float = STRONG,
                      moderate: float = MODERATE) -> DataFrame:
    """Pairs with |r| > moderate, labelled strong/moderate positive/negative,
    sorted by |r| descending (thresholds applied to the unrounded r)."""
    upper = correlation_long(df, columns)
    r = F.col("r")
    strength = (F.when(F.abs(r) > strong, F.when(r > strong, "strong positive").otherwise("strong negative"))
                .when(F.abs(r) > moderate, F.when(r > moderate, "moderate positive").otherwise("moderate negative")))
    return (upper.where(F.abs(r) > moderate)
            .select("column_1", "column_2", round_half_up(r, 4).alias("correlation"), strength.alias("strength"),
                    F.abs(r).alias("__abs"))
            .orderBy(F.col("__abs").desc(), "column_1", "column_2").drop("__abs"))

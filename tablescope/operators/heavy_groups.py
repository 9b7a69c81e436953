"""K6, K11, K12 on keys of high cardinality: the exact top groups without grouping all keys.

A full group-by shuffles every distinct key to find ten of them. Here a summary of fixed size
proposes and an exact pass decides:

1. Every key falls into one of ``slots`` slots in each of ROWS independent hash rows. A slot's
   sum (rows, or the positive amounts) is an upper bound of each of its keys. Slots are summed
   map-side and merge by addition, so a task sends at most ROWS x ``slots`` rows.
2. The keys in the largest slots are grouped exactly. Their n-th best value is a floor: the
   n-th best of all keys is no less.
3. Keys with a slot below the floor in any row cannot be among the first n. If the slots of
   step 2 leave no other, their result is the answer; else all keys that remain are grouped.

The answer equals the full group-by whatever the keys; only the work depends on them. Where a
few keys stand out, few are shuffled; where all are alike, no bound can tell them apart and
step 3 is the full group-by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import money, round_half_up, sql_ident
from tablescope.session import materialize

ROWS, SLOTS = 3, 1 << 14


def _keyed(df: DataFrame, by: list[str], measure: str | Column | None, slots: int) -> DataFrame:
    """k0.. (the key), __m (the amount) and __s0.. (its slot in each row)."""
    key = [F.col(sql_ident(c)).alias(f"k{i}") for i, c in enumerate(by)]
    amount = [] if measure is None else [money(measure, df).alias("__m")]
    return df.select(*key, *amount).select("*", *[
        F.pmod(F.xxhash64(F.lit(r), *[f"k{i}" for i in range(len(by))]), F.lit(slots)).cast("int").alias(f"__s{r}") for r in range(ROWS)])


def slot_bounds(keyed: DataFrame, measured: bool) -> DataFrame:
    """(row, slot, bound): what no key of the slot exceeds; at most ROWS x slots rows."""
    weight = F.greatest(F.col("__m"), F.lit(0)) if measured else F.lit(1)
    each = keyed.select(weight.alias("weight"), F.posexplode(F.array(*[f"__s{r}" for r in range(ROWS)])).alias("row", "slot"))
    return each.groupBy("row", "slot").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("bound"))


def _best(keyed: DataFrame, n: int, width: int, measured: bool) -> DataFrame:
    key = [f"k{i}" for i in range(width)]
    aggs = [F.count(F.lit(1)).alias("row_count"), *([F.sum("__m").alias("__v")] if measured else [])]
    g = keyed.groupBy(*key).agg(*aggs)
    return (g if measured else g.withColumn("__v", F.col("row_count"))).orderBy(F.col("__v").desc(), *key).limit(n)


def above(keyed: DataFrame, bounds: DataFrame, floor) -> DataFrame:
    """The rows whose key's slots all reach ``floor``."""
    for r in range(ROWS):
        kept = bounds.where((F.col("row") == r) & (F.col("bound") >= F.lit(floor))).select(F.col("slot").alias(f"__s{r}"))
        keyed = keyed.join(F.broadcast(kept), f"__s{r}", "left_semi")  # at most SLOTS numbers
    return keyed


def heavy_groups(df: DataFrame, by: list[str], n: int = 10, measure: str | Column | None = None, slots: int = SLOTS) -> DataFrame:
    """The first ``n`` groups of ``df`` by rows, or by the sum of ``measure`` (money: NaN and
    infinity count as null): ``by``, row_count and, with a measure, total (2 dp). Ties go by
    key; a null key is a group; groups without an amount come last. Runs jobs while it is
    built: one pass for the summary, one or two over the keys that remain; no rows give none."""
    measured, width = measure is not None, len(by)
    keyed = _keyed(df, by, measure, slots)
    bounds = materialize(slot_bounds(keyed, measured))
    top = [r["slot"] for r in bounds.where("row = 0").orderBy(F.col("bound").desc(), "slot").limit(4 * n).collect()]
    best = materialize(_best(keyed.where(F.col("__s0").isin(top)), n, width, measured))
    found = sorted((r["__v"] for r in best.select("__v").collect() if r["__v"] is not None), reverse=True)
    floor = found[n - 1] if len(found) >= n else None
    rest = bounds.where((F.col("row") == 0) & ~F.col("slot").isin(top))
    if not rest.where(F.lit(floor is None) | (F.col("bound") >= F.lit(floor))).isEmpty():
        # below zero no bound says anything: sums of positive amounts are never negative
        best = _best(keyed if floor is None or floor < 0 else above(keyed, bounds, floor), n, width, measured)
    total = [round_half_up(F.col("__v").cast("double"), 2).alias("total")] if measured else []
    return best.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], "row_count", *total)

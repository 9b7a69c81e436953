"""Exact PERCENTILE_CONT without gathering a whole column into one task.

Spark's exact ``percentile`` aggregate merges a value -> count map of the whole
column in a single task, which is bounded only by the column's distinct values.
This version selects the exact order statistics in two scans:

1. A ``percentile_approx`` sketch (bounded memory) gives a bracket around each target rank.
   The sketch's rank error is at most n / accuracy, brackets are four times as wide and, for
   small tables, at least two rows wider, so each holds its ranks.
2. One aggregate per (segment, step, value): the brackets' ends cut the number line into
   segments, a segment inside a bracket into GRID steps. Values inside a bracket are counted
   one by one, all others only by segment. From the counts of the steps (a frame bounded by
   brackets x GRID) follows the step that each rank lies in, and a running sum over the values
   of these steps alone gives the value. A hot value is one row a task; about
   10 n / (accuracy * GRID) values are left for an ordered step.

The counts are exact and tell whether a rank was inside its bracket; if it were not, an error
would be raised, so no percentile is silently wrong. Every step enters the next as a scalar
subquery: the result is lazy, the plan is the same at every size, and no job runs while it is
built.

NaN is a value and larger than any other, as everywhere in Spark; -0.0 is 0.0; infinities are
ordinary values. Nulls are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 1000


def _values(df: DataFrame, column: str | Column) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.where(c.isNotNull()).select((c.cast("double") + F.lit(0.0)).alias("__v"))


def _widths(accuracy: int) -> list[float]:
    """Half-widths of brackets, as shares of all rows; the last takes in everything."""
    out = [5.0 / accuracy]
    while out[-1] < 1.0:
        out.append(4.0 / accuracy + 4.0 ** len(out) / accuracy)
    return [*out[:-1], 1.0]


def interpolated(low: str, high: str, share: str) -> str:
    """SQL for the value at ``share`` of the way; with infinities (and spans beyond a double)
    as a weighted sum, which is what their limit is."""
    return (f"CASE WHEN {share} = 0 OR {low} = {high} THEN {low} WHEN abs({high} - {low}) < double('Infinity') "
            f"THEN {low} + {share} * ({high} - {low}) ELSE (1 - {share}) * {low} + {share} * {high} END")


def exact_percentiles(df: DataFrame, column: str | Column, probs: Sequence[float],
                      accuracy: int = 100_000) -> Column:
    """Array scalar with PERCENTILE_CONT(p) of ``column`` for each p (nulls when empty).

    Interpolation follows the SQL definition: position = p * (n - 1); the result
    is ``lo + (position - floor(position)) * (hi - lo)`` between the values at the
    neighbouring ranks. Expressions are SQL strings: a call to the driver's JVM each would
    take longer than the jobs of a small table.
    """
    v = _values(df, column)
    k = len(probs)
    both = [(side, i) for side in (0, 1) for i in range(k)]
    name = [("lo", "hi")[side] + str(i) for side, i in both]

    widths = _widths(accuracy)
    at = [max(0.0, min(1.0, probs[i] + (-1, 1)[side] * w)) for side, i in both for w in widths]
    grid = ", ".join(f"{p!r}D" for p in at)
    sketch = v.selectExpr("count(1) AS n", f"percentile_approx(nanvl(__v, double('Infinity')), array({grid}), {accuracy}) AS a")
    # the first width that is two rows wider than the sketch's error at least
    width = "CASE " + " ".join(f"WHEN n * {w - 4.0 / accuracy!r}D >= 2 THEN {j}" for j, w in enumerate(widths[:-1])) + f" ELSE {len(widths) - 1} END"
    brackets = sketch.selectExpr("n", "a", f"{width} AS w").selectExpr("n", *[f"get(a, {j * len(widths)} + w) AS {c}" for j, c in enumerate(name)])
    brackets = brackets.selectExpr(f"struct(*, array_sort(array({', '.join(name)})) AS ends) AS s")

    # every value's place: its segment, and within a bracket the step
    d = v.select("__v", brackets.scalar().alias("s"))
    inside = " OR ".join(["isnan(__v)", *(f"(__v >= s.lo{i} AND __v <= s.hi{i})" for i in range(k))])
    above = " + ".join(f"CASE WHEN __v > get(s.ends, {j}) THEN 1 ELSE 0 END" for j in range(2 * k))
    d = d.selectExpr("__v", "s.ends AS ends", f"{above} AS segment", f"({inside}) AS inside")
    d = d.selectExpr("__v", "segment", "inside", "get(ends, segment - 1) AS low", "get(ends, segment) AS high")
    step = (f"CASE WHEN __v = high THEN {GRID} WHEN inside AND high > low AND high - low < double('Infinity') "
            f"THEN least(floor((__v - low) / (high - low) * {GRID}), {GRID - 1}) ELSE 0 END")
    counts = d.selectExpr("segment", f"CAST({step} AS INT) AS step", "CASE WHEN inside THEN __v END AS v").groupBy("segment", "step", "v").agg(F.expr("count(1) AS c"))

    # the step that each rank lies in: one row a step, so the windows are bounded
    steps = counts.groupBy("segment", "step").agg(F.expr("sum(c) AS c")).selectExpr(
        "segment", "step", "c", "sum(c) OVER () AS n",
        "coalesce(sum(c) OVER (ORDER BY segment, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    position = [f"{float(p)!r}D * (n - 1)" for p in probs]
    rank = [f"{('floor', 'ceil')[side]}({position[i]})" for side, i in both]
    target = steps.groupBy().agg(F.expr("max(n) AS n"), *[
        F.expr(f"min(CASE WHEN before + c > {r} THEN struct(segment, step, {r} - before AS rank) END) AS {c}") for c, r in zip(name, rank)])
    target = target.selectExpr("struct(*) AS t").scalar()

    # the values of these steps alone, in order; a condition on the count as well stays above
    # the aggregate: pushed below it, the places of all rows would be worked out once more
    here = [f"(segment = t.{c}.segment AND step = t.{c}.step)" for c in name]
    few = counts.select("*", target.alias("t")).where(f"CASE WHEN c > 0 THEN {' OR '.join(here)} END")
    few = few.selectExpr("*", "sum(c) OVER (PARTITION BY segment, step ORDER BY v) AS upto")
    ends = few.groupBy().agg(F.expr("first(t.n) AS n"), *[F.expr(f"min(CASE WHEN {h} AND upto > t.{c}.rank THEN v END) AS {c}") for c, h in zip(name, here)])
    values = [
        f"CASE WHEN n IS NULL THEN NULL WHEN lo{i} IS NOT NULL AND hi{i} IS NOT NULL THEN "
        f"{interpolated(f'lo{i}', f'hi{i}', f'({position[i]} - floor({position[i]}))')} "
        f"ELSE CAST(raise_error('percentile: a rank is outside its sketched bracket') AS DOUBLE) END" for i in range(k)]
    return ends.selectExpr(f"array({', '.join(values)}) AS p").scalar()


def percentile_array(df: DataFrame, column: str | Column, probs: Sequence[float], method: str = "exact",
                     accuracy: int = 10000) -> Column:
    """PERCENTILE_CONT(p) for each p as one array scalar.

    ``method``: ``"exact"`` — ``exact_percentiles`` above; ``"map"`` — Spark's exact
    ``percentile`` (value -> count map merged in one task: for columns known to hold few
    distinct values); ``"approx"`` — ``percentile_approx`` sketch (bounded memory, rank
    error n/accuracy). The caller chooses; nothing is measured.
    """
    v = _values(df, column)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if method == "approx":
        return v.agg(F.percentile_approx("__v", arr, accuracy)).scalar()
    if method == "map":
        return v.agg(F.percentile("__v", arr)).scalar()
    if method == "exact":
        return exact_percentiles(df, column, probs, max(accuracy, 100_000))
    raise ValueError(f"unknown percentile method {method!r}")

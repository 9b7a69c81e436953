"""Column-expression helpers shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    IntegralType,
    MapType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
    VariantType,
)

# Beyond this magnitude ``x * 10^k`` no longer fits a long; fall back to round().
_FLOOR_SAFE = 1e15


_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def col_of(c: str | Column) -> Column:
    """A column from a name, a SQL expression string (``"price * tax"``) or a Column."""
    if isinstance(c, str):
        return F.col(c) if _IDENT.fullmatch(c) else F.expr(c)
    return c


def round_half_up(c: str | Column, digits: int) -> Column:
    """Round a double to ``digits`` places as ``floor(x * 10^k + 0.5) / 10^k``.

    Spark's ``round`` rounds the decimal text and DuckDB's scales the binary value,
    so ties (1.005, 0.285) come out differently; this form is identical on both
    engines and independent of either one's tie rule.
    """
    x = col_of(c).cast("double")
    scale = float(10 ** digits)
    # null propagates through both branches (abs(null) < lim is null -> otherwise)
    return F.when(F.abs(x) < F.lit(_FLOOR_SAFE / scale), F.floor(x * scale + 0.5) / scale).otherwise(
        F.round(x, digits))


def rate_units(c: str | Column, digits: int = 4) -> Column:
    """``floor(x * 10^k + 0.5)`` as bigint: a rate rounded to k places, in units.

    Sums of units are exact in any order, so an average of rounded rates (table
    completeness) does not depend on how rows reach the aggregate.
    """
    return F.floor(col_of(c).cast("double") * float(10 ** digits) + 0.5).cast("bigint")


def completeness(sum_units: str | Column, n_columns: int, digits: int = 4) -> Column:
    """round(1 - mean(rounded null rates), k) from the summed rate units."""
    scale = float(10 ** digits)
    return round_half_up(F.lit(1.0) - (col_of(sum_units).cast("double") / scale) / F.lit(float(n_columns)), digits)


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double, null (not an error) when den is 0 or null."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def money(c: str | Column, df: DataFrame | None = None) -> Column:
    """Money value as a decimal, so sums are exact and order-independent.

    A decimal of ``df`` keeps its own type. Anything else becomes DECIMAL(38,10): ten
    places after the point and values up to 1e28. NaN and infinity are no money and
    count as null.
    """
    x = col_of(c)
    if df is not None and isinstance(df.select(x).schema[0].dataType, DecimalType):
        return x
    return x.try_cast("decimal(38,10)")


def measure_sum(c: str | Column, df: DataFrame) -> Column:
    """Sum of any measure as double: decimals and whole numbers are summed exactly in
    their own kind, floating-point values as doubles (NaN and infinity carry through)."""
    x = col_of(c)
    dt = df.select(x).schema[0].dataType
    if isinstance(dt, IntegralType):
        x = x.cast("decimal(38,0)")
    elif not isinstance(dt, DecimalType):
        x = x.cast("double")
    return F.sum(x).cast("double")


def is_numeric_type(dt: DataType) -> bool:
    return isinstance(dt, NumericType)


def is_temporal_type(dt: DataType) -> bool:
    return isinstance(dt, (DateType, TimestampType, TimestampNTZType))


def is_string_type(dt: DataType) -> bool:
    return isinstance(dt, StringType)


def is_orderable(dt: DataType) -> bool:
    """Map and variant values cannot be sorted in Spark; everything else can."""
    if isinstance(dt, (MapType, VariantType)):
        return False
    if isinstance(dt, ArrayType):
        return is_orderable(dt.elementType)
    if isinstance(dt, StructType):
        return all(is_orderable(f.dataType) for f in dt.fields)
    return True


def is_boolean_type(dt: DataType) -> bool:
    return isinstance(dt, BooleanType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in skip]


def age_days(ts: str | Column, as_of: str | Column, dtype: DataType) -> Column:
    """Days between ``ts`` and ``as_of`` with microsecond precision.

    ``timestamp_diff(SECOND)`` truncates fractions, so the difference is taken in
    microseconds and divided by 86,400,000,000.
    """
    t = col_of(ts)
    a = col_of(as_of) if isinstance(as_of, Column) else F.lit(as_of)
    if isinstance(dtype, TimestampType):
        t, a = t.cast("timestamp"), a.cast("timestamp")
    else:
        t, a = t.cast("timestamp_ntz"), a.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", t, a).cast("double") / F.lit(86_400_000_000.0)


def type_name(dt: DataType) -> str:
    """Spark's SQL name for a type (``bigint``, ``decimal(10,2)``, ``array<float>``)."""
    return dt.simpleString()


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row of ``df`` without a join.

    Each value enters as a scalar subquery (``DataFrame.scalar()``): Spark runs the
    one-row plan once (merging subqueries over the same plan) and inlines the
    results as literals, so nothing is joined or broadcast per row.
    """
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def money_avg(c: str | Column, df: DataFrame | None = None) -> Column:
    """Average of a money column as ``sum(decimal) / count``: exact and independent of
    the order rows are summed in (a double ``avg`` is not)."""
    x = money(c, df)
    return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))


def avg_days(start: str | Column, end: str | Column, dtype: DataType | None = None) -> Column:
    """Average of ``end - start`` in days from the exact sum of microseconds."""
    a, b = col_of(start), col_of(end)
    if isinstance(dtype, TimestampType):
        a, b = a.cast("timestamp"), b.cast("timestamp")
    else:
        a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", a, b)
    return F.try_divide(micros_sum(micros).cast("double"), F.count(micros).cast("double")) / F.lit(86_400_000_000.0)


def micros_sum(micros: str | Column) -> Column:
    """Exact sum of microseconds as a decimal: 150,000 spans of two years are more than a
    bigint holds."""
    return F.sum(col_of(micros).cast("decimal(20,0)"))


def sql_ident(name: str) -> str:
    """A column name quoted for a SQL expression string."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: str) -> str:
    """A string literal for a SQL expression string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_round_half_up(expr: str, digits: int) -> str:
    """SQL-string twin of ``round_half_up`` (same expression, for ``selectExpr``)."""
    x = f"CAST(({expr}) AS DOUBLE)"
    scale = float(10 ** digits)
    return (f"CASE WHEN abs({x}) < {_FLOOR_SAFE / scale!r}D THEN floor({x} * {scale!r}D + 0.5D) / {scale!r}D "
            f"ELSE round({x}, {digits}) END")


def sql_ratio(num: str, den: str) -> str:
    """SQL-string twin of ``ratio``."""
    return f"try_divide(CAST(({num}) AS DOUBLE), CAST(({den}) AS DOUBLE))"

"""JSON payload columns parsed with a declared schema (no inference pass). S9: frames made
serialisable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, DateType, DecimalType, FractionalType, IntegralType, MapType, NullType,
                               StringType, StructType, TimestampNTZType, TimestampType)

from tablescope.functions.exprs import sql_ident


def parse_payload(df: DataFrame, column: str, schema: str, prefix: str = "") -> DataFrame:
    """Expand a JSON text column into typed columns with ``from_json``.

    ``schema`` is a DDL string such as ``"action STRING, value DOUBLE, source STRING"``.
    Malformed payloads become nulls (PERMISSIVE), so a bad row never fails the job.
    """
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    tmp = f"__{column}_parsed"
    out = df.withColumn(tmp, parsed)
    fields = out.schema[tmp].dataType.fieldNames()
    return out.select(*[c for c in df.columns], *[F.col(f"{tmp}.{f}").alias(prefix + f) for f in fields])


def payload_field(column: str | Column, path: str) -> Column:
    """One field by JSON path, without parsing the whole document into a struct."""
    c = F.col(column) if isinstance(column, str) else column
    return F.get_json_object(c, path)


def serialisable(df: DataFrame) -> DataFrame:
    """``df`` with every value in a form that JSON has. Numbers, booleans and text stay;
    dates and timestamps become ISO 8601 text (``2024-05-01``, ``2024-05-01T10:00:00``, with six
    places where there are parts of a second; the session's time zone, not shown); decimals,
    intervals and all else become text. Arrays, structs and maps are gone through; map keys are
    text. Nulls stay null. NaN and infinite numbers, which JSON
    lacks, become null."""
    return df.select(*[_serialised(F.col(sql_ident(f.name)), f.dataType).alias(f.name) for f in df.schema])


def _serialised(c: Column, t: DataType) -> Column:
    if isinstance(t, (IntegralType, BooleanType, StringType, NullType)):
        return c
    if isinstance(t, FractionalType) and not isinstance(t, DecimalType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(t, DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, (TimestampType, TimestampNTZType)):
        parts = F.date_format(c, ".SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(parts == ".000000", "").otherwise(parts))
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _serialised(x, t.elementType))
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[_serialised(c.getField(f.name), f.dataType).alias(f.name) for f in t]))
    if isinstance(t, MapType):
        return F.map_from_arrays(F.transform(F.map_keys(c), lambda k: _serialised(k, t.keyType).cast("string")),
                                 F.transform(F.map_values(c), lambda v: _serialised(v, t.valueType)))
    return c.cast("string")

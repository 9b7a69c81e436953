"""Q4: freshness of a timestamp column against an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import age_days


def freshness(df: DataFrame, column: str, as_of: str, table_name: str | None = None) -> DataFrame:
    """latest_record, oldest_record and age_days = (as_of - latest) in days.

    ``as_of`` is required (the reference reads the wall clock, which makes the
    result untestable). One aggregate; the parquet scan reads only ``column``.
    """
    dtype = df.schema[column].dataType
    agg = df.agg(F.max(column).alias("latest_record"), F.min(column).alias("oldest_record"))
    return agg.select(
        F.lit(table_name).cast("string").alias("table_name"),
        F.lit(column).alias("timestamp_column"),
        "latest_record",
        "oldest_record",
        age_days(F.col("latest_record"), as_of, dtype).alias("age_days"),
    )

"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import shared_dir

#: Word separators of every operator: space and the control characters tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]"
MAX_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and
    survives lost executors (the files do not live on them)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS + "+"), "")


def removed(text: Column, chars: str) -> Column:
    """``text`` without the characters of a regular expression's class."""
    return F.regexp_replace(text, chars + "+", "")

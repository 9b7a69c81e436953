"""Structured Streaming quality monitor (the SURVEY 7.5 extension).

Each micro-batch of a stream is checked with the batch operators (null counts
and freshness) and the verdicts are appended to a parquet check log. The writer
overwrites only the partition of its own ``batch_id`` (dynamic partition
overwrite), so a batch re-run after a failure replaces its rows instead of
duplicating them; the stream's progress lives in a checkpoint under the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.exprs import age_days
from tablescope.operators.profile import column_profile
from tablescope.operators.report import FRESH_PASS_DAYS, FRESH_WARN_DAYS, NULL_PCT_BAD
from tablescope.session import checkpoint_dir


def batch_checks(batch: DataFrame, batch_id: int, table_name: str, ts_column: str, as_of: str | None = None) -> DataFrame:
    """dq_check_log rows for one micro-batch: a null_check and a freshness_check.

    ``as_of`` defaults to the batch's processing time (``current_timestamp``).
    """
    prof = column_profile(batch, metrics=("nulls",))
    nulls = prof.agg(F.count_if(F.col("null_count") > 0).alias("issues"),
                     F.max(F.col("null_count") * 100.0 / F.greatest(F.col("total_rows"), F.lit(1))).alias("max_pct"),
                     F.max("total_rows").alias("rows"))
    null_row = nulls.select(
        F.lit("null_check").alias("check_type"),
        F.when(F.col("issues") == 0, "pass").when(F.col("max_pct") <= NULL_PCT_BAD, "warning").otherwise("fail")
        .alias("check_result"), F.col("issues").cast("bigint").alias("issues"), "rows")
    dtype = batch.schema[ts_column].dataType
    ref = F.lit(as_of) if as_of else F.current_timestamp().cast("timestamp_ntz")
    fresh = batch.agg(F.max(ts_column).alias("latest"), F.count(F.lit(1)).alias("rows"))
    age = age_days(F.col("latest"), ref, dtype)
    fresh_row = fresh.select(
        F.lit("freshness_check").alias("check_type"),
        F.when(age <= FRESH_PASS_DAYS, "pass").when(age <= FRESH_WARN_DAYS, "warning").otherwise("fail")
        .alias("check_result"), F.floor(F.greatest(age, F.lit(0.0))).cast("bigint").alias("issues"), "rows")
    out = null_row.unionByName(fresh_row)
    return out.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(table_name).alias("table_name"), "check_type",
        "check_result", "issues", "rows",
        F.concat(F.lit('{"table":"'), F.lit(table_name), F.lit('","check":"'), F.col("check_type"),
                 F.lit('","issues":'), F.col("issues").cast("string"), F.lit("}")).alias("details"),
        F.current_timestamp().alias("checked_at"))


def start_quality_monitor(stream: DataFrame, table_name: str, ts_column: str, sink_path: str,
                          as_of: str | None = None, checkpoint_location: str | None = None,
                          available_now: bool = False, processing_time: str = "1 minute"):
    """Start a streaming query that appends ``batch_checks`` rows to ``sink_path``.

    ``stream`` is any streaming DataFrame (``spark.readStream...``). The checkpoint
    defaults to ``<spark.checkpoint.dir>/dq_monitor/<table_name>``.
    """
    spark: SparkSession = stream.sparkSession
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark), "dq_monitor", table_name)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch_checks(batch, batch_id, table_name, ts_column, as_of)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()

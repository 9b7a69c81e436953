"""Quality monitor over a file stream, run to completion with an available-now trigger."""

import os
import tempfile

from pyspark.sql import functions as F


def test_quality_monitor_appends_idempotently(spark):
    from tablescope.streaming import start_quality_monitor

    data = "/root/testdata/sf0.001/events.parquet"
    src = tempfile.mkdtemp(prefix="dq-src-")
    os.symlink(data, os.path.join(src, "part-00000.parquet"))
    schema = spark.read.parquet(data).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = tempfile.mkdtemp(prefix="dq-sink-")
    ckpt = tempfile.mkdtemp(prefix="dq-ckpt-")
    q = start_quality_monitor(stream, "events", "ts", sink, as_of="2024-02-01 00:00:00",
                              checkpoint_location=ckpt, available_now=True)
    q.awaitTermination(300)
    log = spark.read.parquet(sink)
    rows = {r.check_type: r for r in log.collect()}
    assert set(rows) == {"null_check", "freshness_check"}
    assert rows["null_check"].check_result == "pass" and rows["null_check"].rows == 1000
    assert rows["freshness_check"].issues == 1 and rows["freshness_check"].check_result == "warning"
    # a restart from the same checkpoint processes nothing new and adds no rows
    q2 = start_quality_monitor(spark.readStream.schema(schema).parquet(src), "events", "ts", sink,
                               as_of="2024-02-01 00:00:00", checkpoint_location=ckpt, available_now=True)
    q2.awaitTermination(300)
    assert spark.read.parquet(sink).count() == 2
    assert log.where(F.col("details").startswith('{"table":"events"')).count() == 2

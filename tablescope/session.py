"""Session helpers: local sessions for tests/bench, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(app: str = "tablescope", cpus: int | str = "*", shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    """Return (or build) a session tuned for local runs.

    On a cluster the session is created by the platform; this helper only sets
    what a local run needs: AQE (coalesce + skew join), UI off, UTC.
    """
    parts = shuffle_partitions or (2 * (os.cpu_count() or 8) if cpus == "*" else 2 * int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A fallback is only set when the session has none (local tests); on a cluster
    the platform's shared folder is always used.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or fallback
    if not current:
        raise RuntimeError("spark.checkpoint.dir is not set; pass a shared fallback folder")
    if not sc.getCheckpointDir():  # the setting itself is static: only the context can still be told
        sc.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local session that
    names none gets a temporary one; elsewhere a missing folder is an error, since a
    machine's own folder would be lost to the others."""
    sc = spark.sparkContext
    local = sc.master == "local" or sc.master.startswith("local[")
    unset = not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir())
    return checkpoint_dir(spark, fallback="file://" + tempfile.mkdtemp(prefix="tablescope-") if local and unset else None).rstrip("/")


def materialize(df):
    """Write a (small, shared) intermediate result to the cluster's checkpoint folder
    and continue from it, cutting the lineage.

    Uses reliable ``checkpoint()`` into ``spark.checkpoint.dir`` (shared storage, so it
    survives lost executors) — never ``localCheckpoint``. Meant for intermediates that
    several outputs reuse, e.g. the per-column quality of a dictionary export. The folder
    is that of ``shared_dir``, so a query never has two very different costs.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when the query ends, instead of when the driver
    happens to collect its garbage: for steps that follow one another and write their results."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)

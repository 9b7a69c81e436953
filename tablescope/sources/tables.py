"""Table loading and capped samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.exprs import is_orderable, sql_ident


def list_tables(spark: SparkSession, source: str, fmt: str = "parquet") -> list[str]:
    """Names of the tables at ``source``: the datasets of a folder (``<name>.<fmt>`` or a
    plain folder ``<name>``; names that begin with ``.`` or ``_`` are none), or the tables
    and views of a catalog database. Folders are listed through Spark's own file systems,
    so any URI that Spark reads will do."""
    if source.startswith("catalog:"):
        return sorted(t.name for t in spark.catalog.listTables(source.split(":", 1)[1] or None) if not t.isTemporary)
    fs, path = _filesystem(spark, source)
    out = set()
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name[:1] not in "._" and (name.endswith(f".{fmt}") or status.isDirectory()):
            out.add(name.removesuffix(f".{fmt}"))
    return sorted(out)


def _filesystem(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def load_tables(spark: SparkSession, source: str, names: Iterable[str] | None = None,
                fmt: str = "parquet", options: dict | None = None) -> dict[str, DataFrame]:
    """Load named tables from a folder of ``<name>.parquet`` files, or from the catalog.

    ``source`` is either a directory (one dataset per table; a path or any URI that Spark
    reads) or ``"catalog:<db>"`` for tables already registered in the session catalog.
    Without ``names`` every table found there is loaded. JDBC sources are read with
    ``spark.read.format("jdbc")`` by the caller (partitionColumn/numPartitions).
    Nothing is read here: every frame stays a lazy scan so pruning and pushdown apply.
    """
    wanted = list(names) if names is not None else list_tables(spark, source, fmt)
    out: dict[str, DataFrame] = {}
    if source.startswith("catalog:"):
        db = source.split(":", 1)[1]
        for n in wanted:
            out[n] = spark.table(f"{sql_ident(db)}.{sql_ident(n)}" if db else sql_ident(n))
        return out
    reader = spark.read.format(fmt).options(**(options or {}))
    root = source.rstrip("/")
    for n in wanted:
        fs, path = _filesystem(spark, f"{root}/{n}.{fmt}")
        out[n] = reader.load(f"{root}/{n}.{fmt}" if fs.exists(path) else f"{root}/{n}")
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    """Expose frames as temp views (for ``safe_sql``)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sample_rows(df: DataFrame, n: int = 10, order_by: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """First ``n`` rows in a total order (a distributed top-k, not a collect); a caller may
    set a ``cap`` on ``n``.

    Without ``order_by`` every orderable column is the ordering key, so the sample
    is deterministic. The limit is the feature here: a capped preview.
    """
    k = min(n, cap) if cap is not None else n
    keys = order_by or [f.name for f in df.schema.fields if is_orderable(f.dataType)]
    return df.orderBy(*[F.col(sql_ident(c)).asc_nulls_last() for c in keys]).limit(k)


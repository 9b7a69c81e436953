"""tablescope: data profiling, quality, lineage and KPI operators on Spark.

Every public operator is a lazy function from DataFrames to a DataFrame,
built from Spark SQL built-in expressions (no Python UDFs), so Catalyst can
prune columns, push filters into the parquet scan and fuse whole stages.
"""

from tablescope.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"

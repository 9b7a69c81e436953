"""Sources and sinks: table loading, guarded SQL, upserts, JSON payloads, exports."""

from tablescope.sources.sql import safe_sql
from tablescope.sources.tables import load_tables, sample_rows
from tablescope.sources.upsert import upsert

__all__ = ["load_tables", "sample_rows", "safe_sql", "upsert"]

"""S3: read-only ad-hoc SQL with a row cap.

The text is wrapped as a subquery, so Spark's own parser refuses DDL, DML,
``SET`` and stacked statements; CTEs, literals and comments pass. The keyword
check only adds a clear error for the common write verbs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_WRITE_VERBS = re.compile(r"^\s*(DROP|TRUNCATE|ALTER|DELETE|INSERT|UPDATE|MERGE|CREATE|SET|USE|CACHE|REFRESH)\b",
                          re.IGNORECASE)


class UnsafeQueryError(ValueError):
    pass


def _strip(sql: str) -> str:
    body = sql.strip()
    while body.endswith(";"):
        body = body[:-1].rstrip()
    if not body:
        raise UnsafeQueryError("empty query")
    if _WRITE_VERBS.match(body):
        raise UnsafeQueryError("write operations are disabled")
    return body


def safe_sql(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """Run a read-only query capped at ``limit`` rows (the cap is the feature).

    A newline precedes the closing parenthesis so a trailing ``-- comment`` cannot
    swallow it.
    """
    body = _strip(sql)
    try:
        df = spark.sql(f"SELECT * FROM (\n{body}\n) AS q LIMIT {int(limit)}")
    except Exception as exc:  # parse/analysis errors: stacked statements, DDL inside
        raise UnsafeQueryError(str(exc).splitlines()[0]) from exc
    _refuse_outside_calls(df._jdf.queryExecution().analyzed())
    return df


# Expressions that call arbitrary Java methods (reflect, java_method, try_reflect).
_REFLECTION = ("CallMethodViaReflection", "TryReflect")


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _refuse_outside_calls(plan) -> None:
    """Refuse reflection, and files named in the query itself, on the analysed plan.
    What a view or a catalog table reads was set up by its owner and is trusted."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        return
    if kind == "LogicalRelation" and plan.catalogTable().isEmpty():
        raise UnsafeQueryError("files are read by the names of registered tables only")
    todo = _each(plan.expressions())
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() in _REFLECTION:
            raise UnsafeQueryError("calls of Java methods are disabled")
        if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            _refuse_outside_calls(e.plan())
        todo += _each(e.children())
    for child in [*_each(plan.children()), *_each(plan.innerChildren())]:
        if child.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans") or kind != "WithCTE":
            _refuse_outside_calls(child)


def safe_sql_result(spark: SparkSession, sql: str, limit: int = 100) -> dict:
    """Rows plus ``row_count`` and ``truncated`` (more than ``limit`` rows exist).

    Fetches ``limit + 1`` rows so ``truncated`` is exact; the result is capped and
    small by construction.
    """
    rows = safe_sql(spark, sql, limit + 1).collect()
    truncated = len(rows) > limit
    rows = rows[:limit]
    columns = list(rows[0].asDict().keys()) if rows else safe_sql(spark, sql, 0).columns
    return {"columns": columns, "rows": [r.asDict() for r in rows], "row_count": len(rows), "truncated": truncated}

"""Spark-vs-DuckDB comparison used by the tests and by hand (python -m tests.oracle [names])."""

from __future__ import annotations

import math
import sys

import duckdb
import pandas as pd

from tablescope.plans.base import ALL_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if isinstance(v, (pd.Timestamp,)):
        return str(v.to_pydatetime())
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    if hasattr(v, "tolist"):
        return repr([_norm(x) for x in v.tolist()])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(int(v))
    return str(v)


def rows_of(columns: list[str], records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    d = con.execute(sql)
    d_cols = [c[0] for c in d.description]
    d_rows = d.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({sum(1 for x, y in zip(a, b) if x != y)} rows), e.g. {diffs}"
    return True, f"{len(s_rows)} rows"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from tablescope.session import get_spark

    sf_dir = "/root/testdata/sf0.01"
    spark = get_spark("oracle-check", 8)
    qs, sqls = queries(), oracle_sql()
    names = argv or sorted(qs)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        if n not in sqls:
            try:
                cnt = qs[n](spark, sf_dir).count()
                print(f"ROWS  {n}: {cnt} rows (no oracle)")
            except Exception as exc:  # noqa: BLE001
                bad += 1
                print(f"ERROR {n}: {type(exc).__name__}: {str(exc)[:300]}")
            continue
        try:
            ok, msg = compare(spark, n, qs[n], sqls[n], sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(f"{'OK   ' if ok else 'FAIL '} {n}: {msg}")
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and name -> oracle SQL."""

from __future__ import annotations

import importlib

from tablescope.plans.base import REGISTRY

_MODULES = ("quality_queries", "business_queries", "catalog_queries")


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tablescope.plans.{m}")


def queries() -> dict:
    _load()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict:
    _load()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}

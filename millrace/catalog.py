"""Registry of the queries over the engine's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_PLANS = ["programs", "rules", "texts", "dedup", "joins", "metrics", "pages", "training", "evaluation", "chains", "assemblies", "audits"]


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function and, if given, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _load() -> None:
    import importlib

    for name in _PLANS:
        importlib.import_module(f"millrace.plans.{name}")


_load()

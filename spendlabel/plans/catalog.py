"""Registered queries: one per operator of the inventory, each with its DuckDB twin.

Every query reads the whole shared tables through the fixture views; no id subsets,
row caps or prefixes. Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the phase modules registers their queries.
    from . import q_clean, q_sets, q_model, q_io  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


__all__ = ["query", "queries", "oracle_sql", "Fixtures"]

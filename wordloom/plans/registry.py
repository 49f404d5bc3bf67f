"""Registry of named queries over the driver's tables, each with its DuckDB twin.

A query is a callable ``(spark, sf_dir) -> DataFrame``; its oracle is ANSI SQL
that DuckDB runs over views named like the tables.  Column names and types are
aligned on both sides (integers BIGINT, fractions DOUBLE rounded to 6 places).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional SQL oracle."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__ = getattr(fn, "__name__", name)
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return wrap


def queries() -> dict[str, QueryFn]:
    from . import catalog  # noqa: F401  (registers on import)

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    from . import catalog  # noqa: F401

    return dict(_ORACLES)

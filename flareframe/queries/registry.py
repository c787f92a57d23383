"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from flareframe.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_FAMILIES = ("projections", "events", "aggregates", "sequences", "sets", "sampling", "series",
             "decoding", "metrics", "ordinal", "reports", "files", "plans")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its independent check."""
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql.strip()
        return run
    return register


def _load() -> None:
    for f in _FAMILIES:
        importlib.import_module(f"flareframe.queries.{f}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

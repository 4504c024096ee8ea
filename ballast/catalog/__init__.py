"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def keep(query: Query) -> Query:
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return keep


def load() -> None:
    from ballast.catalog import columns, costs, registry, report, streams, texts, time  # noqa: F401

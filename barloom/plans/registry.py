"""Registered queries: an operator bound to its input tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add

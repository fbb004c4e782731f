"""Queries: operators bound to tables."""

from __future__ import annotations

import importlib

#: Modules that register queries.
MODULES = ("ingest_queries", "feature_queries", "market_queries", "metric_queries", "portfolio_queries", "system_queries", "lifecycle_queries")


def load() -> tuple[dict, dict]:
    """(queries, SQL) of all modules."""
    for name in MODULES:
        importlib.import_module(f"barloom.plans.{name}")
    from barloom.plans.registry import ORACLE_SQL, QUERIES

    return dict(QUERIES), dict(ORACLE_SQL)

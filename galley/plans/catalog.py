"""The registered queries of the core, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galley.session import shipped

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries when imported.
MODULES = ("galley.operators.relational", "galley.operators.aggregates", "galley.operators.windows", "galley.operators.textops", "galley.operators.clustering", "galley.operators.evaluation", "galley.operators.evidence", "galley.operators.claims", "galley.operators.entities", "galley.operators.content", "galley.operators.extra", "galley.sources.feeds", "galley.plans.products", "galley.plans.pipeline", "galley.plans.scorecard", "galley.streaming.jobs")


def query(name: str, sql: str | None = None):
    """Registers a query function under its operator id."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: shipped(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)

"""The registered queries of this subpackage: pN_... for problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galley.llm import caps, conduct, encodings, languages, mixing, neardup, pages, tokens, truncation, unify
from galley.session import shipped

MODULES = (truncation, neardup, caps, languages, pages, encodings, unify, tokens, mixing, conduct)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

"""Every query of the engine by name, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import assistants, base, context, extraction, graph, hits, library, parts, rules, sessions, stored, text, vectors

AREAS = (text, vectors, extraction, graph, hits, context, sessions, rules, assistants, library, stored, parts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)

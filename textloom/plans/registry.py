"""All queries over the reference tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    found: dict[str, str] = {}
    for module in _modules():
        found.update(module.SQL)
    return found


def _modules() -> list:
    from textloom.plans import aggregates, cleaning, identity, journal, parallel, review, selection, similarity, vocabulary

    return [cleaning, identity, parallel, similarity, selection, aggregates, vocabulary, journal, review]

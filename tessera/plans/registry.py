"""Queries over the given tables, each bound to the SQL that it's held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import more_queries, search_queries, store_queries, whole_queries


def cases() -> dict[str, tuple]:
    """Queries by name, each over the whole of its tables."""
    return search_queries.CASES | store_queries.CASES | whole_queries.CASES | more_queries.CASES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in cases().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in cases().items() if sql}

"""All queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archipel.plans import archive, knowledge, search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return search.QUERIES | archive.QUERIES | knowledge.QUERIES


def oracle_sql() -> dict[str, str]:
    return search.SQL | archive.SQL | knowledge.SQL

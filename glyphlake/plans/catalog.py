"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphlake.plans import drawing_queries, element_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.QUERIES | drawing_queries.QUERIES | element_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | drawing_queries.SQL | element_queries.SQL

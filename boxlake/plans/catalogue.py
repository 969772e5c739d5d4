"""All queries of the core library, by name, with the SQL that another engine checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxlake.plans import box_queries, evaluation_queries, job_queries, rotated_queries, source_queries, table_queries

_PARTS = (evaluation_queries, box_queries, job_queries, source_queries, rotated_queries, table_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}

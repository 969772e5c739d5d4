"""How queries are noted down: a builder over fixture tables, rounded, and the matching SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.plans.fixtures import fixtures

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero, so that engines agree on their text."""
    return df.select(*((F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, tables: str, build: Callable[..., DataFrame], sql: str | None = None, places: int = 6) -> None:
        """build gets a DataFrame for each of the (space-separated) fixture tables."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(*fixtures(spark, sf_dir, *tables.split())), places)

        self.queries[name] = query
        if sql:
            self.oracle[name] = sql

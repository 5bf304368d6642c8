"""Queries by name, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function ``(spark, folder) -> DataFrame`` as a query."""

        def register(run: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} exists")
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return register

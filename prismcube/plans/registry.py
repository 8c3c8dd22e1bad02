"""Registry of named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, in order of definition, each with or without SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is defined twice")
        self.queries[name] = run
        if sql:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            self.add(name, run, sql)
            return run

        return keep

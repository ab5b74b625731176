"""Named queries: each takes (spark, folder) and gives a DataFrame; SQL that states the same stands beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            key = name or fn.__name__
            if key in self.queries:
                raise ValueError(f"{key} is there already")
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return add

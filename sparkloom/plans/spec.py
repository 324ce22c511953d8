"""Registration of queries: a callable and, where SQL can express it, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return register

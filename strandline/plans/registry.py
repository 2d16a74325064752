"""Named queries with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Attribute access to the Parquet tables of a data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)


class Catalog:
    """Collects queries by decorator: ``@catalog.add(sql)`` on ``f(tables)``."""

    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)

    def add(self, sql: str | None = None):
        def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self._queries[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql:
                self._sql[build.__name__] = sql
            return build

        return register

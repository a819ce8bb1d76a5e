"""Where queries are registered by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.sources.tables import table


class Tables:
    """The tables of a folder; ``t("name", *columns)`` scans these columns only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, *columns) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)


class Registry:
    """Queries of one module. A query takes ``Tables``; its SQL must give the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(function: Callable[[Tables], DataFrame]):
            self.queries[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add

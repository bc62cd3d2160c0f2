"""Registration of queries: a builder over the driver tables and, where SQL can express it, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one directory, read on demand."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        QUERIES[build.__name__] = lambda spark, path: build(Tables(spark, path))
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register

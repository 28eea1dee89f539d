"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The clock of all queries: the end of the event data.
NOW = datetime(2024, 1, 31)
EVENTS_FROM, EVENTS_TO = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)

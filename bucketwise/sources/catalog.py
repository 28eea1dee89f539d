"""What tables and columns there are, from the catalog and from plans."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.functions.schema import column_class
from bucketwise.sources.tables import local_rows


def _matches(name: str, patterns: Iterable[str]) -> bool:
    """SQL-style ``%`` patterns, ignoring case."""
    return any(fnmatch.fnmatchcase(name.lower(), p.lower().replace("%", "*").replace("_", "?")) for p in patterns)


def list_tables(spark: SparkSession, database: str | None = None, include: Iterable[str] = (),
                exclude: Iterable[str] = (), views: bool = True) -> list[str]:
    """Table names by pattern; hidden names (leading dot) never show."""
    include, exclude = list(include), list(exclude)
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return sorted(
        t.name for t in found
        if not t.name.startswith(".") and (views or t.tableType not in ("VIEW", "TEMPORARY"))
        and (not include or _matches(t.name, include)) and not _matches(t.name, exclude))


def columns_of(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """One row per table and column with type and class."""
    rows = [(name, f.name, i, f.dataType.simpleString(), column_class(f.dataType))
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return local_rows(spark, rows, "table string, column string, position int, type string, class string")


def common_columns(columns: DataFrame, tables: int) -> DataFrame:
    """Columns every table has."""
    return (columns.groupBy("column").agg(F.count_distinct("table").alias("n"))
            .where(F.col("n") == tables).select("column"))

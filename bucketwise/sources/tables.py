"""Reading tables: by name, by path or glob, delimited text, and generated grids."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bucketwise.functions.buckets import Width
from bucketwise.operators.filters import as_utc, sql_literal


def scan(spark: SparkSession, source: str, catalog: str | None = None) -> DataFrame:
    """A table by name, or Parquet files by path or glob."""
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(f"{catalog}.{source}" if catalog else source)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Delimited text with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("sep", sep).csv(path)


def local_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation, whose size Spark knows exactly.

    Joins against it are broadcast below the session's own threshold and shuffled
    beyond it.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = struct.fieldNames()
    data = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(data, schema=struct)


def time_grid(spark: SparkSession, start: datetime, end: datetime, step: int | str,
              name: str = "time") -> DataFrame:
    """One row per step from ``start`` up to but excluding ``end``, generated in parallel."""
    width = Width.parse(step)
    n = -(-int((as_utc(end) - as_utc(start)).total_seconds()) // width.seconds)
    base = F.expr(sql_literal(as_utc(start)))
    shifted = base + F.make_dt_interval(secs=F.col("id") * F.lit(width.seconds))
    return spark.range(max(n, 0)).select(F.col("id").alias("n"), shifted.alias(name))

"""Changing the shape of rows: unnest, unpivot, tag and combine, drop, cast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.functions.fields import quote
from bucketwise.functions.schema import contains_variant


def all_except(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def cast_in_place(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Change column types and keep their order."""
    return df.withColumns({n: F.col(quote(n)).cast(t) for n, t in types.items()})


def export_safe(df: DataFrame) -> DataFrame:
    """Turn schemaless columns into text; all others keep type and order."""
    unsafe = [f.name for f in df.schema.fields if contains_variant(f.dataType)]
    return df.withColumns({n: F.col(quote(n)).cast("string") for n in unsafe}) if unsafe else df


def unnest(df: DataFrame, *arrays: str) -> DataFrame:
    """One row per array element, arrays one after another; empty arrays drop the row."""
    for name in arrays:
        df = df.withColumn(name, F.explode(F.col(quote(name))))
    return df


def to_tidy(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "metric",
            value: str = "value") -> DataFrame:
    """Wide to long: one row per id and measure."""
    return df.unpivot([F.col(quote(i)) for i in ids], [F.col(quote(v)) for v in values], variable, value)


def union_tagged(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """All rows of several frames with the same columns, tagged by origin."""
    out = None
    for label, df in parts.items():
        tagged = df.withColumn(tag, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("nothing to combine")
    return out

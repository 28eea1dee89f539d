"""Column classes and small schema questions, answered from ``df.schema`` alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEMPORAL, CATEGORICAL, CONTINUOUS, NEUTRAL = "temporal", "categorical", "continuous", ""

# Key in a field's metadata that marks a column as safe to list exhaustively.
LISTABLE = "listable"


def column_class(dtype: T.DataType) -> str:
    """temporal, categorical, continuous, or '' for nested and unknown types."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(dtype, T.NumericType):
        return CONTINUOUS
    if isinstance(dtype, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    return NEUTRAL


def first_of_class(df: DataFrame, wanted: str) -> str | None:
    return next((f.name for f in df.schema.fields if column_class(f.dataType) == wanted), None)


def is_listable(field: T.StructField) -> bool:
    """Columns enumerated without asking for their cardinality first."""
    return isinstance(field.dataType, T.BooleanType) or bool(field.metadata.get(LISTABLE))


def is_numeric_like(dtype: T.DataType) -> bool:
    """Numbers, dates and times: their value lists say little."""
    return column_class(dtype) in (CONTINUOUS, TEMPORAL)


def mark_listable(df: DataFrame, *names: str) -> DataFrame:
    """Record in column metadata that these columns have a small value set."""
    for name in names:
        df = df.withMetadata(name, {**df.schema[name].metadata, LISTABLE: True})
    return df


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def contains_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.VariantType):
        return True
    if isinstance(dtype, T.ArrayType):
        return contains_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return contains_variant(dtype.keyType) or contains_variant(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(contains_variant(f.dataType) for f in dtype.fields)
    return False


def time_column(df: DataFrame, given: str | None = None) -> str | None:
    """Column to bound scans with: the given one, the sort key, else the first temporal."""
    if given:
        require_columns(df, [given])
        return given
    temporal = [f for f in df.schema.fields if column_class(f.dataType) == TEMPORAL]
    keyed = [f for f in temporal if "sort_key" in f.metadata]
    if keyed:
        return min(keyed, key=lambda f: f.metadata["sort_key"]).name
    return temporal[0].name if temporal else None

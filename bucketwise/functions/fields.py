"""Fields: a SQL expression with an alias, and optionally a bucket width.

A field is plain data, so that queries made of fields can be stored as JSON.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from bucketwise.functions.buckets import DEFAULT_BUCKET_SECONDS, Width, bucket, bucket_sql, pick_width
from bucketwise.functions.scalars import json_path, sql_string

KINDS = ("expr", "count", "enum", "autoBucket")


@dataclass(frozen=True)
class Field:
    definition: str
    alias: str
    kind: str = "expr"
    bucket_ms: int | None = None

    def with_alias(self, alias: str) -> "Field":
        return replace(self, alias=alias)

    @property
    def is_auto(self) -> bool:
        return self.kind == "autoBucket"

    @property
    def is_time(self) -> bool:
        return self.is_auto or self.bucket_ms is not None

    def resolve(self, range_seconds: int | None) -> "Field":
        """Fix the width of an automatic bucket; other fields stay as they are."""
        if not self.is_auto:
            return self
        seconds = DEFAULT_BUCKET_SECONDS if range_seconds is None else pick_width(range_seconds)
        return replace(self, bucket_ms=seconds * 1000)

    def column(self) -> Column:
        """The unaliased expression."""
        if self.is_auto:
            seconds = (self.bucket_ms or DEFAULT_BUCKET_SECONDS * 1000) // 1000
            return bucket(F.expr(self.definition), seconds)
        return F.expr(self.definition)

    # -- JSON ---------------------------------------------------------------
    def to_dict(self) -> dict:
        if self.is_auto:
            return {"kind": self.kind, "column": self.definition, "alias": self.alias}
        out = {"kind": self.kind, "definition": self.definition, "alias": self.alias}
        if self.bucket_ms:
            out["xBucketSizeMs"] = self.bucket_ms
        return out

    @classmethod
    def from_dict(cls, data: dict | None) -> "Field | None":
        if data is None:
            return None
        kind = data.get("kind") or "expr"
        if kind not in KINDS:
            raise ValueError(f"unknown field kind {kind!r}")
        if kind == "autoBucket":
            if not data.get("column"):
                raise ValueError("an automatic bucket needs a column")
            return auto_bucket(data["column"], data.get("alias") or "time")
        if not data.get("definition"):
            raise ValueError(f"field of kind {kind!r} needs a definition")
        return cls(data["definition"], data.get("alias") or data["definition"], kind,
                   data.get("xBucketSizeMs") or None)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(definition: str, alias: str | None = None) -> Field:
    return Field(definition, alias or definition)


def ref(alias: str, bucket_ms: int | None = None) -> Field:
    """An existing result column, optionally carrying a bucket width."""
    return Field(quote(alias), alias, bucket_ms=bucket_ms)


def time_field(definition: str, alias: str, bucket_ms: int) -> Field:
    return Field(definition, alias, bucket_ms=bucket_ms)


def every(column: str, width: int | str, alias: str = "time", zone: str | None = None) -> Field:
    """Bucket of a column; with a ``zone``, days, weeks and months go by its clocks."""
    return Field(bucket_sql(column, width, zone), alias, bucket_ms=Width.parse(width).ms)


def every_15_minutes(column: str = "timestamp") -> Field:
    return every(column, "15 minutes")


def every_5_minutes(column: str = "timestamp") -> Field:
    return every(column, "5 minutes")


def auto_bucket(column: str, alias: str = "time") -> Field:
    """Bucket whose width follows the time range of the query."""
    return Field(column, alias, kind="autoBucket")


def count(alias: str = "cnt") -> Field:
    return Field("count(*)", alias, kind="count")


def enum(name: str) -> Field:
    """A column as category."""
    return Field(f"CAST({quote(name)} AS STRING)", name, kind="enum")


def json_text(column: str, *keys: str) -> Field:
    """String at a JSON path, named after the last key."""
    found = f"try_variant_get(try_parse_json({column}), {sql_string(json_path(keys))}, 'variant')"
    text = f"CASE WHEN schema_of_variant({found}) = 'STRING' THEN CAST({found} AS STRING) ELSE '' END"
    return Field(text, str(keys[-1]))


def _aggregate(fn: str):
    def make(expression: str, alias: str | None = None) -> Field:
        return Field(f"{fn}({expression})", alias or f"{fn}_{expression}")

    make.__name__ = fn
    return make


sum_of, avg_of, min_of, max_of = (_aggregate(fn) for fn in ("sum", "avg", "min", "max"))


def distinct_of(expression: str, alias: str | None = None, exact: bool = False) -> Field:
    """Distinct values: a mergeable sketch by default, exact on request."""
    text = f"count(DISTINCT {expression})" if exact else f"approx_count_distinct({expression})"
    return Field(text, alias or f"distinct_{expression}")


def quantile_of(expression: str, p: float, alias: str | None = None, accuracy: int = 10000) -> Field:
    """Approximate quantile from a mergeable sketch; exact ones: ``operators.order``."""
    return Field(f"percentile_approx({expression}, {p}, {accuracy})", alias or f"q_{expression}")

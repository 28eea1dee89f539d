"""Queries written as SQL text, from files or inline.

Two tokens are replaced before Spark sees the text: ``{{FILTERS}}`` by the active
predicates and ``{{BUCKET:column}}`` by the bucket expression for the active time
range. Values are bound through ``:name`` markers, never pasted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from bucketwise.functions.buckets import bucket_sql, pick_width
from bucketwise.functions.fields import quote
from bucketwise.operators.filters import join_clauses

FILTERS_TOKEN = "{{FILTERS}}"
BUCKET_TOKEN = re.compile(r"\{\{BUCKET:([^{}]+)\}\}")
ANY_TOKEN = re.compile(r"\{\{[A-Z]+[^{}]*\}\}")


@contextmanager
def within(spark: SparkSession, catalog: str | None) -> Iterator[None]:
    """Look up plain table names in a catalog or database (``name`` or ``catalog.name``); temporary views come first."""
    if not catalog:
        yield
        return
    before = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    spark.sql("USE " + ".".join(quote(part) for part in catalog.split(".")))
    try:
        yield
    finally:
        spark.catalog.setCurrentCatalog(before[0])
        spark.catalog.setCurrentDatabase(before[1])


@dataclass(frozen=True)
class SqlText:
    """A query text with its options; ``path`` is read when the query is compiled."""

    text: str | None = None
    path: str | None = None
    where: tuple[str, ...] = ()
    skip_filters: bool = False
    auto_bucket: bool = False
    catalog: str | None = None
    bucket_ms: int | None = None

    def with_where(self, *clauses: str) -> "SqlText":
        return replace(self, where=(*self.where, *clauses))

    def with_auto_bucket(self) -> "SqlText":
        return replace(self, auto_bucket=True)

    def resolve(self, range_seconds: int | None) -> "SqlText":
        if not self.auto_bucket or range_seconds is None:
            return self
        return replace(self, bucket_ms=pick_width(range_seconds) * 1000)

    def load(self, spark: SparkSession | None = None) -> str:
        if self.text is not None:
            return self.text
        if self.path is None:
            raise ValueError("a query text needs either text or a path")
        with open(self.path, encoding="utf-8") as handle:
            return handle.read()

    def render(self) -> str:
        content = self.load()
        if not self.skip_filters and FILTERS_TOKEN not in content:
            raise ValueError(
                f"the query must contain {FILTERS_TOKEN} (or be declared as unfiltered): "
                f"{self.path or content[:80]!r}")
        out = content.replace(FILTERS_TOKEN, join_clauses(self.where))
        if self.auto_bucket and self.bucket_ms:
            seconds = self.bucket_ms // 1000
            out = BUCKET_TOKEN.sub(lambda m: bucket_sql(m.group(1).strip(), seconds), out)
        left = ANY_TOKEN.search(out)
        if left:
            raise ValueError(f"token {left.group(0)} was not replaced; enable automatic buckets "
                             "and give a time range")
        return out.rstrip().rstrip(";")

    def to_df(self, spark: SparkSession, params: Mapping | None = None) -> DataFrame:
        text = self.render()
        used = {k: v for k, v in (params or {}).items() if re.search(rf":{re.escape(k)}\b", text)}
        with within(spark, self.catalog):  # names are looked up when the text is analyzed, which is now
            return spark.sql(text, args=used) if used else spark.sql(text)

    def to_dict(self) -> dict:
        body = {"kind": "raw", "sql": self.text} if self.path is None else {"kind": "file", "path": self.path}
        if self.where:
            body["where"] = list(self.where)
        if self.catalog:
            body["database"] = self.catalog
        if self.skip_filters:
            body["skipFilters"] = True
        if self.auto_bucket:
            body["autoBucket"] = True
        return body

    @classmethod
    def from_dict(cls, data: Mapping) -> "SqlText":
        return cls(
            text=data.get("sql") if data["kind"] == "raw" else None,
            path=data.get("path") if data["kind"] == "file" else None,
            where=tuple(data.get("where") or ()),
            skip_filters=bool(data.get("skipFilters")),
            auto_bucket=bool(data.get("autoBucket")),
            catalog=data.get("database") or None,
        )


def from_file(path: str) -> SqlText:
    return SqlText(path=path)


def from_file_unfiltered(path: str) -> SqlText:
    return SqlText(path=path, skip_filters=True)


def from_string(text: str) -> SqlText:
    return SqlText(text=text)


def from_string_unfiltered(text: str) -> SqlText:
    return SqlText(text=text, skip_filters=True)


_CASTS = {
    "String": str, "Int32": int, "Int64": int, "UInt32": int, "UInt64": int, "UInt16": int,
    "Float64": float, "Float32": float,
    "Bool": lambda v: v if isinstance(v, bool) else str(v).lower() in ("1", "true"),
}


def typed_params(values: Mapping[str, object], types: Mapping[str, str]) -> dict[str, object]:
    """Cast parameter values to their declared types before binding."""
    out = {}
    for name, value in values.items():
        kind = types.get(name, "String")
        if kind not in _CASTS:
            raise ValueError(f"unknown parameter type {kind!r} for {name!r}")
        out[name] = _CASTS[kind](value)
    return out

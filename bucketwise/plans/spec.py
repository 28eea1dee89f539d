"""Queries as data, compiled to lazy DataFrames."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field as dc_field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.functions.fields import Field, quote
from bucketwise.operators.filters import FilterState, ResolvedRange, as_utc, where_all
from bucketwise.operators.series import gap_fill
from bucketwise.sources.sqltext import SqlText


@dataclass(frozen=True)
class RunContext:
    """Everything a query needs besides its own text: tables, filters, the clock."""

    spark: SparkSession
    now: datetime
    filters: FilterState = FilterState()
    tables: Mapping[str, DataFrame] = dc_field(default_factory=dict)
    ts: str = "timestamp"
    zone: str = "UTC"
    params: Mapping[str, object] = dc_field(default_factory=dict)

    @property
    def range(self) -> ResolvedRange | None:
        return self.filters.resolve(self.now, self.zone)

    def table(self, name: str, catalog: str | None = None) -> DataFrame:
        if catalog:
            return self.spark.table(f"{catalog}.{name}")
        return self.tables[name] if name in self.tables else self.spark.table(name)


@dataclass(frozen=True)
class Compiled:
    """A lazy result with what a chart needs to know about it."""

    df: DataFrame
    time_range: ResolvedRange | None = None
    bucket_ms: int | None = None
    thresholds: Mapping[str, float] = dc_field(default_factory=dict)


@dataclass(frozen=True)
class QuerySpec:
    """Select / where / group / order / limit over one table. Immutable."""

    table: str | None = None
    select: tuple[Field, ...] = ()
    where: tuple[str, ...] = ()
    group_by: tuple[Field, ...] = ()
    order_by: tuple[Field, ...] = ()
    limit: int = 0
    fill_step: str | None = None
    skip_filters: bool = False
    catalog: str | None = None

    # -- derivation: each returns a new spec ---------------------------------
    def selecting(self, *fields: Field) -> "QuerySpec":
        return replace(self, select=(*self.select, *fields))

    def selecting_first(self, *fields: Field) -> "QuerySpec":
        return replace(self, select=(*fields, *self.select))

    def filtering(self, *clauses: str) -> "QuerySpec":
        return replace(self, where=(*self.where, *clauses))

    def grouping(self, *fields: Field) -> "QuerySpec":
        return replace(self, group_by=(*self.group_by, *fields))

    def ordering(self, *fields: Field) -> "QuerySpec":
        return replace(self, order_by=(*self.order_by, *fields))

    def limiting(self, n: int) -> "QuerySpec":
        return replace(self, limit=n)

    def filling(self, step: str | None) -> "QuerySpec":
        return replace(self, fill_step=step)

    def unfiltered(self) -> "QuerySpec":
        return replace(self, skip_filters=True)

    def on_catalog(self, name: str) -> "QuerySpec":
        return replace(self, catalog=name)

    @property
    def has_auto_bucket(self) -> bool:
        return any(f.is_auto for f in (*self.select, *self.group_by, *self.order_by))

    def resolve(self, range_seconds: int | None) -> "QuerySpec":
        """Fix automatic buckets for a range; a spec without them is returned as is."""
        if not self.has_auto_bucket:
            return self
        fix = lambda fields: tuple(f.resolve(range_seconds) for f in fields)
        return replace(self, select=fix(self.select), group_by=fix(self.group_by), order_by=fix(self.order_by))

    # -- compilation ----------------------------------------------------------
    def to_df(self, base: DataFrame) -> DataFrame:
        """Build the query over ``base``. Nothing runs, but for a gap fill without series, which is sorted at once."""
        df = where_all(base, self.where)
        return self.finished(self._grouped(df) if self.group_by else self._projected(df))

    def finished(self, out: DataFrame) -> DataFrame:
        """Gap fill, order and limit over the selected columns."""
        if self.fill_step:
            if not self.order_by:
                raise ValueError("gap fill needs an order: its last column is filled")
            series = [f.alias for f in self.order_by[:-1]]
            out = gap_fill(out, self.order_by[-1].alias, self.fill_step, series)
        if self.order_by:
            out = out.orderBy(*[self._order_key(out, f) for f in self.order_by])
        if self.limit > 0:
            out = out.limit(self.limit)
        return out

    @property
    def measures(self) -> tuple[Field, ...]:
        """What a grouped query selects besides its keys."""
        keys = {f.alias for f in self.group_by}
        return tuple(f for f in self.select if f.alias not in keys)

    def _grouped(self, df: DataFrame) -> DataFrame:
        # Each time bucket gets a projection of its own, since Spark resolves one
        # tumbling window per projection.
        keys = []
        for i, f in enumerate(self.group_by):
            if f.is_time:
                df = df.withColumn(f"__bucket{i}", f.column())
                keys.append(F.col(f"__bucket{i}").alias(f.alias))
            else:
                keys.append(f.column().alias(f.alias))
        measures = [f.column().alias(f.alias) for f in self.measures]
        grouped = df.groupBy(*keys)
        out = grouped.agg(*measures) if measures else df.select(*keys).distinct()
        return out.select(*[F.col(quote(f.alias)) for f in self.select]) if self.select else out

    def _projected(self, df: DataFrame) -> DataFrame:
        if not self.select:
            return df
        columns = []
        for i, f in enumerate(self.select):
            if f.is_time:
                df = df.withColumn(f"__bucket{i}", f.column())
                columns.append(F.col(f"__bucket{i}").alias(f.alias))
            else:
                columns.append(f.column().alias(f.alias))
        return df.select(*columns)

    @staticmethod
    def _order_key(out: DataFrame, f: Field):
        col = F.col(quote(f.alias)) if f.alias in out.columns else f.column()
        return col.asc_nulls_last()

    # -- JSON -------------------------------------------------------------------
    def to_dict(self) -> dict:
        body: dict = {"kind": "table", "table": self.table}
        for key, fields in (("select", self.select), ("groupBy", self.group_by), ("orderBy", self.order_by)):
            if fields:
                body[key] = [f.to_dict() for f in fields]
        optional = {"where": list(self.where), "limit": self.limit, "fillStep": self.fill_step,
                    "database": self.catalog, "skipFilters": self.skip_filters}
        body.update({k: v for k, v in optional.items() if v})
        return body

    @classmethod
    def from_dict(cls, data: Mapping) -> "QuerySpec":
        fields = lambda key: tuple(Field.from_dict(f) for f in data.get(key) or ())
        return cls(
            table=data.get("table"), select=fields("select"), where=tuple(data.get("where") or ()),
            group_by=fields("groupBy"), order_by=fields("orderBy"), limit=int(data.get("limit") or 0),
            fill_step=data.get("fillStep") or None, skip_filters=bool(data.get("skipFilters")),
            catalog=data.get("database") or None,
        )


Query = QuerySpec | SqlText


def query_to_json(query: Query) -> str:
    return json.dumps(query.to_dict())


def query_from_dict(data: Mapping | None) -> Query | None:
    if data is None:
        return None
    kind = data.get("kind")
    if kind == "table":
        return QuerySpec.from_dict(data)
    if kind in ("file", "raw"):
        return SqlText.from_dict(data)
    raise ValueError(f"unknown query kind {kind!r}")


def query_from_json(text: str) -> Query | None:
    return query_from_dict(json.loads(text))


def from_table(name: str, *select: Field) -> QuerySpec:
    return QuerySpec(table=name, select=select)


def compile_query(query: Query, ctx: RunContext) -> Compiled:
    """Put filters and bucket widths into a query and build its DataFrame."""
    span = None if query.skip_filters else ctx.range
    resolved = query.resolve(span.seconds if span else None)
    clauses = () if query.skip_filters else ctx.filters.clauses(ctx.ts, as_utc(ctx.now), ctx.zone)
    params = {**ctx.params, **(span.bind() if span else {})}
    if isinstance(resolved, SqlText):
        resolved = resolved.with_where(*clauses)
        df = resolved.to_df(ctx.spark, params)
        return Compiled(df, span, resolved.bucket_ms)
    if not resolved.table:
        raise ValueError("the query names no table")
    df = resolved.filtering(*clauses).to_df(ctx.table(resolved.table, resolved.catalog))
    return Compiled(df, span, bucket_width(resolved))


def bucket_width(resolved: QuerySpec) -> int | None:
    """Milliseconds of the first time bucket among a query's fields."""
    widths = [f.bucket_ms for f in (*resolved.select, *resolved.group_by) if f.bucket_ms]
    return widths[0] if widths else None

"""Charts and dashboards as data.

A chart names a query and the fields that play its roles; its shape decides which
fields become group keys, in which column order, and how rows are ordered.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.functions.buckets import per_second
from bucketwise.functions.fields import Field, auto_bucket, count, enum, quote
from bucketwise.functions.schema import CATEGORICAL, TEMPORAL, first_of_class
from bucketwise.operators.filters import FilterState
from bucketwise.operators.series import order_categories, share, stack_positions
from bucketwise.plans.shared import compile_together
from bucketwise.plans.spec import Compiled, Query, QuerySpec, RunContext, compile_query, from_table, query_from_dict
from bucketwise.sources.sqltext import SqlText


@dataclass(frozen=True)
class Shape:
    """Roles of one chart type: group keys in column order, measures, sort keys."""

    keys: tuple[str, ...]
    measures: tuple[str, ...]
    order: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    time_axis: bool = False


SHAPES = {
    "timeBar": Shape(("fy", "fx", "fill", "x"), ("y",), ("x", "fill"), ("x", "y"), True),
    "timeLine": Shape(("fy", "fx", "z", "stroke", "x"), ("y",), ("x", "stroke", "z"), ("x", "y"), True),
    "barVertical": Shape(("fy", "fx", "fill", "x"), ("y",), (), ("x", "y")),
    "barHorizontal": Shape(("fill", "y"), ("x",), (), ("x", "y")),
    "timeHeatmap": Shape(("y", "x"), ("fill",), ("x", "y"), ("x", "y"), True),
    "timeHeatmapOrdinal": Shape(("y", "x"), ("fill",), ("x", "y"), ("x", "y"), True),
}
# Role names whose stored key differs from the role.
_STORED = {"timeLine": {"stroke": "strokeField", "z": "zField"}, "stats": {"title": "titleField", "fill": "fillField"}}
_ROLES = ("x", "y", "fill", "fx", "fy", "stroke", "z", "title")

CHART_TYPES = (*SHAPES, "stats", "table")
CONTAINER_TYPES = {"grid": "areas", "collapsibleGroup": "widgets"}
PARAMETER_TYPES = ("checkboxGroup", "textInput")


@dataclass(frozen=True)
class Chart:
    type: str
    query: Query | None = None
    x: Field | None = None
    y: Field | None = None
    fill: Field | None = None
    fx: Field | None = None
    fy: Field | None = None
    stroke: Field | None = None
    z: Field | None = None
    title: Field | None = None
    fill_step: str | None = None
    limit: int = 0  # of a table; 0 shows all rows
    y_bin: float | None = None

    def __post_init__(self):
        if self.type not in CHART_TYPES:
            raise ValueError(f"unknown chart type {self.type!r}")

    def derive(self, **changes) -> "Chart":
        return replace(self, **changes)

    def field(self, role: str) -> Field | None:
        return getattr(self, role)

    def check(self) -> None:
        """Fail with a clear message when a role or the query is missing."""
        if self.query is None:
            raise ValueError(f"{self.type}: the chart has no query")
        shape = SHAPES.get(self.type)
        if shape:
            for role in shape.required:
                if self.field(role) is None:
                    raise ValueError(f"{self.type}: field {role!r} is required")
            if shape.time_axis and not self.x.is_time:
                raise ValueError(f"{self.type}: x must be a time bucket")

    def build(self, ordered: bool = True) -> Query:
        """The chart's query with its roles put in; the stored query stays unchanged.

        Results that are processed further need no order, which saves a shuffle.
        """
        self.check()
        query = self.query
        if isinstance(query, SqlText):
            return query
        if self.type == "table":
            return query.limiting(self.limit)
        if self.type == "stats":
            return self._stats_query(query)
        shape = SHAPES[self.type]
        keys = [self.field(r) for r in shape.keys if self.field(r)]
        measures = [self.field(r) for r in shape.measures if self.field(r)]
        if self.type == "timeHeatmap" and self.y_bin:  # rows are grouped by cell, not by value
            keys = [value_bin(k, self.y_bin) if k is self.y else k for k in keys]
        query = query.selecting_first(*keys).selecting(*measures).grouping(*keys)
        order = [self.field(r) for r in shape.order if self.field(r)]
        if self.type == "timeHeatmap" and self.y_bin:
            order = [value_bin(o, self.y_bin) if o is self.y else o for o in order]
        if self.fill_step:
            # Series keys come first, so that each series is filled on its own.
            series = [self.field(r) for r in ("stroke", "z", "fill", "fx", "fy") if self.field(r)]
            order = [*series, self.x]
        if not ordered and not self.fill_step:
            return query
        return query.ordering(*order).filling(self.fill_step)

    def _stats_query(self, query: QuerySpec) -> QuerySpec:
        if self.title is None:
            return query.selecting(*([self.fill] if self.fill else []))
        measures = [*query.select, *([self.fill] if self.fill else [])]
        rounded = tuple(replace(m, definition=f"round({m.definition}, 2)") if m.kind == "expr" else m
                        for m in measures)
        return replace(query, select=(self.title, *rounded)).grouping(self.title)

    def run(self, ctx: RunContext, ordered: bool = True) -> Compiled:
        return compile_query(self.build(ordered), ctx)

    def over(self, df: DataFrame, now: datetime, filters: FilterState = FilterState(), ts: str = "timestamp",
             zone: str = "UTC") -> Compiled:
        """Run the chart over a DataFrame instead of a named table."""
        if isinstance(self.query, SqlText):
            raise ValueError("a chart with a SQL text names its tables; use run() with them")
        query = self.query if isinstance(self.query, QuerySpec) else QuerySpec()
        chart = replace(self, query=replace(query, table="__source"))
        return chart.run(RunContext(df.sparkSession, now, filters, {"__source": df}, ts, zone))

    # -- JSON -------------------------------------------------------------------
    def to_dict(self) -> dict:
        names = _STORED.get(self.type, {})
        props: dict = {"sql": self.query.to_dict() if self.query else None}
        for role in _ROLES:
            if self.field(role):
                props[names.get(role, role)] = self.field(role).to_dict()
        if self.fill_step:
            props["fillStep"] = self.fill_step
        if self.type == "table" and self.limit:
            props["limit"] = self.limit
        if self.y_bin:
            props["yBucketSize"] = self.y_bin
        return {"type": self.type, "props": props}

    @classmethod
    def from_dict(cls, data: Mapping) -> "Chart":
        kind, props = data.get("type"), data.get("props") or {}
        if kind not in CHART_TYPES:
            raise ValueError(f"unknown chart type {kind!r}")
        names = _STORED.get(kind, {})
        roles = {}
        for role in _ROLES:
            stored = props.get(names.get(role, role))
            if isinstance(stored, Mapping):
                roles[role] = Field.from_dict(stored)
        return cls(kind, query_from_dict(props.get("sql")), **roles,
                   fill_step=props.get("fillStep") or None, limit=int(props.get("limit") or 0),
                   y_bin=props.get("yBucketSize") or None)


def value_bin(y: Field, size: float, name: str = "y_bin") -> Field:
    """The heatmap cell of a value, by its upper end: (y - size, y]."""
    return Field(f"ceil(({y.definition}) / {size!r}) * {size!r}", name)


def run_chart(text: str | Mapping, ctx: RunContext) -> Compiled:
    """Run a stored chart; an incomplete one raises ``ValueError``."""
    return Chart.from_dict(json.loads(text) if isinstance(text, str) else text).run(ctx)


@dataclass(frozen=True)
class DashboardResult:
    title: str
    charts: Mapping[str, Compiled]
    notes: tuple[str, ...]


def _walk(widgets, path: str = ""):
    for i, widget in enumerate(widgets):
        here = f"{path}{i}"
        kind, props = widget.get("type"), widget.get("props") or {}
        if kind in CONTAINER_TYPES:
            children = props.get(CONTAINER_TYPES[kind]) or ()
            if isinstance(children, Mapping):
                children = list(children.values())
            yield from _walk(children, f"{here}.")
        else:
            yield here, kind, widget


def default_params(widgets) -> dict[str, str]:
    """Start values of parameter widgets: JSON array text or plain text."""
    out = {}
    for _, kind, widget in _walk(widgets):
        props = widget.get("props") or {}
        if kind == "checkboxGroup":
            out[props["name"]] = json.dumps(list(props.get("defaults") or ()))
        elif kind == "textInput":
            text = props.get("defaultValue") or props.get("default") or ""
            out[props["name"]] = ("^" + text) if props.get("prependCaret") and text else text
    return out


def run_dashboard(text: str | Mapping, ctx: RunContext) -> DashboardResult:
    """Build every chart of a stored dashboard under one filter state.

    Charts that group one table are computed together, in one pass over it (see :func:`compile_together`); the
    others are lazy. Widgets that draw no data are skipped with a note.
    """
    data = json.loads(text) if isinstance(text, str) else text
    widgets = data.get("widgets") or ()
    ctx = replace(ctx, params={**default_params(widgets), **ctx.params})
    queries, notes = {}, []
    for path, kind, widget in _walk(widgets):
        if kind in PARAMETER_TYPES:
            continue
        if kind not in CHART_TYPES:
            notes.append(f"widget {path}: type {kind!r} shows no query result, skipped")
            continue
        queries[f"{path}:{kind}"] = Chart.from_dict(widget).build()
    charts = dict(zip(queries, compile_together(list(queries.values()), ctx), strict=True))
    return DashboardResult(data.get("title") or "", charts, tuple(notes))


def auto_chart(table: str, df: DataFrame) -> Chart:
    """First sensible chart of a table: rows over time, else rows per category, else rows."""
    time_name, category = first_of_class(df, TEMPORAL), first_of_class(df, CATEGORICAL)
    if time_name:
        return Chart("timeBar", from_table(table), x=auto_bucket(time_name), y=count(),
                     fill=enum(category) if category else None)
    if category:
        return Chart("barVertical", from_table(table), x=enum(category), y=count())
    return Chart("table", from_table(table))


# -- what drawing adds to a result ------------------------------------------------

def rated(result: Compiled, y: str) -> DataFrame:
    """Bars of an automatically bucketed chart show rates per second."""
    if not result.bucket_ms:
        return result.df
    return result.df.withColumn(y, per_second(y, result.bucket_ms))


def stacked(chart: Chart, result: Compiled, order: str = "input", reverse: bool = False,
            expand: bool = False) -> DataFrame:
    """Bars stacked per bucket; ``result`` may be unordered."""
    facets = [f.alias for f in (chart.fx, chart.fy) if f]
    return stack_positions(result.df, chart.x.alias, chart.fill.alias, chart.y.alias, order, reverse, facets, expand)


def shares(chart: Chart, result: Compiled) -> DataFrame:
    """Each bar's part of its bucket; ``result`` may be unordered."""
    return share(result.df, chart.y.alias, [f.alias for f in (chart.x, chart.fx, chart.fy) if f])


def sorted_by_measure(chart: Chart, result: Compiled, reverse: bool = False) -> DataFrame:
    return order_categories(result.df, chart.x.alias, chart.y.alias, reverse)


def folded_stacks(df: DataFrame, stack: str, weight: str) -> DataFrame:
    """Flame-graph text: one ``stack count`` line per distinct stack."""
    totals = df.groupBy(F.col(quote(stack)).alias("stack")).agg(F.sum(quote(weight)).alias("n"))
    return totals.select(F.concat_ws(" ", F.col("stack"), F.col("n").cast("string")).alias("value"))

"""Time ranges and predicates.

Predicates are SQL text so that a filter state can be stored, shown and inserted
into query texts; applied to a DataFrame they sit directly on the scan, where
Spark pushes them into the file reader.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.functions.fields import quote
from bucketwise.functions.scalars import sql_string
from bucketwise.functions.schema import require_columns, time_column

# The preset ranges offered to users.
PRESETS = {
    "5m": timedelta(minutes=5),
    "15m": timedelta(minutes=15),
    "1h": timedelta(hours=1),
    "3h": timedelta(hours=3),
    "6h": timedelta(hours=6),
    "12h": timedelta(hours=12),
    "24h": timedelta(hours=24),
    "48h": timedelta(hours=48),
    "168h": timedelta(hours=168),
    "720h": timedelta(hours=720),
}
CUSTOM_FORMAT = "%Y-%m-%d %H:%M"

NO_FILTER = "1=1"


def as_utc(value: datetime) -> datetime:
    """Zone-less UTC; zone-less input is taken as UTC already."""
    if value.tzinfo is None:
        return value
    return value.astimezone(timezone.utc).replace(tzinfo=None)


def sql_literal(value) -> str:
    """A Python value as SQL literal text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ'{as_utc(value):%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE'{value:%Y-%m-%d}'"
    return sql_string(str(value))


@dataclass(frozen=True)
class ResolvedRange:
    """An absolute range in zone-less UTC; both ends belong to it."""

    start: datetime
    end: datetime

    @property
    def seconds(self) -> int:
        return int((self.end - self.start).total_seconds())

    @property
    def from_ms(self) -> int:
        return self._epoch(self.start) * 1000

    @property
    def to_ms(self) -> int:
        return self._epoch(self.end) * 1000

    @staticmethod
    def _epoch(value: datetime) -> int:
        return int(value.replace(tzinfo=timezone.utc).timestamp())

    def clause(self, ts: str) -> str:
        return f"{quote(ts)} >= {sql_literal(self.start)} AND {quote(ts)} <= {sql_literal(self.end)}"

    def bind(self) -> dict[str, int]:
        """Values query texts may refer to as ``:__from`` and ``:__to`` (seconds)."""
        return {"__from": self.from_ms // 1000, "__to": self.to_ms // 1000}


@dataclass(frozen=True)
class TimeRange:
    """A preset name, a custom range text, or absolute ends."""

    preset: str | None = None
    custom: str | None = None
    start: datetime | None = None
    end: datetime | None = None

    def resolve(self, now: datetime, zone: str = "UTC") -> ResolvedRange:
        if self.preset is not None:
            if self.preset not in PRESETS:
                raise ValueError(f"unknown time range {self.preset!r}; known: {list(PRESETS)}")
            end = as_utc(now)
            return ResolvedRange(end - PRESETS[self.preset], end)
        if self.custom is not None:
            parts = self.custom.split(" to ")
            if len(parts) != 2:
                raise ValueError(f"custom range must read 'FROM to TO': {self.custom!r}")
            ends = [datetime.strptime(p.strip(), CUSTOM_FORMAT).replace(tzinfo=ZoneInfo(zone)) for p in parts]
            return ResolvedRange(*[as_utc(e) for e in ends])
        if self.start is not None and self.end is not None:
            return ResolvedRange(as_utc(self.start), as_utc(self.end))
        raise ValueError("no time range given")

    def to_dict(self) -> dict:
        if self.preset:
            return {"timeRange": self.preset}
        if self.custom:
            return {"timeRange": "custom", "customTimeRange": self.custom}
        if self.start and self.end:
            return {"from": self.start.isoformat(), "to": self.end.isoformat()}
        return {}

    @classmethod
    def from_dict(cls, data: Mapping) -> "TimeRange | None":
        name = data.get("timeRange")
        if name == "custom":
            return cls(custom=data["customTimeRange"])
        if name:
            return cls(preset=name)
        if data.get("from") and data.get("to"):
            return cls(start=datetime.fromisoformat(data["from"]), end=datetime.fromisoformat(data["to"]))
        return None


@dataclass(frozen=True)
class FilterState:
    """What the user selected: a time range and any number of predicates."""

    time_range: TimeRange | None = None
    where: tuple[str, ...] = ()

    def add(self, part: str) -> "FilterState":
        return replace(self, where=(*self.where, part))

    def resolve(self, now: datetime, zone: str = "UTC") -> ResolvedRange | None:
        return self.time_range.resolve(now, zone) if self.time_range else None

    def clauses(self, ts: str, now: datetime, zone: str = "UTC") -> tuple[str, ...]:
        span = self.resolve(now, zone)
        return ((span.clause(ts),) if span else ()) + self.where

    def apply(self, df: DataFrame, ts: str, now: datetime, zone: str = "UTC") -> DataFrame:
        return where_all(df, self.clauses(ts, now, zone))

    def to_dict(self) -> dict:
        return {**(self.time_range.to_dict() if self.time_range else {}), "where": list(self.where)}

    @classmethod
    def from_dict(cls, data: Mapping) -> "FilterState":
        return cls(TimeRange.from_dict(data), tuple(data.get("where") or ()))


def join_clauses(clauses: Iterable[str]) -> str:
    """AND of parenthesised clauses; a tautology when there are none."""
    parts = [f"({c})" for c in clauses]
    return " AND ".join(parts) if parts else NO_FILTER


def where_all(df: DataFrame, clauses: Iterable[str]) -> DataFrame:
    clauses = list(clauses)
    return df.where(F.expr(join_clauses(clauses))) if clauses else df


# -- predicates built from a clicked value --------------------------------------

def equals(name: str, value) -> str:
    return f"{quote(name)} = {sql_literal(value)}"


def differs(name: str, value) -> str:
    return f"{quote(name)} != {sql_literal(value)}"


def contains(name: str, value: str) -> str:
    return f"contains(CAST({quote(name)} AS STRING), {sql_literal(str(value))})"


def around(name: str, value: datetime, margin: timedelta) -> str:
    """Time within ``margin`` of a value, both ends included."""
    return f"{quote(name)} BETWEEN {sql_literal(value - margin)} AND {sql_literal(value + margin)}"


@dataclass(frozen=True)
class PredicateTemplate:
    """A named predicate; ``...`` stands for one value asked from the user."""

    title: str
    part: str

    @property
    def needs_value(self) -> bool:
        return "..." in self.part

    def bind(self, value=None) -> str:
        if not self.needs_value:
            return self.part
        if value is None:
            raise ValueError(f"{self.title!r} needs a value")
        text = str(value)
        inside_quotes = self.part.count("'", 0, self.part.index("...")) % 2 == 1
        return self.part.replace("...", sql_string(text)[1:-1] if inside_quotes else sql_literal(value))


def any_selected(column: Column | str, chosen: str | Iterable[str]) -> Column:
    """Membership in a list of options, given as list or JSON array text."""
    options = json.loads(chosen) if isinstance(chosen, str) else list(chosen)
    col = F.col(column) if isinstance(column, str) else column
    return col.isin(*options) if options else F.lit(False)


def starts_with_pattern(column: Column | str, pattern: str) -> Column:
    """Anchored regular expression; an empty pattern matches every row."""
    col = F.col(column) if isinstance(column, str) else column
    return col.rlike("^" + pattern) if pattern else F.lit(True)


def search_columns(df: DataFrame, term: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows whose column texts, joined by spaces, hold ``term``; case is ignored."""
    if not term:
        return df
    names = list(columns) if columns is not None else df.columns
    text = F.concat_ws(" ", *[F.col(quote(n)).cast("string") for n in names])
    return df.where(F.lower(text).contains(term.lower()))


def search_each(df: DataFrame, terms: Mapping[str, str]) -> DataFrame:
    """Rows where every named column holds its own term, ignoring case."""
    require_columns(df, terms)
    for name, term in terms.items():
        if term:
            df = df.where(F.lower(F.col(quote(name)).cast("string")).contains(term.lower()))
    return df


def recent(df: DataFrame, span: timedelta, now: datetime, ts: str | None = None,
           where: str | None = None) -> DataFrame:
    """Bound a scan: an explicit predicate wins, else rows newer than ``now - span``."""
    if where:
        return df.where(F.expr(f"({where})"))
    name = time_column(df, ts)
    if name is None:
        return df
    return df.where(F.expr(f"{quote(name)} > {sql_literal(as_utc(now) - span)}"))


def matching_dims(df: DataFrame, tuples: DataFrame, dims: Iterable[str]) -> DataFrame:
    """Rows whose dimension values occur in ``tuples``; NULL matches NULL."""
    dims = list(dims)
    wanted = tuples.select(*[F.col(quote(d)).alias(f"_{i}") for i, d in enumerate(dims)])
    on = [df[d].eqNullSafe(wanted[f"_{i}"]) for i, d in enumerate(dims)]
    return df.join(wanted, on, "left_semi")


def filtered_views(spark: SparkSession, tables: Mapping[str, DataFrame], predicate: str) -> list[str]:
    """Put one predicate on several tables and register each under its name."""
    for name, df in tables.items():
        where_all(df, [predicate] if predicate else []).createOrReplaceTempView(name)
    return list(tables)

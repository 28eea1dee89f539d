"""Alert definitions: read from files, kept as plain data, turned into rows."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field as dc_field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from bucketwise.alerting.ticks import parse_cron
from bucketwise.functions.buckets import Width
from bucketwise.functions.fields import quote
from bucketwise.operators.filters import NO_FILTER, sql_literal
from bucketwise.sources.sqltext import FILTERS_TOKEN
from bucketwise.sources.tables import local_rows

# Markers in alert query texts.
BUCKET_HEADER = "--BUCKET:"
HAVING_MARK = "--HAVING--"
BUCKET_MARK = "--BUCKET--"
HEADER_LINES = 3

_HEADER = re.compile(r"^(?P<width>.+?)(?:\s+lag\s+(?P<lag>\d+))?(?:\s+back\s+(?P<back>.+))?$", re.IGNORECASE)

DEFINITION_SCHEMA = (
    "alert_id_group string, alert_id_key string, width_s long, offset_s long, delay_s long, "
    "value_gt double, value_lt double, alert_message string, check_every string"
)


@dataclass(frozen=True)
class AlertId:
    group: str
    key: str

    def __str__(self) -> str:
        return f"{self.group}#{self.key}"

    @classmethod
    def parse(cls, text: str) -> "AlertId":
        group, mark, key = text.partition("#")
        if not mark:
            raise ValueError(f"not an alert id: {text!r}")
        return cls(group, key)


@dataclass(frozen=True)
class AlertDefinition:
    """A metric per time bucket, compared with a threshold at every tick.

    ``lag=0`` looks at the running bucket (counts only grow), ``lag=1`` at the last
    full one (averages may still move). ``back`` seconds more are taken off the clock
    first, for data that comes late.
    """

    id: AlertId
    width: Width
    lag: int = 0
    query: str | None = None
    params: Mapping[str, object] = dc_field(default_factory=dict)
    value_gt: float | None = None
    value_lt: float | None = None
    message: str = ""
    check_every: str = "@15minutes"
    # Time column behind ``{{FILTERS}}`` in the query text; bounds the scan.
    ts: str | None = None
    back: int = 0

    @property
    def delay(self) -> int:
        """Seconds by which the clock is set back before the bucket is looked up."""
        return self.lag * self.width.seconds + self.back

    @property
    def thresholds(self) -> dict[str, float]:
        both = {"value_gt": self.value_gt, "value_lt": self.value_lt}
        return {k: v for k, v in both.items() if v is not None}

    def row(self) -> tuple:
        return (self.id.group, self.id.key, self.width.seconds, self.width.offset_seconds, self.delay,
                self.value_gt, self.value_lt, self.message, self.check_every)

    def batch_sql(self, span: tuple[datetime, datetime] | None = None) -> str:
        """Text over all buckets, or those of a time span; the marker stays a comment."""
        return _terminated(self.query.replace(FILTERS_TOKEN, self._bounds(span)))

    def live_sql(self, bucket_ts: int) -> str:
        """Text restricted to one bucket; only that bucket's rows are read."""
        start = datetime(1970, 1, 1) + timedelta(seconds=bucket_ts)
        bounds = self._bounds((start, start + timedelta(seconds=self.width.seconds)))
        text = self.query.replace(HAVING_MARK, "HAVING").replace(BUCKET_MARK, str(bucket_ts))
        return _terminated(text.replace(FILTERS_TOKEN, bounds))

    def _bounds(self, span: tuple[datetime, datetime] | None) -> str:
        if span is None or self.ts is None:
            return NO_FILTER
        start, end = (sql_literal(s) for s in span)
        return f"({quote(self.ts)} >= {start} AND {quote(self.ts)} < {end})"


def _terminated(text: str) -> str:
    return text.rstrip().rstrip(";")


def bucket_header(text: str) -> tuple[Width, int, int]:
    """Width, lag and seconds back from ``--BUCKET: 15 minutes [lag 1] [back 20 minutes]`` in the first lines."""
    for line in text.splitlines()[:HEADER_LINES]:
        _, mark, rest = line.partition(BUCKET_HEADER)
        if mark:
            found = _HEADER.match(rest.strip())
            width, back = Width.parse(found.group("width")), Width.parse(found.group("back")) if found.group("back") else Width(0)
            if width.seconds is None or back.seconds is None:
                raise ValueError(f"alerts need buckets and offsets of a fixed length: {line.strip()!r}")
            return width, int(found.group("lag") or 0), back.seconds
    raise ValueError(f"{BUCKET_HEADER} ... not found in the first {HEADER_LINES} lines")


def _parse(text: str, path: str) -> Mapping:
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise ValueError(f"{path}: YAML support is not installed; use JSON") from missing
    return yaml.safe_load(text) or {}


def parse_definitions(path: str) -> list[AlertDefinition]:
    """Read one alert file and the query texts it points to."""
    with open(path, encoding="utf-8") as handle:
        config = _parse(handle.read(), path)
    out = []
    for key, body in (config.get("alerts") or {}).items():
        if not body.get("query_path"):
            raise ValueError(f"{key}: no query path defined")
        query_path = posixpath.normpath(posixpath.join(posixpath.dirname(path), body["query_path"]))
        try:
            with open(query_path, encoding="utf-8") as handle:
                query = handle.read()
        except OSError as error:
            raise ValueError(f"{key}: reading {query_path}: {error}") from error
        try:
            width, lag, back = bucket_header(query)
        except ValueError as error:
            raise ValueError(f"{key}: {query_path}: {error}") from error
        check_every = body.get("check_every") or "@15minutes"
        parse_cron(check_every)
        condition = body.get("alert_if") or {}
        out.append(AlertDefinition(
            AlertId(path, key), width, lag, query, dict(body.get("params") or {}),
            _number(condition.get("value_gt")), _number(condition.get("value_lt")),
            body.get("message") or "", check_every, body.get("time_column"), back))
    return out


def discover(paths: Iterable[str]) -> list[AlertDefinition]:
    return [d for path in paths for d in parse_definitions(path)]


def _number(value) -> float | None:
    return None if value is None else float(value)


def definitions_df(spark: SparkSession, definitions: Iterable[AlertDefinition]) -> DataFrame:
    """Definitions as rows; a local relation whose size Spark knows."""
    return local_rows(spark, [d.row() for d in definitions], DEFINITION_SCHEMA)

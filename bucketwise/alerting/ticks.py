"""Execution times of alerts, generated as rows from cron expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.operators.filters import as_utc

# Named schedules.
ALIASES = {
    "@always": "* * * * *",
    "@5minutes": "*/5 * * * *",
    "@10minutes": "*/10 * * * *",
    "@15minutes": "*/15 * * * *",
    "@30minutes": "0,30 * * * *",
    "@hourly": "0 * * * *",
    "@daily": "0 0 * * *",
    "@weekly": "0 0 * * 0",
    "@monthly": "0 0 1 * *",
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
}
_LIMITS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
# Names of months and weekdays.
_NAMES = {"month": "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), "weekday": "SUN MON TUE WED THU FRI SAT".split()}
_PART = re.compile(r"^(\*|\d+)(?:-(\d+))?(?:/(\d+))?$")


@dataclass(frozen=True)
class Cron:
    """Allowed values per calendar field; None means every value."""

    minute: frozenset[int] | None
    hour: frozenset[int] | None
    day: frozenset[int] | None
    month: frozenset[int] | None
    weekday: frozenset[int] | None

    def matches(self, t: Column) -> Column:
        among = lambda part, allowed: None if allowed is None else part.isin(*sorted(allowed))
        day = among(F.dayofmonth(t), self.day)
        weekday = among(F.dayofweek(t) - 1, self.weekday)
        # A restricted day of month and weekday are alternatives, as usual in cron.
        either = day | weekday if day is not None and weekday is not None else (day if weekday is None else weekday)
        parts = [among(F.minute(t), self.minute), among(F.hour(t), self.hour), among(F.month(t), self.month), either]
        return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def _numbered(text: str, field: str, low: int) -> str:
    """Month and weekday names (any case) as numbers; a last day SUN of a range is 7."""
    for i, name in enumerate(_NAMES.get(field, ())):
        text = re.sub(rf"(?i)(?<=-){name}(?![a-z])", str(i + low or 7), text)
        text = re.sub(rf"(?i)(?<![a-z]){name}(?![a-z])", str(i + low), text)
    return text


def parse_cron(expression: str) -> Cron:
    fields = ALIASES.get(expression.strip(), expression).split()
    if len(fields) != len(_LIMITS):
        raise ValueError(f"not a cron expression: {expression!r}")
    parsed = {}
    for text, (name, (low, high)) in zip(fields, _LIMITS.items()):
        values: set[int] = set()
        text = "*" if text == "?" and name in ("day", "weekday") else _numbered(text, name, low)
        for part in text.split(","):
            found = _PART.match(part)
            if not found:
                raise ValueError(f"not a cron expression: {expression!r} (field {name})")
            head, upper, step = found.groups()
            first = low if head == "*" else int(head)
            last = high if head == "*" or (step and not upper) else first
            last = int(upper) if upper else last
            if not (low <= first <= last <= high) or (step and int(step) == 0):
                raise ValueError(f"cron value out of range: {expression!r} (field {name})")
            values.update(range(first, last + 1, int(step or 1)))
        if name == "weekday":
            values = {v % 7 for v in values}
        parsed[name] = None if text == "*" else frozenset(values)
    return Cron(**parsed)


def to_epoch(value: datetime) -> int:
    return int(as_utc(value).replace(tzinfo=timezone.utc).timestamp())


def ticks(spark: SparkSession, schedules: Iterable[str], start: datetime, end: datetime) -> DataFrame:
    """Rows (check_every, tick) with every execution in (start, end], in epoch seconds.

    The minutes of the range are generated in parallel and tested against every
    distinct schedule in one pass.
    """
    schedules = list(dict.fromkeys(schedules))
    crons = {s: parse_cron(s) for s in schedules}
    first = (to_epoch(start) // 60 + 1) * 60
    minutes = spark.range(first, to_epoch(end) + 1, 60) if schedules else spark.range(0)
    t = F.timestamp_seconds(F.col("id"))
    due = F.array_compact(F.array(*[F.when(c.matches(t), F.lit(s)) for s, c in crons.items()])) \
        if schedules else F.expr("CAST(array() AS ARRAY<STRING>)")
    return minutes.select(F.explode(due).alias("check_every"), F.col("id").alias("tick"))

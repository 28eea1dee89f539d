"""Time buckets: fixed widths, calendar units and automatic granularity."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bucketwise.functions.scalars import sql_string

# Granularity rungs in seconds, finest first, and the most buckets a
# series may have (a month of hours, plus one).
LADDER_SECONDS = (1, 60, 300, 900, 3600, 86400, 604800)
MAX_BUCKETS = 721
DEFAULT_BUCKET_SECONDS = 900

WEEK_SECONDS = 604800
# 1970-01-01 is a Thursday; weeks start on Sunday, three days later.
WEEK_OFFSET_SECONDS = 3 * 86400

DAY_SECONDS = 86400
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": DAY_SECONDS, "week": WEEK_SECONDS}
CALENDAR_MONTHS = {"month": 1, "quarter": 3, "year": 12}
# Several months or quarters are counted from January 1900, several years from year 0.
MONTHS_ORIGIN, YEARS_ORIGIN = 1900 * 12, 0

_WIDTH = re.compile(r"^\s*(\d+)?\s*([A-Za-z]+?)s?\s*$")


@dataclass(frozen=True)
class Width:
    """A bucket width: a number of fixed-length units, or of calendar months.

    ``origin`` is the number (12 a year) of a month with which a bucket begins.
    """

    seconds: int | None
    months: int | None = None
    origin: int = MONTHS_ORIGIN

    @classmethod
    def parse(cls, value: "int | str | Width") -> "Width":
        if isinstance(value, Width):
            return value
        if isinstance(value, int):
            if value <= 0:
                raise ValueError(f"bucket width must be positive: {value}")
            return cls(value)
        match = _WIDTH.match(value)
        if not match:
            raise ValueError(f"not a bucket width: {value!r}")
        count, unit = int(match.group(1) or 1), match.group(2).lower()
        if unit in UNIT_SECONDS and count > 0:
            return cls(count * UNIT_SECONDS[unit])
        if unit in CALENDAR_MONTHS and count > 0:
            return cls(None, count * CALENDAR_MONTHS[unit], YEARS_ORIGIN if unit == "year" else MONTHS_ORIGIN)
        raise ValueError(f"not a bucket width: {value!r}")

    @property
    def offset_seconds(self) -> int:
        """Where bucket zero starts, relative to the epoch."""
        if self.seconds and self.seconds % WEEK_SECONDS == 0:
            return WEEK_OFFSET_SECONDS
        return 0

    @property
    def ms(self) -> int | None:
        return self.seconds * 1000 if self.seconds else None


def pick_width(range_seconds: int) -> int:
    """Finest rung that needs at most ``MAX_BUCKETS`` buckets, else the coarsest."""
    fitting = (s for s in LADDER_SECONDS if range_seconds // s <= MAX_BUCKETS)
    return next(fitting, LADDER_SECONDS[-1])


def bucket(ts: Column | str, width: int | str | Width, zone: str | None = None) -> Column:
    """Start of the bucket holding ``ts``, in the column's own type.

    Fixed widths use the native tumbling window and stay inside generated code (only one such bucket may appear per
    projection). Calendar widths begin with the first day of a month. With a ``zone``, months, days and weeks are those of its
    clocks: a day has 23 or 25 hours where clocks change, and begins with its first instant where midnight is left out, or
    with the earlier one where it comes twice. Shorter widths are the same instants everywhere. Columns
    without a zone hold UTC, and so does the session.
    """
    w = Width.parse(width)
    col = F.col(ts) if isinstance(ts, str) else ts
    if w.months is None and not (zone and w.seconds % DAY_SECONDS == 0):
        every = f"{w.seconds} seconds"
        if w.offset_seconds:
            return F.window(col, every, every, f"{w.offset_seconds} seconds").getField("start")
        return F.window(col, every).getField("start")
    local = F.from_utc_timestamp(col, zone) if zone else col
    if w.months:
        number = F.year(local) * 12 + F.month(local) - 1 - w.origin
        first = number - F.pmod(number, F.lit(w.months)) + w.origin
        start = F.make_date(F.floor(first / 12).cast("int"), F.pmod(first, F.lit(12)) + 1, F.lit(1))
    else:
        days, offset = w.seconds // DAY_SECONDS, w.offset_seconds // DAY_SECONDS
        number = F.unix_date(local.cast("date")) - offset
        start = F.date_from_unix_date(number - F.pmod(number, F.lit(days)) + offset)
    if zone:
        start = F.to_utc_timestamp(start, zone)
    return col - (col - start)  # keeps the type


def bucket_sql(expression: str, width: int | str | Width, zone: str | None = None) -> str:
    """SQL text of :func:`bucket`, for query texts."""
    w = Width.parse(width)
    if w.months is None and not (zone and w.seconds % DAY_SECONDS == 0):
        every = f"'{w.seconds} seconds'"
        if w.offset_seconds:
            return f"window({expression}, {every}, {every}, '{w.offset_seconds} seconds').start"
        return f"window({expression}, {every}).start"
    local = f"from_utc_timestamp({expression}, {sql_string(zone)})" if zone else f"({expression})"
    if w.months:
        number = f"(year({local}) * 12 + month({local}) - 1 - {w.origin})"
        first = f"({number} - pmod({number}, {w.months}) + {w.origin})"
        start = f"make_date(CAST(floor({first} / 12) AS INT), pmod({first}, 12) + 1, 1)"
    else:
        days, offset = w.seconds // DAY_SECONDS, w.offset_seconds // DAY_SECONDS
        number = f"(unix_date(CAST({local} AS DATE)) - {offset})"
        start = f"date_from_unix_date({number} - pmod({number}, {days}) + {offset})"
    if zone:
        start = f"to_utc_timestamp({start}, {sql_string(zone)})"
    return f"(({expression}) - (({expression}) - {start}))"


def epoch_bucket(seconds: Column | str, width: int | str | Width, lag: int = 0) -> Column:
    """Bucket start in epoch seconds of an instant given in epoch seconds.

    ``lag=1`` yields the last full bucket instead of the running one.
    """
    w = Width.parse(width)
    if w.months:
        raise ValueError("epoch buckets need a fixed width")
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    moved = s.cast("long") - F.lit(w.offset_seconds + lag * w.seconds).cast("long")
    return moved - F.pmod(moved, F.lit(w.seconds).cast("long")) + F.lit(w.offset_seconds).cast("long")


def per_second(value: Column | str, bucket_ms: int) -> Column:
    """Rate per second of a per-bucket measure."""
    v = F.col(value) if isinstance(value, str) else value
    return v / F.lit(bucket_ms) * F.lit(1000)


def epoch_seconds(ts: Column | str) -> Column:
    """Whole epoch seconds of a timestamp (session zone UTC for zone-less input)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_timestamp(col.cast("timestamp"))


def from_epoch_seconds(seconds: Column | str, dtype: str = "timestamp_ntz") -> Column:
    col = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.timestamp_seconds(col).cast(dtype)

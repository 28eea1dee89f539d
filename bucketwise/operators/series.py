"""Work on chart results: gap fill, shares, stacking and category order.

These run on aggregated rows. A window's group is one series (at most one row per bucket of
the time range). What goes over a bucket, or over all rows, is split: totals are joined, running sums and
the neighbours of a row come from sorted partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.functions.buckets import Width
from bucketwise.functions.fields import quote
from bucketwise.operators.filters import as_utc, sql_literal
from bucketwise.operators.order import running_sums, sorted_with_position
from bucketwise.sources.tables import local_rows

# Points generated per array; longer gaps become several arrays.
CHUNK = 4096

_INTERVAL_CALL = re.compile(r"^\s*toInterval([A-Za-z]+)\(\s*(\d+)\s*\)\s*$")


def parse_step(step: int | str | Width) -> Width:
    """A step such as ``'1 hour'``, a number of seconds, or ``toIntervalHour(1)``."""
    if isinstance(step, str):
        match = _INTERVAL_CALL.match(step)
        if match:
            return Width.parse(f"{match.group(2)} {match.group(1)}")
    return Width.parse(step)


def gap_fill(df: DataFrame, t: str, step: int | str | Width, series: Sequence[str] = (),
             fill: float | None = 0, bounds: tuple[datetime, datetime] | None = None, split: bool | None = None) -> DataFrame:
    """Add the missing steps of every series between its first and last row.

    Numeric columns of added rows get ``fill``, text columns ``''``, others NULL. Every given row is kept. With
    ``bounds`` each series covers that range instead. Steps of months are counted from the row before the gap, so
    the last day of a month stays the last day at most. Each row looks at its successor and emits the steps in between.

    With ``split`` (the default where there are no series) the rows are sorted over range partitions and checkpointed
    once; a partition learns from a list of edges, one row a partition and series, which row follows its last one.
    Otherwise a series is sorted in one task.
    """
    width = parse_step(step)
    keys = [F.col(quote(s)) for s in series]
    tcol = F.col(quote(t))
    split = not series if split is None else split
    work = _with_neighbours(df, t, series) if split else _with_window(df, t, keys)

    low, high = (F.expr(sql_literal(as_utc(b))) for b in bounds) if bounds else (None, None)
    if width.months:
        def moved(k: Column) -> Column:
            return tcol + F.make_ym_interval(months=(k * F.lit(width.months)).cast("int"))

        def most(a: Column, b: Column, fits: Callable[[Column], Column]) -> Column:
            """The largest number of steps that fits; months of different lengths make the estimate one off at most."""
            k = F.floor(F.timestamp_diff("MONTH", a, b) / F.lit(width.months)).cast("long")
            return k - 1 + fits(k).cast("long") + fits(k + 1).cast("long")

        ahead = most(tcol, F.col("__next"), lambda k: moved(k) < F.col("__next")) + 1
        until_end = most(tcol, high, lambda k: moved(k) <= high) + 1 if bounds else None
        from_start = most(low, tcol, lambda k: moved(-k) >= low) if bounds else None
    else:
        def moved(k: Column) -> Column:
            return tcol + F.make_dt_interval(secs=k * F.lit(width.seconds))

        def passed(a: Column, b: Column) -> Column:
            return F.timestamp_diff("SECOND", a, b) / F.lit(width.seconds)

        ahead = F.ceil(passed(tcol, F.col("__next"))).cast("long")
        until_end = F.floor(passed(tcol, high)).cast("long") + 1 if bounds else None
        from_start = F.floor(passed(low, tcol)).cast("long") if bounds else None
    behind = F.lit(0).cast("long")
    if bounds:
        ahead = F.coalesce(ahead, until_end)
        behind = F.when(F.col("__first"), F.greatest(from_start, F.lit(0).cast("long"))).otherwise(behind)
    steps = F.greatest(F.coalesce(ahead, F.lit(1).cast("long")), F.lit(1).cast("long"))

    first, last = -F.col("__behind"), F.col("__steps") - 1
    chunk = F.lit(CHUNK).cast("long")
    work = (
        work.withColumn("__behind", behind).withColumn("__steps", steps)
        .withColumn("__chunk", F.explode(F.sequence(first, last, chunk)))
        .withColumn("__k", F.explode(F.sequence(
            F.col("__chunk"), F.least(F.col("__chunk") + chunk - 1, last))))
    )
    given = F.col("__k") == 0
    out = []
    for f in df.schema.fields:
        col = F.col(quote(f.name))
        if f.name == t:
            out.append(moved(F.col("__k")).cast(f.dataType).alias(t))
        elif f.name in series:
            out.append(col)
        else:
            out.append(F.when(given, col).otherwise(_default(f.dataType, fill)).alias(f.name))
    return work.select(*out)


def _with_window(df: DataFrame, t: str, keys: Sequence[Column]) -> DataFrame:
    """``__next`` and ``__first`` from a window over each series."""
    order = Window.partitionBy(*keys).orderBy(F.col(quote(t)))
    return df.withColumn("__next", F.lead(F.col(quote(t))).over(order)).withColumn("__first", F.lag(F.lit(1)).over(order).isNull())


def _with_neighbours(df: DataFrame, t: str, series: Sequence[str]) -> DataFrame:
    """``__next`` and ``__first`` from sorted partitions and their edges."""
    keys = [F.col(quote(s)) for s in series]
    rows = sorted_with_position(df, [*[k.asc_nulls_first() for k in keys], F.col(quote(t)).asc_nulls_first()])
    edges = rows.groupBy("__part", *keys).agg(F.min(quote(t)).alias("__begin"))
    if series:
        over = Window.partitionBy(*keys).orderBy("__part")
        edges = edges.select(F.col("__part").alias("__p"), *[k.alias(f"__s{i}") for i, k in enumerate(keys)],
                             F.lead("__begin").over(over).alias("__after"), F.lag(F.lit(1)).over(over).isNull().alias("__new"))
    else:  # one row a partition
        found = sorted((r["__part"], r["__begin"]) for r in edges.collect() if r["__begin"] is not None)
        listed = [(part, found[i + 1][1] if i + 1 < len(found) else None, i == 0) for i, (part, _) in enumerate(found)]
        edges = local_rows(df.sparkSession, listed, T.StructType([
            T.StructField("__p", T.LongType()), T.StructField("__after", df.schema[t].dataType), T.StructField("__new", T.BooleanType())]))
    on = [F.col("__part") == F.col("__p")] + [k.eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    inside = Window.partitionBy("__part", *keys).orderBy("__pos")
    return (rows.join(edges, on, "left")
            .withColumn("__next", F.coalesce(F.lead(F.col(quote(t))).over(inside), F.col("__after")))
            .withColumn("__first", F.lag(F.lit(1)).over(inside).isNull() & F.coalesce("__new", F.lit(True))))


def _default(dtype: T.DataType, fill: float | None) -> Column:
    if isinstance(dtype, T.NumericType) and fill is not None:
        return F.lit(fill).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    return F.lit(None).cast(dtype)


def share(df: DataFrame, y: str, by: Sequence[str], name: str = "share") -> DataFrame:
    """Part of the bucket's total; a bucket whose total is zero has no share.

    Totals are summed before the shuffle and joined by bucket, so that a bucket may have any number of series.
    """
    out = _with_totals(df, y, by, "__total")
    return out.withColumn(name, F.when(F.col("__total") != 0, F.col(quote(y)) / F.col("__total"))).drop("__total")


def _with_totals(df: DataFrame, y: str, by: Sequence[str], name: str) -> DataFrame:
    names = [f"__b{i}" for i in range(len(by))]
    totals = df.groupBy(*[F.col(quote(b)).alias(n) for b, n in zip(by, names, strict=True)]).agg(F.sum(quote(y)).alias(name))
    on = [F.col(quote(b)).eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)]
    return df.join(totals, on, "left").drop(*names) if by else df.join(totals, how="left")


STACK_ORDERS = ("input", "value", "sum", "appearance")


def stack_positions(df: DataFrame, x: str, series: str, y: str, order: str = "input",
                    reverse: bool = False, facets: Sequence[str] = (), expand: bool = False) -> DataFrame:
    """Lower and upper end (``y1``, ``y2``) of each series stacked per bucket.

    A bucket may have any number of series: its running sum is made over sorted partitions (``order.running_sums``).
    """
    if order not in STACK_ORDERS:
        raise ValueError(f"unknown stack order {order!r}; known: {STACK_ORDERS}")
    per_series = Window.partitionBy(*[F.col(quote(c)) for c in (*facets, series)])
    value = F.col(quote(y))
    if order == "sum":
        df = df.withColumn("__rank", F.sum(value).over(per_series))
    elif order == "value":
        df = df.withColumn("__rank", value)
    elif order == "appearance":
        df = df.withColumn("__top", F.max(value).over(per_series))
        at_top = F.when(value == F.col("__top"), F.col(quote(x)))
        df = df.withColumn("__rank", F.min(at_top).over(per_series)).drop("__top")
    else:
        df = df.withColumn("__rank", F.lit(0))
    cell = (*facets, x)
    keys = [F.col("__rank"), F.col(quote(series))]
    ordered = [k.desc_nulls_first() for k in keys] if reverse else [k.asc_nulls_last() for k in keys]
    out = running_sums(df, y, cell, ordered, "y2").withColumn("y1", F.col("y2") - value)
    if expand:
        out = (_with_totals(out, y, cell, "__total")
               .withColumn("y1", F.when(F.col("__total") != 0, F.col("y1") / F.col("__total")))
               .withColumn("y2", F.when(F.col("__total") != 0, F.col("y2") / F.col("__total")))
               .drop("__total"))
    return out.drop("__rank")


def order_categories(df: DataFrame, category: str, y: str, reverse: bool = False,
                     name: str = "sort_value") -> DataFrame:
    """Sort categories by their largest measure; the sort value becomes a column."""
    top = F.max(quote(y)).over(Window.partitionBy(F.col(quote(category))))
    out = df.withColumn(name, top)
    key = F.col(name).desc_nulls_last() if reverse else F.col(name).asc_nulls_last()
    return out.orderBy(key, F.col(quote(category)).asc_nulls_last())


def value_bins(df: DataFrame, y: str, size: float, name: str = "y_bin") -> DataFrame:
    """Upper end of the heatmap cell (y - size, y] that holds a raw value."""
    return df.withColumn(name, F.ceil(F.col(quote(y)) / F.lit(size)) * F.lit(size))

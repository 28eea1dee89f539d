"""Threshold rules, live evaluation and replay over history."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.alerting.definitions import AlertDefinition, definitions_df
from bucketwise.alerting.ticks import ticks, to_epoch
from bucketwise.functions.buckets import Width, bucket, epoch_seconds
from bucketwise.functions.fields import quote
from bucketwise.functions.scalars import number_or_zero
from bucketwise.functions.schema import require_columns
from bucketwise.operators.filters import as_utc, join_clauses, sql_literal
from bucketwise.plans.spec import Compiled, RunContext
from bucketwise.sources.sqltext import FILTERS_TOKEN
from bucketwise.sources.tables import local_rows

# States and the texts of failed evaluations.
OK, WARN, ERROR = "OK", "warn", "error"
NO_CONDITION = "INTERNAL ERROR: no alert_if condition found."
TOO_MANY_ROWS = "QUERY ERROR: found %d result rows, but only 0 or 1 allowed"

ID = ("alert_id_group", "alert_id_key")


def threshold_state(rows: Column, value: Column, gt: Column, lt: Column) -> Column:
    """State of one evaluation: no row counts as value 0, several rows are an error.

    An upper threshold wins over a lower one; both are strict.
    """
    v = number_or_zero(F.when(rows == 1, value))
    return (
        F.when(gt.isNull() & lt.isNull(), F.lit(ERROR))
        .when(rows > 1, F.lit(ERROR))
        .when(gt.isNotNull(), F.when(v > gt, F.lit(ERROR)).otherwise(F.lit(OK)))
        .otherwise(F.when(v < lt, F.lit(ERROR)).otherwise(F.lit(OK)))
    )


def threshold_message(rows: Column, gt: Column, lt: Column, state: Column, text: Column) -> Column:
    return (
        F.when(gt.isNull() & lt.isNull(), F.lit(NO_CONDITION))
        .when(rows > 1, F.format_string(TOO_MANY_ROWS, rows))
        .when(state == ERROR, F.coalesce(text, F.lit("")))
        .otherwise(F.lit(""))
    )


def judge(df: DataFrame) -> DataFrame:
    """Add ``status`` and ``message`` to rows holding n_rows, value and thresholds.

    ``alert_if_value_gt`` and ``alert_if_value_lt`` columns, where present and not
    NULL, override the definition's thresholds row by row.
    """
    require_columns(df, ["n_rows", "value", "value_gt", "value_lt", "alert_message"])
    override = lambda name, own: (
        F.coalesce(F.col(name), F.col(own)) if name in df.columns else F.col(own))
    gt = override("alert_if_value_gt", "value_gt")
    lt = override("alert_if_value_lt", "value_lt")
    rows = F.coalesce(F.col("n_rows"), F.lit(0).cast("long"))
    out = df.withColumn("status", threshold_state(rows, F.col("value"), gt, lt))
    return out.withColumn("message", threshold_message(rows, gt, lt, F.col("status"), F.col("alert_message")))


_OVERRIDES = ("alert_if_value_gt", "alert_if_value_lt")


def bucket_rows(metrics: DataFrame, keys: Sequence[str] = (*ID, "time_ts")) -> DataFrame:
    """One row per alert and bucket with the number of metric rows found there."""
    extra = [F.max(c).alias(c) for c in _OVERRIDES if c in metrics.columns]
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("value").alias("value"), *extra)


# -- metrics ----------------------------------------------------------------------

def sql_metrics(spark: SparkSession, definitions: Iterable[AlertDefinition],
                span: tuple[datetime, datetime] | None = None) -> DataFrame:
    """Metric rows of alerts given as query texts, over all buckets or a time span; one query for each distinct text."""
    return _text_metrics(spark, [(d, d.batch_sql(span)) for d in definitions])


# A quoted text, a quoted name, a comment (all left alone), or a parameter marker.
_MARKER = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?<![:\w]):([A-Za-z_]\w*)", re.DOTALL)


def _markers(text: str) -> list[str]:
    return sorted({m.group(1) for m in _MARKER.finditer(text) if m.group(1)})


def _text_metrics(spark: SparkSession, texts: Sequence[tuple[AlertDefinition, str]]) -> DataFrame:
    """Metric rows of definitions and their final query texts.

    Alerts that share a text and differ in parameters are evaluated by one query: the parameters are the columns of a
    local table, which the text is joined with laterally. Spark turns that into a join, so the text's tables are
    read once. A text that can't be correlated (parameters inside a WITH clause) is run for each alert.
    """
    groups: dict[tuple, list[AlertDefinition]] = {}
    for d, text in texts:
        used = [(k, type(d.params[k])) for k in _markers(text) if k in d.params]
        groups.setdefault((text, tuple(used)), []).append(d)
    parts = []
    for (text, used), members in groups.items():
        joined = _joined_metric(spark, members, text, dict(used)) if len(members) > 1 else None
        parts += [joined] if joined is not None else [_metric(spark, d, text) for d in members]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


_KINDS = {str: "string", int: "bigint", float: "double", bool: "boolean"}


def _joined_metric(spark: SparkSession, definitions: Sequence[AlertDefinition], text: str, used: Mapping[str, type]) -> DataFrame | None:
    if any(kind not in _KINDS for kind in used.values()):
        return None
    columns = {name: f"__p{i}" for i, name in enumerate(used)}
    schema = ", ".join([f"{ID[0]} string", f"{ID[1]} string", *[f"{columns[n]} {_KINDS[k]}" for n, k in used.items()]])
    view = f"alert_parameters_{uuid.uuid4().hex}"
    local_rows(spark, [(d.id.group, d.id.key, *[d.params[n] for n in used]) for d in definitions], schema).createTempView(view)
    correlated = _MARKER.sub(lambda m: f"__a.{columns[m.group(1)]}" if m.group(1) in columns else m.group(0), text)
    try:
        found = spark.sql(f"SELECT __a.{ID[0]}, __a.{ID[1]}, __q.* FROM {view} __a, LATERAL (\n{correlated}\n) __q")
    except AnalysisException:
        return None
    finally:
        spark.catalog.dropTempView(view)
    return _typed(found)


def _metric(spark: SparkSession, definition: AlertDefinition, text: str) -> DataFrame:
    used = {k: definition.params[k] for k in _markers(text) if k in definition.params}
    df = spark.sql(text, args=used) if used else spark.sql(text)
    return _typed(df.select(F.lit(definition.id.group).alias(ID[0]), F.lit(definition.id.key).alias(ID[1]), "*"))


def _typed(df: DataFrame) -> DataFrame:
    require_columns(df, ["time_ts", "value"])
    names = ["value", *[c for c in _OVERRIDES if c in df.columns]]
    return df.select(*ID, F.col("time_ts").cast("long").alias("time_ts"), *[F.col(c).cast("double").alias(c) for c in names])


# Measures that can be put together from parts: the parts, and what becomes of them.
_MERGED = {
    "count": (("count",), lambda n: F.sum(n).cast("double")),
    "sum": (("sum",), lambda s: F.sum(s).cast("double")),
    "min": (("min",), lambda v: F.min(v).cast("double")),
    "max": (("max",), lambda v: F.max(v).cast("double")),
    "avg": (("sum", "count"), lambda s, n: (F.sum(s) / F.sum(n)).cast("double")),
}
_MEASURE = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*$", re.DOTALL)


def _parts_of(measure: str) -> tuple[list[str], Callable[..., Column]]:
    """SQL of the parts of a measure, and how they are merged."""
    match = _MEASURE.match(measure)
    kind, body = (match.group(1).lower(), match.group(2).strip()) if match else ("", "")
    depth = 0
    for char in body:
        depth += (char == "(") - (char == ")")
        if depth < 0:
            break
    if kind not in _MERGED or depth or re.match(r"distinct\b", body, re.IGNORECASE):
        raise ValueError(f"alerts of different bucket widths need one of {sorted(_MERGED)} of an expression, not {measure!r}")
    parts, merge = _MERGED[kind]
    return [f"{p}({body})" for p in parts], merge


def family_metrics(df: DataFrame, definitions: Sequence[AlertDefinition], ts: str,
                   params: Mapping[str, str], measure: str = "count(*)",
                   span: tuple[datetime, datetime] | None = None) -> DataFrame:
    """Metrics of many alerts that differ in parameters, thresholds and bucket widths only.

    ``params`` maps parameter names to columns. The table is read once for all of them and grouped by those
    columns; ``span`` bounds the scan. With several widths the rows are grouped by the greatest width that divides all of
    them, and the groups are put together for each width; that takes a count, sum, minimum, maximum or average.
    """
    spark = df.sparkSession
    if span:
        df = df.where(F.expr(f"{quote(ts)} >= {sql_literal(span[0])} AND {quote(ts)} < {sql_literal(span[1])}"))
    for param, column in params.items():
        # Text parameters also bound the scan; other types are matched after grouping.
        if isinstance(df.schema[column].dataType, T.StringType):
            df = df.where(F.col(quote(column)).isin(*sorted({str(d.params[param]) for d in definitions})))
    columns = list(params.values())
    names = [f"__p{i}" for i in range(len(columns))]
    widths = {d.width for d in definitions}
    one = len(widths) == 1
    base = next(iter(widths)) if one else Width(math.gcd(*[s for w in widths for s in (w.seconds, w.offset_seconds) if s]))
    parts, merge = ([measure], None) if one else _parts_of(measure)
    held = [f"__v{i}" for i in range(len(parts))]
    grouped = (
        df.withColumn("__bucket", bucket(ts, base))
        .groupBy("__bucket", *[F.col(quote(c)).cast("string").alias(n) for c, n in zip(columns, names)])
        .agg(*[F.expr(p).alias(h) for p, h in zip(parts, held, strict=True)])
        .select(epoch_seconds("__bucket").alias("time_ts"), *names, *held)
    )
    wanted = [(d.id.group, d.id.key, d.width.seconds, d.width.offset_seconds, *[str(d.params[p]) for p in params]) for d in definitions]
    kinds = ", ".join(["__w long", "__o long", *[f"{n} string" for n in names]])
    on = [*names, "__w"]
    if one:
        grouped = grouped.select(*names, F.lit(base.seconds).cast("long").alias("__w"), "time_ts", F.col(held[0]).cast("double").alias("value"))
    else:
        if names:
            wider = grouped.join(local_rows(spark, sorted({w[2:] for w in wanted}), kinds), names)
        else:
            each = [F.struct(F.lit(w.seconds).cast("long").alias("__w"), F.lit(w.offset_seconds).cast("long").alias("__o")) for w in widths]
            wider = grouped.select("*", F.inline(F.array(*each)))
        moved = F.col("time_ts") - F.col("__o")
        wider = wider.withColumn("time_ts", moved - F.pmod(moved, F.col("__w")) + F.col("__o"))
        grouped = wider.groupBy(*on, "time_ts").agg(merge(*[F.col(h) for h in held]).alias("value"))
    alerts = local_rows(spark, wanted, f"{ID[0]} string, {ID[1]} string, {kinds}")
    return grouped.join(alerts.drop("__o"), on).select(*ID, "time_ts", "value")


# -- evaluation ---------------------------------------------------------------------

def live_bucket(definition: AlertDefinition, now: datetime) -> int:
    """Epoch second of the bucket a definition looks at now."""
    width, offset = definition.width.seconds, definition.width.offset_seconds
    moved = to_epoch(now) - offset - definition.delay
    return moved - moved % width + offset


def live_span(definition: AlertDefinition, now: datetime) -> tuple[datetime, datetime]:
    """Time span of that bucket, to bound the scan of a metric."""
    start = datetime(1970, 1, 1) + timedelta(seconds=live_bucket(definition, now))
    return start, start + timedelta(seconds=definition.width.seconds)


def _stamped(df: DataFrame, tick: Column) -> DataFrame:
    return df.select(*ID, F.timestamp_seconds(tick).cast("timestamp_ntz").alias("timestamp"),
                     "status", "message", F.col("value").alias("value"))


def evaluate_live(spark: SparkSession, definitions: Sequence[AlertDefinition], now: datetime) -> DataFrame:
    """Evaluate query-text alerts at ``now``: one result row each, lazily; one query for each distinct text."""
    found = bucket_rows(_text_metrics(spark, [(d, d.live_sql(live_bucket(d, now))) for d in definitions]), ID)
    at = definitions_df(spark, definitions).join(found, list(ID), "left")
    return _stamped(judge(at), F.lit(to_epoch(now)))


def evaluate_family_live(df: DataFrame, definitions: Sequence[AlertDefinition], now: datetime, ts: str,
                         params: Mapping[str, str], measure: str = "count(*)") -> DataFrame:
    """Evaluate a family at ``now``, reading only the buckets it looks at."""
    spans = [live_span(d, now) for d in definitions]
    span = (min(s for s, _ in spans), max(e for _, e in spans))
    metrics = family_metrics(df, definitions, ts, params, measure, span)
    at = definitions_df(df.sparkSession, definitions).withColumn("tick", F.lit(to_epoch(now)).cast("long"))
    return _stamped(judge(_lookup(at, metrics)), F.col("tick"))


def tick_bucket() -> Column:
    """Bucket a tick looks at, from columns tick, width_s, offset_s and delay_s."""
    moved = F.col("tick") - F.col("offset_s") - F.col("delay_s")
    return moved - F.pmod(moved, F.col("width_s")) + F.col("offset_s")


def _lookup(at: DataFrame, metrics: DataFrame) -> DataFrame:
    """Attach each tick's bucket; ticks without a metric row stay."""
    found = bucket_rows(metrics).withColumnRenamed("time_ts", "bucket_ts")
    return at.withColumn("bucket_ts", tick_bucket()).join(found, [*ID, "bucket_ts"], "left")


def alert_series(definition: AlertDefinition, ctx: RunContext) -> Compiled:
    """All buckets of a query-text alert under the filters of a page, with the thresholds to draw as lines."""
    span = ctx.range
    clauses = ctx.filters.clauses(ctx.ts, as_utc(ctx.now), ctx.zone)
    text = definition.query.replace(FILTERS_TOKEN, join_clauses(clauses)).rstrip().rstrip(";")
    given = {**ctx.params, **(span.bind() if span else {}), **definition.params}
    found = _metric(ctx.spark, replace(definition, params=given), text)
    return Compiled(found.drop(*ID), span, definition.width.ms, definition.thresholds)


def planned_ticks(spark: SparkSession, definitions: Sequence[AlertDefinition], start: datetime,
                  end: datetime) -> DataFrame:
    """One row per definition and execution time in (start, end]."""
    due = ticks(spark, [d.check_every for d in definitions], start, end)
    return due.join(definitions_df(spark, definitions), "check_every")


def replay(spark: SparkSession, definitions: Sequence[AlertDefinition], metrics: DataFrame,
           start: datetime, end: datetime) -> DataFrame:
    """Evaluate many alerts over history in one job; results carry the tick's time."""
    at = planned_ticks(spark, definitions, start, end)
    return _stamped(judge(_lookup(at, metrics)), F.col("tick"))


def replay_span(definitions: Sequence[AlertDefinition], start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """Scan bounds that hold every bucket a replay can look at."""
    back = max(d.delay + d.width.seconds for d in definitions)
    return as_utc(start) - timedelta(seconds=back), as_utc(end) + timedelta(seconds=back)


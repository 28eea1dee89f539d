"""Filters, predicates and time buckets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bucketwise.functions import buckets, fields as fld
from bucketwise.operators import filters as flt
from bucketwise.operators.topk import top_tuples
from bucketwise.plans.charts import Chart, rated
from bucketwise.plans.spec import RunContext, compile_query, from_table
from bucketwise.sources import sqltext
from bucketwise.sources.tables import local_rows
from suite.registry import EVENTS_FROM, EVENTS_TO, NOW, register, table, views
from suite.sources_and_fields import context

IN_MONTH = f"ts >= TIMESTAMP '{EVENTS_FROM}' AND ts <= TIMESTAMP '{EVENTS_TO}'"


@register("f1_and_of_clauses", """
SELECT event_id FROM events WHERE (event_type = 'error' OR event_type = 'click') AND (value > 50 OR value < 1)""")
def _(spark, folder):
    spec = (from_table("events", fld.field("event_id")).filtering("event_type = 'error' OR event_type = 'click'")
            .filtering("value > 50 OR value < 1").unfiltered())
    return compile_query(spec, context(spark, folder, "events")).df


@register("f2_inclusive_range", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-03-01'""")
def _(spark, folder):
    state = flt.FilterState(flt.TimeRange(start=datetime(1996, 1, 1), end=datetime(1996, 3, 1)))
    return state.apply(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", NOW).select("o_orderkey")


@register("f3_presets", " UNION ALL ".join(
    f"SELECT '{name}' AS preset, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL {int(d.total_seconds())} SECOND "
    f"AND ts <= TIMESTAMP '{NOW}'" for name, d in flt.PRESETS.items()))
def _(spark, folder):
    events = table(spark, folder, "events")
    # One scan for all presets: each row is counted under every range that holds it.
    inside = [F.when(F.expr(flt.TimeRange(p).resolve(NOW).clause("ts")), F.lit(p)) for p in flt.PRESETS]
    counted = (events.select(F.explode(F.array_compact(F.array(*inside))).alias("preset"))
               .groupBy("preset").agg(F.count("*").alias("n")))
    names = local_rows(spark, [(p,) for p in flt.PRESETS], "preset string")
    return names.join(counted, "preset", "left").select("preset", F.coalesce("n", F.lit(0)).alias("n"))


@register("f4_custom_range", """
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 07:30' AND ts <= TIMESTAMP '2024-01-12 11:00'""")
def _(spark, folder):
    state = flt.FilterState(flt.TimeRange(custom="2024-01-10 08:30 to 2024-01-12 12:00"))
    return state.apply(table(spark, folder, "events").select("event_id", "ts"), "ts", NOW, "Europe/Berlin")


@register("f6_user_predicate", f"SELECT event_id FROM events WHERE {IN_MONTH} AND (value BETWEEN 20 AND 30 OR user_id = 8)")
def _(spark, folder):
    ctx = context(spark, folder, "events", filters=flt.FilterState(flt.TimeRange("720h"), ("value BETWEEN 20 AND 30 OR user_id = 8",)))
    return compile_query(from_table("events", fld.field("event_id")), ctx).df


@register("f9_skip_filters", "SELECT count(*) AS cnt FROM events")
def _(spark, folder):
    ctx = context(spark, folder, "events", filters=flt.FilterState(flt.TimeRange("1h")))
    return compile_query(from_table("events", fld.count()).unfiltered(), ctx).df


@register("f10_filter_token", f"SELECT event_type, count(*) AS cnt FROM events WHERE ({IN_MONTH}) AND (value > 5) GROUP BY 1")
def _(spark, folder):
    ctx = context(spark, folder, "events", filters=flt.FilterState(flt.TimeRange("720h"), ("value > 5",)))
    text = "SELECT event_type, count(*) AS cnt FROM events WHERE {{FILTERS}} GROUP BY event_type"
    return compile_query(sqltext.from_string(text), ctx).df


@register("f11_bound_parameters", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 25.5 AND user_id < 100")
def _(spark, folder):
    params = sqltext.typed_params({"kind": "error", "low": "25.5", "users": "100"},
                                  {"kind": "String", "low": "Float64", "users": "Int64"})
    text = "SELECT event_id, value FROM events WHERE event_type = :kind AND value > :low AND user_id < :users"
    return compile_query(sqltext.from_string_unfiltered(text), context(spark, folder, "events", params=params)).df


@register("f12_value_predicates", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority != '1-URGENT' AND contains(CAST(o_orderkey AS VARCHAR), '7')""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return flt.where_all(orders, [flt.equals("o_orderstatus", "F"), flt.differs("o_orderpriority", "1-URGENT"),
                                  flt.contains("o_orderkey", "7")])


@register("f13_time_around", """
SELECT 'hour' AS margin, event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15 11:00' AND TIMESTAMP '2024-01-15 13:00'
UNION ALL SELECT 'day', event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 12:00' AND TIMESTAMP '2024-01-16 12:00'
UNION ALL SELECT 'minutes', event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15 11:55' AND TIMESTAMP '2024-01-15 12:05'""")
def _(spark, folder):
    noon, events = datetime(2024, 1, 15, 12), table(spark, folder, "events").select("event_id", "ts")
    margins = {"hour": timedelta(hours=1), "day": timedelta(days=1), "minutes": timedelta(minutes=5)}
    inside = [F.when(F.expr(flt.around("ts", noon, m)), F.lit(name)) for name, m in margins.items()]
    widest = flt.where_all(events, [flt.around("ts", noon, max(margins.values()))])
    return widest.select(F.explode(F.array_compact(F.array(*inside))).alias("margin"), "event_id")


@register("f14_search_all_columns", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)), 'mach')""")
def _(spark, folder):
    customer = table(spark, folder, "customer")
    found = flt.search_columns(customer, "MacH", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return found.select("c_custkey", "c_name", "c_mktsegment")


@register("f15_search_each_column", """
SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_type), 'prom')""")
def _(spark, folder):
    found = flt.search_each(table(spark, folder, "part"), {"p_name": "Ring", "p_type": "PROM"})
    return found.select("p_partkey", "p_name", "p_type")


@register("f16_multi_select", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def _(spark, folder):
    chosen = table(spark, folder, "events").where(flt.any_selected("event_type", '["error", "view"]'))
    return chosen.groupBy("event_type").agg(F.count("*").alias("n"))


@register("f17_anchored_pattern", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(small|large) [rg]')")
def _(spark, folder):
    return table(spark, folder, "part").where(flt.starts_with_pattern("p_name", "(small|large) [rg]")).select("p_partkey", "p_name")


@register("f18_ilike", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%mobile'")
def _(spark, folder):
    return table(spark, folder, "customer").where(F.col("c_mktsegment").ilike("%mobile")).select("c_custkey", "c_mktsegment")


@register("f19_recent_rows", f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 36 HOUR")
def _(spark, folder):
    return flt.recent(table(spark, folder, "events").select("event_id", "ts"), timedelta(hours=36), NOW).select("event_id")


@register("f20_match_dimension_tuples", """
WITH d AS (SELECT nullif(event_type, 'view') AS kind, user_id % 7 AS lane, event_id FROM events),
top AS (SELECT kind, lane, count(*) AS n FROM d GROUP BY 1, 2 ORDER BY n DESC, kind NULLS LAST, lane LIMIT 10)
SELECT d.event_id, d.kind, d.lane FROM d
WHERE EXISTS (SELECT 1 FROM top WHERE top.kind IS NOT DISTINCT FROM d.kind AND top.lane = d.lane)""")
def _(spark, folder):
    rows = table(spark, folder, "events").select(
        F.nullif("event_type", F.lit("view")).alias("kind"), (F.col("user_id") % 7).alias("lane"), "event_id")
    return flt.matching_dims(rows, top_tuples(rows, ["kind", "lane"], 10), ["kind", "lane"])


@register("f21_having_current_bucket", """
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time_ts, CAST(count(*) AS DOUBLE) AS value
FROM events WHERE event_type = 'error' GROUP BY 1 HAVING time_ts = epoch(TIMESTAMP '2024-01-20 14:00')""")
def _(spark, folder):
    from bucketwise.alerting.definitions import parse_definitions
    from bucketwise.alerting.evaluate import live_bucket, sql_metrics  # noqa: F401
    from suite.alerts import sql_definition

    views(spark, folder, "events")
    d = sql_definition("event_count_alert.sql", "errors", "error", value_gt=3)
    found = spark.sql(d.live_sql(live_bucket(d, datetime(2024, 1, 20, 14, 37))), args=dict(d.params))
    return found.select("time_ts", F.col("value").cast("double").alias("value"))


@register("f22_predicate_on_tables", """
SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey < 5 UNION ALL
SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey < 5""")
def _(spark, folder):
    frames = {"customer_part": table(spark, folder, "customer").withColumnRenamed("c_nationkey", "nationkey"),
              "supplier_part": table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "nationkey")}
    flt.filtered_views(spark, frames, "nationkey < 5")
    return spark.sql("SELECT 'customer' AS name, count(*) AS n FROM customer_part UNION ALL "
                     "SELECT 'supplier', count(*) FROM supplier_part")


# -- buckets --------------------------------------------------------------------------

def _bucket_sql(interval: str, origin: str = "1970-01-01") -> str:
    return f"time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '{origin}')"


@register("b1_fixed_buckets", f"""
SELECT 'fifteen' AS width, {_bucket_sql('15 minutes')} AS time, count(*) AS cnt FROM events GROUP BY 2
UNION ALL SELECT 'five', {_bucket_sql('5 minutes')}, count(*) FROM events GROUP BY 2""")
def _(spark, folder):
    ctx = context(spark, folder, "events")
    out = {}
    for name, f in (("fifteen", fld.every_15_minutes("ts")), ("five", fld.every_5_minutes("ts"))):
        out[name] = compile_query(from_table("events", f, fld.count()).grouping(f).unfiltered(), ctx).df
    from bucketwise.operators.shape import union_tagged

    return union_tagged(out, "width")


@register("b2_any_interval", f"SELECT {_bucket_sql('90 minutes')} AS time, round(avg(value), 10) AS mean FROM events GROUP BY 1")
def _(spark, folder):
    f = fld.every("ts", "90 minutes")
    spec = from_table("events", f, fld.field("round(avg(value), 10)", "mean")).grouping(f).unfiltered()
    return compile_query(spec, context(spark, folder, "events")).df


@register("b2_two_months", """
SELECT make_date(CAST(b // 12 AS INTEGER), CAST(b % 12 AS INTEGER) + 1, 1)::TIMESTAMP AS time, cnt, round(total, 2) AS total FROM (
  SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1) // 2 * 2 AS b, count(*) AS cnt, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def _(spark, folder):
    f = fld.every("o_orderdate", "2 months")
    spec = from_table("orders", f, fld.count(), fld.field("round(sum(o_totalprice), 2)", "total")).grouping(f).unfiltered()
    return compile_query(spec, context(spark, folder, "orders")).df


UNITS = ("second", "minute", "hour", "day", "month", "quarter", "year")


@register("b3_rounding_units", " UNION ALL ".join(
    f"SELECT '{u}' AS unit, CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS time, count(*) AS cnt FROM events GROUP BY 2" for u in UNITS))
def _(spark, folder):
    events = table(spark, folder, "events").select("ts")
    rows = None
    for unit in UNITS:
        one = events.groupBy(buckets.bucket("ts", unit).alias("time")).agg(F.count("*").alias("cnt")).select(F.lit(unit).alias("unit"), "time", "cnt")
        rows = one if rows is None else rows.unionByName(one)
    return rows


# Moved by 75 days, the events lie around the end of March 2024, when Berlin goes from one to two hours before UTC.
LATER = "ts + INTERVAL '75' DAY"
TO_SUMMER = "TIMESTAMP '2024-03-31 01:00:00'"


@register("b3_days_in_zone", f"""
SELECT unit, CAST(day - CASE WHEN day <= TIMESTAMP '2024-03-31' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS TIMESTAMP) AS time, count(*) AS cnt FROM (
  SELECT unit, CASE unit WHEN 'day' THEN date_trunc('day', local) WHEN 'month' THEN date_trunc('month', local)
    ELSE time_bucket(INTERVAL '7 days', local, TIMESTAMP '1970-01-04') END AS day
  FROM (SELECT moved + CASE WHEN moved < {TO_SUMMER} THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS local FROM (SELECT {LATER} AS moved FROM events)),
       (VALUES ('day'), ('week'), ('month')) u(unit)) GROUP BY 1, 2""")
def _(spark, folder):
    later = table(spark, folder, "events").select(F.expr(LATER).alias("at"))
    rows = None
    for unit in ("day", "week", "month"):
        one = (later.groupBy(buckets.bucket("at", unit, "Europe/Berlin").alias("time")).agg(F.count("*").alias("cnt"))
               .select(F.lit(unit).alias("unit"), "time", "cnt"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@register("b4_week_from_sunday", """
SELECT time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-04') AS time, count(*) AS cnt FROM orders GROUP BY 1""")
def _(spark, folder):
    f = fld.every("o_orderdate", "1 week")
    return compile_query(from_table("orders", f, fld.count()).grouping(f).unfiltered(), context(spark, folder, "orders")).df


@register("b6_auto_bucket", """
SELECT date_trunc('day', o_orderdate) AS time, count(*) AS cnt FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1""")
def _(spark, folder):
    span = flt.FilterState(flt.TimeRange(start=datetime(1997, 1, 1), end=datetime(1998, 1, 1)))
    f = fld.auto_bucket("o_orderdate")
    ctx = RunContext(spark, NOW, span, {"orders": table(spark, folder, "orders")}, ts="o_orderdate")
    return compile_query(from_table("orders", f, fld.count()).grouping(f).ordering(f), ctx).df


@register("b7_bucket_token", f"""
SELECT {_bucket_sql('5 minutes')} AS time, count(*) AS cnt FROM events
WHERE ts >= TIMESTAMP '2024-01-30' AND ts <= TIMESTAMP '{EVENTS_TO}' GROUP BY 1""")
def _(spark, folder):
    text = "SELECT {{BUCKET:ts}} AS time, count(*) AS cnt FROM events WHERE {{FILTERS}} GROUP BY 1"
    ctx = context(spark, folder, "events", filters=flt.FilterState(flt.TimeRange("24h")))
    return compile_query(sqltext.from_string(text).with_auto_bucket(), ctx).df


@register("b8_b9_buckets_of_ticks", """
SELECT event_id, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS running,
       CAST(floor(epoch(ts) / 900) * 900 - 900 AS BIGINT) AS last_full FROM events""")
def _(spark, folder):
    at = buckets.epoch_seconds("ts")
    return table(spark, folder, "events").select(
        "event_id", buckets.epoch_bucket(at, "15 minutes").alias("running"),
        buckets.epoch_bucket(at, "15 minutes", lag=1).alias("last_full"))


@register("b10_rate_per_second", f"""
SELECT date_trunc('hour', ts) AS time, round(count(*) / 3600.0, 8) AS cnt FROM events WHERE {IN_MONTH} GROUP BY 1""")
def _(spark, folder):
    chart = Chart("timeBar", from_table("events"), x=fld.auto_bucket("ts"), y=fld.count())
    out = rated(chart.run(context(spark, folder, "events"), ordered=False), "cnt")
    return out.withColumn("cnt", F.round("cnt", 8))


@register("f5_range_in_milliseconds", """
SELECT event_type, count(*) AS n FROM events
WHERE epoch_ms(ts) BETWEEN epoch_ms(TIMESTAMP '2024-01-30') AND epoch_ms(TIMESTAMP '2024-01-31') GROUP BY 1""")
def _(spark, folder):
    span = flt.TimeRange("24h").resolve(NOW)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return (table(spark, folder, "events").where(at.between(span.from_ms, span.to_ms))
            .groupBy("event_type").agg(F.count("*").alias("n")))


@register("f7_filter_state", """
SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-31' AND value > 30 AND event_type = 'error'""")
def _(spark, folder):
    state = flt.FilterState(flt.TimeRange("48h")).add("value > 30").add(flt.equals("event_type", "error"))
    return flt.FilterState.from_dict(state.to_dict()).apply(table(spark, folder, "events"), "ts", NOW).select("event_id")


@register("f8_template_bound", """
SELECT event_id FROM events WHERE user_id = 17 OR event_type LIKE '%vie%'""")
def _(spark, folder):
    by_user, by_text = flt.PredicateTemplate("user", "user_id = ..."), flt.PredicateTemplate("text", "event_type LIKE '%...%'")
    events = table(spark, folder, "events")
    return events.where(F.expr(f"({by_user.bind(17)}) OR ({by_text.bind('vie')})")).select("event_id")

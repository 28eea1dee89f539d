"""Chart queries, post-processing of their results, and charts kept as data."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from bucketwise.functions import buckets
from bucketwise.functions import fields as fld
from bucketwise.operators import filters as flt
from bucketwise.operators import series as ser
from bucketwise.operators.shape import union_tagged
from bucketwise.plans.charts import (Chart, auto_chart, run_chart, run_dashboard, shares, sorted_by_measure,
                                     stacked)
from bucketwise.plans.spec import from_table
from suite.filters_and_buckets import IN_MONTH
from suite.registry import register, table
from suite.sources_and_fields import context

EVENTS = from_table("events")
LANE = fld.field("user_id % 3", "lane")


def hourly_bar(**more):
    return Chart("timeBar", EVENTS, x=fld.auto_bucket("ts"), y=fld.count(), fill=fld.enum("event_type"), **more)


HOURLY_SQL = f"SELECT event_type, date_trunc('hour', ts) AS time, count(*) AS cnt FROM events WHERE {IN_MONTH} GROUP BY 1, 2"


@register("c1_time_bar", HOURLY_SQL)
def time_bar(spark, folder):
    return hourly_bar().run(context(spark, folder, "events")).df


@register("c2_time_line", f"""
SELECT CAST(user_id % 3 AS VARCHAR) AS lane, event_type, date_trunc('hour', ts) AS time, round(avg(value), 10) AS mean
FROM events WHERE {IN_MONTH} GROUP BY 1, 2, 3""")
def _(spark, folder):
    chart = Chart("timeLine", EVENTS, x=fld.auto_bucket("ts"), y=fld.field("round(avg(value), 10)", "mean"),
                  stroke=fld.enum("event_type"), z=fld.field("CAST(user_id % 3 AS STRING)", "lane"))
    return chart.run(context(spark, folder, "events")).df


def filled_sql(source: str, series: str, step: str) -> str:
    return f"""
WITH base AS ({source}), ends AS (SELECT {series}, min(time) AS lo, max(time) AS hi FROM base GROUP BY {series}),
grid AS (SELECT {series}, unnest(generate_series(lo, hi, INTERVAL {step})) AS time FROM ends)
SELECT g.*, coalesce(b.cnt, 0) AS cnt FROM grid g LEFT JOIN base b USING ({series}, time)"""


@register("c2_l3_time_line_filled", filled_sql(HOURLY_SQL.replace("GROUP BY", "AND value > 60 GROUP BY"), "event_type", "1 HOUR"))
def time_line_filled(spark, folder):
    chart = Chart("timeLine", EVENTS.filtering("value > 60"), x=fld.auto_bucket("ts"), y=fld.count(),
                  stroke=fld.enum("event_type"), fill_step="1 hour")
    return chart.run(context(spark, folder, "events")).df


MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time, count(*) AS cnt FROM orders WHERE o_totalprice > 400000 AND o_custkey % 11 = 0 GROUP BY 1"


@register("l3_gap_fill_months", f"""
WITH m AS ({MONTHLY}) SELECT CAST(g AS TIMESTAMP) AS time, coalesce(cnt, 0) AS cnt FROM (
  SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 MONTH)) AS g FROM m) LEFT JOIN m ON time = g""")
def _(spark, folder):
    months = (table(spark, folder, "orders").where("o_totalprice > 400000 AND o_custkey % 11 = 0")
              .groupBy(buckets.bucket("o_orderdate", "month").alias("time")).agg(F.count("*").alias("cnt")))
    return ser.gap_fill(months, "time", "1 month")


@register("l3_gap_fill_whole_range", f"""
WITH base AS (SELECT event_type, date_trunc('day', ts) AS time, count(*) AS cnt FROM events WHERE value > 200 GROUP BY 1, 2),
s AS (SELECT DISTINCT event_type FROM base),
grid AS (SELECT event_type, CAST(g AS TIMESTAMP) AS time FROM s,
  generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(g))
SELECT grid.event_type, grid.time, coalesce(cnt, 0) AS cnt FROM grid LEFT JOIN base USING (event_type, time)""")
def _(spark, folder):
    daily = (table(spark, folder, "events").where("value > 200")
             .groupBy("event_type", F.window("ts", "1 day").start.alias("time")).agg(F.count("*").alias("cnt")))
    return ser.gap_fill(daily, "time", "1 day", ["event_type"], bounds=(datetime(2024, 1, 1), datetime(2024, 1, 31)))


@register("c3_bar_vertical", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2""")
def _(spark, folder):
    chart = Chart("barVertical", from_table("lineitem").unfiltered(), x=fld.enum("l_linestatus"),
                  y=fld.field("round(sum(l_extendedprice), 2)", "price"), fill=fld.enum("l_returnflag"))
    return chart.run(context(spark, folder, "lineitem")).df


@register("c4_bar_horizontal", "SELECT p_brand, p_type, count(*) AS cnt FROM part GROUP BY 1, 2")
def _(spark, folder):
    chart = Chart("barHorizontal", from_table("part").unfiltered(), x=fld.count(), y=fld.enum("p_type"), fill=fld.enum("p_brand"))
    return chart.run(context(spark, folder, "part")).df


@register("c5_time_heatmap", f"""
SELECT CAST(ceil(value / 25) * 25 AS BIGINT) AS y_bin, date_trunc('hour', ts) AS time, count(*) AS cnt
FROM events WHERE {IN_MONTH} GROUP BY 1, 2""")
def _(spark, folder):
    chart = Chart("timeHeatmap", EVENTS, x=fld.auto_bucket("ts"), y=fld.field("value"), fill=fld.count(), y_bin=25)
    out = chart.run(context(spark, folder, "events")).df
    return out.withColumn("y_bin", F.col("y_bin").cast("long"))


@register("c6_ordinal_heatmap", f"""
SELECT event_type, date_trunc('hour', ts) AS time, round(sum(value), 2) AS total FROM events WHERE {IN_MONTH} GROUP BY 1, 2""")
def _(spark, folder):
    chart = Chart("timeHeatmapOrdinal", EVENTS, x=fld.auto_bucket("ts"), y=fld.enum("event_type"),
                  fill=fld.field("round(sum(value), 2)", "total"))
    return chart.run(context(spark, folder, "events")).df


@register("c7_distinct_cells", f"SELECT DISTINCT user_id, date_trunc('hour', ts) AS time FROM events WHERE {IN_MONTH}")
def _(spark, folder):
    chart = Chart("timeHeatmapOrdinal", EVENTS, x=fld.auto_bucket("ts"), y=fld.field("user_id"))
    return chart.run(context(spark, folder, "events")).df


@register("c8_stats", f"SELECT event_type AS label, round(avg(value), 2) AS value FROM events WHERE {IN_MONTH} GROUP BY 1")
def _(spark, folder):
    chart = Chart("stats", from_table("events", fld.avg_of("value", "value")), title=fld.enum("event_type").with_alias("label"))
    return chart.run(context(spark, folder, "events")).df


@register("c9_table_ordered_limit", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10000")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    rows = orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ctx = context(spark, folder)
    return Chart("table", from_table("ranked").unfiltered(), limit=10_000).run(
        type(ctx)(spark, ctx.now, tables={"ranked": rows})).df


@register("c9_table_all_rows", "SELECT * FROM orders")
def _(spark, folder):
    return Chart("table", from_table("orders").unfiltered()).run(context(spark, folder, "orders")).df


@register("c10_facets", f"""
SELECT user_id % 3 AS lane, CAST(hour(ts) // 12 AS INTEGER) AS half, event_type, date_trunc('hour', ts) AS time, count(*) AS cnt
FROM events WHERE {IN_MONTH} GROUP BY 1, 2, 3, 4""")
def _(spark, folder):
    chart = hourly_bar(fx=fld.field("CAST(hour(ts) DIV 12 AS INT)", "half"), fy=LANE)
    return chart.run(context(spark, folder, "events")).df


@register("c11_share_of_total", f"""
SELECT event_type, time, cnt, round(cnt / sum(cnt) OVER (PARTITION BY time), 8) AS share FROM ({HOURLY_SQL})""")
def _(spark, folder):
    chart = hourly_bar()
    return shares(chart, chart.run(context(spark, folder, "events"), ordered=False)).withColumn("share", F.round("share", 8))


def _stack_sql(order: str, rank: str) -> str:
    return f"""SELECT '{order}' AS kind, event_type, time, cnt, y2 - cnt AS y1, y2 FROM (
      SELECT *, CAST(sum(cnt) OVER (PARTITION BY time ORDER BY {rank}, event_type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS y2
      FROM (SELECT *, sum(cnt) OVER (PARTITION BY event_type) AS total,
                   min(CASE WHEN cnt = top THEN time END) OVER (PARTITION BY event_type) AS top_time
            FROM (SELECT *, max(cnt) OVER (PARTITION BY event_type) AS top FROM ({HOURLY_SQL}))))"""


@register("c12_stack_positions", " UNION ALL ".join(
    _stack_sql(o, r) for o, r in (("sum", "total"), ("value", "cnt"), ("appearance", "top_time"), ("input", "1"))))
def _(spark, folder):
    chart = hourly_bar()
    result = chart.run(context(spark, folder, "events"), ordered=False)
    kinds = {o: stacked(chart, result, o) for o in ("sum", "value", "appearance", "input")}
    return union_tagged(kinds, "kind").select("kind", "event_type", "time", "cnt", "y1", "y2")


@register("c12_stack_reversed_shares", f"""
SELECT event_type, time, cnt, round((y - cnt) / tot, 8) AS y1, round(y / tot, 8) AS y2 FROM (
  SELECT *, sum(cnt) OVER (PARTITION BY time ORDER BY total DESC, event_type DESC ROWS UNBOUNDED PRECEDING) AS y,
         sum(cnt) OVER (PARTITION BY time) AS tot
  FROM (SELECT *, sum(cnt) OVER (PARTITION BY event_type) AS total FROM ({HOURLY_SQL})))""")
def _(spark, folder):
    chart = hourly_bar()
    out = stacked(chart, chart.run(context(spark, folder, "events"), ordered=False), "sum", reverse=True, expand=True)
    return out.withColumns({"y1": F.round("y1", 8), "y2": F.round("y2", 8)})


@register("c13_categories_by_measure", """
SELECT p_type, p_size, cnt, max(cnt) OVER (PARTITION BY p_type) AS sort_value
FROM (SELECT p_type, p_size, count(*) AS cnt FROM part GROUP BY 1, 2)""")
def _(spark, folder):
    chart = Chart("barVertical", from_table("part").unfiltered(), x=fld.enum("p_type"), y=fld.count(), fill=fld.field("p_size"))
    return sorted_by_measure(chart, chart.run(context(spark, folder, "part")), reverse=True)


@register("c14_alert_series", f"""
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time_ts, CAST(count(*) AS DOUBLE) AS value, CAST(5 AS DOUBLE) AS value_gt,
  3600000 AS bucket_ms FROM events WHERE event_type = 'error' AND user_id % 2 = 0 AND {IN_MONTH} GROUP BY 1""")
def _(spark, folder):
    from bucketwise.alerting.evaluate import alert_series
    from suite.alerts import sql_definition

    d = sql_definition("event_count_alert.sql", "errors", "error", value_gt=5)
    found = alert_series(d, context(spark, folder, "events", filters=flt.FilterState(flt.TimeRange("720h"), ("user_id % 2 = 0",))))
    lines = {name: F.lit(v).cast("double") for name, v in found.thresholds.items()}
    return found.df.withColumns({**lines, "bucket_ms": F.lit(found.bucket_ms)})


@register("c15_auto_chart", """
SELECT event_type, date_trunc('hour', ts) AS time, count(*) AS cnt FROM events GROUP BY 1, 2""")
def _(spark, folder):
    ctx = context(spark, folder, "events")
    return auto_chart("events", table(spark, folder, "events")).run(ctx).df


# -- sorts and limits -----------------------------------------------------------------

@register("l1_l2_order_and_limit", """
SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 500""")
def _(spark, folder):
    key, price = fld.field("o_orderkey"), fld.field("o_totalprice")
    spec = (from_table("orders", fld.field("o_orderpriority"), key, price)
            .ordering(fld.field("o_orderpriority"), key).limiting(500).unfiltered())
    return compile_limit(spec, context(spark, folder, "orders"))


def compile_limit(spec, ctx):
    from bucketwise.plans.spec import compile_query

    return compile_query(spec, ctx).df


@register("l4_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, folder):
    return (table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100))


@register("l5_sample_rows", """
SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31' ORDER BY ts DESC, event_id LIMIT 50""")
def _(spark, folder):
    newest = table(spark, folder, "events").orderBy(F.col("ts").desc(), "event_id")
    ctx = context(spark, folder, filters=flt.FilterState(flt.TimeRange("24h")))
    return Chart("table", EVENTS, limit=50).run(replace(ctx, tables={"events": newest})).df


# -- specs as data ----------------------------------------------------------------------

BAR_JSON = json.dumps({"type": "timeBar", "props": {
    "sql": {"kind": "table", "table": "events", "where": ["value > 20"]},
    "x": {"kind": "autoBucket", "column": "ts", "alias": "time"},
    "y": {"kind": "count", "definition": "count(*)", "alias": "cnt"},
    "fill": {"kind": "enum", "definition": "CAST(event_type AS STRING)", "alias": "event_type"}}})


@register("u3_u4_chart_from_json", f"""
SELECT event_type, date_trunc('hour', ts) AS time, count(*) AS cnt FROM events WHERE value > 20 AND {IN_MONTH} GROUP BY 1, 2""")
def _(spark, folder):
    return run_chart(BAR_JSON, context(spark, folder, "events")).df


DASHBOARD = {"title": "Traffic", "widgets": [
    {"type": "markdown", "props": {"content": "about"}},
    {"type": "textInput", "props": {"name": "kind", "default": "error"}},
    {"type": "grid", "props": {"areas": {"a": json.loads(BAR_JSON)}}},
    {"type": "timeLine", "props": {
        "sql": {"kind": "raw", "sql": "SELECT {{BUCKET:ts}} AS time, count(*) AS cnt FROM events "
                                      "WHERE {{FILTERS}} AND event_type = :kind GROUP BY 1", "autoBucket": True},
        "x": {"kind": "expr", "definition": "time", "alias": "time", "xBucketSizeMs": 3600000},
        "y": {"kind": "expr", "definition": "cnt", "alias": "cnt"}}}]}


TOGETHER = [
    Chart("timeBar", from_table("events"), x=fld.auto_bucket("ts"), y=fld.count()),
    Chart("barVertical", from_table("events").filtering("value > 20"), x=fld.enum("event_type"), y=fld.count()),
    Chart("timeLine", from_table("events"), x=fld.every("ts", "1 day"), y=fld.field("round(sum(value), 4)", "total"), stroke=fld.enum("event_type"))]


@register("u5_shared_scan", f"""
SELECT 'hours' AS chart, CAST(date_trunc('hour', ts) AS VARCHAR) AS label, NULL AS event_type, CAST(count(*) AS DOUBLE) AS y FROM events WHERE {IN_MONTH} GROUP BY 2
UNION ALL SELECT 'types', NULL, event_type, count(*) FROM events WHERE value > 20 AND {IN_MONTH} GROUP BY 3
UNION ALL SELECT 'days', CAST(date_trunc('day', ts) AS VARCHAR), event_type, round(sum(value), 4) FROM events WHERE {IN_MONTH} GROUP BY 2, 3""")
def _(spark, folder):
    result = run_dashboard({"widgets": [c.to_dict() for c in TOGETHER]}, context(spark, folder, "events"))
    hours, types, days = (c.df for c in result.charts.values())
    label, none = F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("label"), F.lit(None).cast("string")
    return union_tagged({"hours": hours.select(label, none.alias("event_type"), F.col("cnt").cast("double").alias("y")),
                         "types": types.select(none.alias("label"), "event_type", F.col("cnt").cast("double").alias("y")),
                         "days": days.select(label, "event_type", F.col("total").cast("double").alias("y"))}, "chart")


@register("u5_dashboard", f"""
SELECT 'bar' AS chart, date_trunc('hour', ts) AS time, count(*) AS cnt FROM events WHERE value > 20 AND {IN_MONTH} GROUP BY 2
UNION ALL SELECT 'line', date_trunc('hour', ts), count(*) FROM events WHERE event_type = 'error' AND {IN_MONTH} GROUP BY 2""")
def _(spark, folder):
    result = run_dashboard(DASHBOARD, context(spark, folder, "events"))
    bar, line = (result.charts[k].df for k in ("2.0:timeBar", "3:timeLine"))
    bar = bar.groupBy("time").agg(F.sum("cnt").alias("cnt"))
    return union_tagged({"bar": bar, "line": line.select("time", "cnt")}, "chart")

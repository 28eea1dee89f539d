"""Streaming operators, each run over the event files to the end of their input."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from bucketwise.alerting.definitions import AlertDefinition, AlertId
from bucketwise.alerting.log import AlertLog
from bucketwise.functions.buckets import Width
from bucketwise.operators import anonymize as an
from bucketwise.session import scratch_path
from bucketwise.sources.files import Files
from bucketwise.sources.tables import time_grid
from bucketwise.streaming import live
from suite.registry import register, table

LATE = "2 hours"
# Buckets end before the watermark: the latest event minus the allowed lateness.
FINAL = "time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


def event_stream(spark, folder):
    return live.file_stream(spark, folder, table(spark, folder, "events").schema, "events.parquet")


@register("st1_live_series", f"""
SELECT * FROM (SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS y FROM events GROUP BY 1, 2) WHERE {FINAL}""")
def live_series(spark, folder):
    series = live.live_series(event_stream(spark, folder), "ts", ["event_type"], "1 hour", LATE)
    return live.run_available(series, "live-series")


@register("st1_compacted_series", "SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS y FROM events GROUP BY 1, 2")
def _(spark, folder):
    """Four batches over the same hours; every second one puts the days together."""
    path = scratch_path(spark, "mixed-events")
    table(spark, folder, "events").repartition(4).write.parquet(path)
    events = live.file_stream(spark, path, table(spark, folder, "events").schema, files_per_trigger=1)
    running = live.RunningTable(spark, scratch_path(spark, "compacted-series"), ["time", "event_type"], "time", compact_every=2, tasks_a_day=1)
    live.run_batches(live.live_series(events, "ts", ["event_type"], "1 hour", "40 days"), "compacted-series", running.write, "update")
    return running.read()


@register("st1_running_series", "SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS y FROM events GROUP BY 1, 2")
def _(spark, folder):
    series = live.live_series(event_stream(spark, folder), "ts", ["event_type"], "1 hour", LATE)
    running = live.RunningTable(spark, scratch_path(spark, "running-series"), ["time", "event_type"], "time")
    live.run_batches(series, "running-series", running.write, "update")
    return running.read()


def alert(lag: int, **condition) -> AlertDefinition:
    return AlertDefinition(AlertId("stream", "errors"), Width.parse("1 hour"), lag, message="odd error rate", **condition)


STREAM_SQL = """
SELECT 'stream' AS alert_id_group, 'errors' AS alert_id_key, timestamp, status,
  CASE WHEN status = 'error' THEN 'odd error rate' ELSE '' END AS message, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date FROM (
  SELECT *, lag(status) OVER (PARTITION BY CAST(timestamp AS DATE) ORDER BY timestamp) AS p FROM ({rows}))
WHERE p IS NULL OR p <> status"""


@register("st2_live_alert_running_bucket", STREAM_SQL.format(rows="""
  SELECT date_trunc('hour', ts) AS timestamp, CASE WHEN count(*) > 3 THEN 'error' ELSE 'OK' END AS status
  FROM events WHERE event_type = 'error' GROUP BY 1"""))
def _(spark, folder):
    store = AlertLog(spark, scratch_path(spark, "alert-log"))
    store.clear()
    errors = event_stream(spark, folder).where("event_type = 'error'")
    metric = live.live_metric(errors, "ts", "1 hour", LATE)
    live.run_batches(metric, "running", live.alert_writer([alert(0, value_gt=3.0)], store), "update")
    return store.read().withColumn("event_date", F.col("event_date").cast("string"))


@register("st2_several_batches", STREAM_SQL.format(rows="""
  SELECT date_trunc('hour', ts) AS timestamp, CASE WHEN count(*) > 3 THEN 'error' ELSE 'OK' END AS status
  FROM events WHERE event_type = 'error' GROUP BY 1"""))
def _(spark, folder):
    """The events come in three batches that each hold a part of every hour, so buckets are judged again."""
    errors = table(spark, folder, "events").where("event_type = 'error'")
    path = scratch_path(spark, "parts")
    for part in range(3):  # each by as many tasks as Spark reads the events with
        errors.where(F.col("event_id") % 3 == part).write.mode("append").parquet(path)
    files = len(Files(spark).names(path))
    store = AlertLog(spark, scratch_path(spark, "alert-log"))
    store.clear()
    metric = live.live_metric(live.file_stream(spark, path, errors.schema, files_per_trigger=-(-files // 3)), "ts", "1 hour", "40 days")
    live.run_batches(metric, "several", live.alert_writer([alert(0, value_gt=3.0)], store), "update")
    return store.read().withColumn("event_date", F.col("event_date").cast("string"))


@register("st3_live_alert_final_bucket", STREAM_SQL.format(rows=f"""
  SELECT time + INTERVAL 1 HOUR AS timestamp, CASE WHEN mean > 40 THEN 'error' ELSE 'OK' END AS status FROM (
    SELECT date_trunc('hour', ts) AS time, avg(value) AS mean FROM events WHERE event_type = 'error' GROUP BY 1)
  WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 2 HOUR"""))
def _(spark, folder):
    store = AlertLog(spark, scratch_path(spark, "alert-log"))
    store.clear()
    errors = event_stream(spark, folder).where("event_type = 'error'")
    metric = live.live_metric(errors, "ts", "1 hour", LATE, "avg(value)")
    live.run_batches(metric, "final", live.alert_writer([alert(1, value_gt=40.0)], store), "append")
    return store.read().withColumn("event_date", F.col("event_date").cast("string"))


@register("st3_zero_rows_from_heartbeat", f"""
WITH grid AS (SELECT CAST(g AS TIMESTAMP) AS time FROM generate_series(
    (SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR) t(g)),
c AS (SELECT date_trunc('hour', ts) AS time, count(*) AS n FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT CAST(epoch(grid.time) AS BIGINT) AS time_ts, CAST(coalesce(n, 0) AS DOUBLE) AS value
FROM grid LEFT JOIN c USING (time) WHERE {FINAL.replace('time +', 'grid.time +')}""")
def _(spark, folder):
    events = event_stream(spark, folder)
    wanted = events.where("event_type = 'error' AND value > 60")
    # One beat per hour between the first and the last event; in production a rate source does this.
    ends = table(spark, folder, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    path, first = scratch_path(spark, "beats"), ends.lo.replace(minute=0, second=0, microsecond=0)
    beats = time_grid(spark, first, ends.hi, "1 hour", "ts").select("ts")
    beats.write.parquet(path)
    beat_stream = live.file_stream(spark, path, beats.schema)
    metric = live.live_metric(live.with_heartbeat(wanted, beat_stream, "ts"), "ts", "1 hour", LATE, "sum(weight)")
    return live.run_available(metric, "heartbeat")


@register("st3_zero_rows_per_alert", f"""
WITH grid AS (SELECT CAST(g AS TIMESTAMP) AS time FROM generate_series(
    (SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR) t(g)),
c AS (SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS n FROM events WHERE value > 60 AND event_type IN ('error', 'view') GROUP BY 1, 2)
SELECT k.event_type, CAST(epoch(grid.time) AS BIGINT) AS time_ts, CAST(coalesce(n, 0) AS DOUBLE) AS value
FROM grid CROSS JOIN (VALUES ('error'), ('view')) k(event_type) LEFT JOIN c ON c.time = grid.time AND c.event_type = k.event_type
WHERE {FINAL.replace('time +', 'grid.time +')}""")
def _(spark, folder):
    wanted = event_stream(spark, folder).where("event_type IN ('error', 'view') AND value > 60")
    ends = table(spark, folder, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    path, first = scratch_path(spark, "beats"), ends.lo.replace(minute=0, second=0, microsecond=0)
    # A beat at the end of the data moves the watermark as far as the events do.
    beats = (time_grid(spark, first, ends.hi, "1 hour", "ts").select("ts")
             .unionByName(table(spark, folder, "events").select(F.max("ts").alias("ts"))))
    beats.write.parquet(path)
    kept = live.with_heartbeat(wanted, live.file_stream(spark, path, beats.schema), "ts",
                               keys=[{"event_type": "error"}, {"event_type": "view"}])
    return live.run_available(live.live_metric(kept, "ts", "1 hour", LATE, "sum(weight)", ["event_type"]), "heartbeat-keys")


@register("st4_change_feed", """
SELECT 'types' AS alert_id_group, event_type AS alert_id_key, time AS timestamp, status,
  CASE WHEN b <> status THEN 'change' ELSE 'daily' END AS reason FROM (
  SELECT *, lag(status) OVER (PARTITION BY event_type, CAST(time AS DATE) ORDER BY time) AS p,
         lag(status) OVER (PARTITION BY event_type ORDER BY time) AS b FROM (
    SELECT event_type, date_trunc('hour', ts) AS time, CASE WHEN count(*) > 4 THEN 'error' ELSE 'OK' END AS status FROM events GROUP BY 1, 2))
WHERE p IS NULL OR p <> status""")
def _(spark, folder):
    hourly = (table(spark, folder, "events").groupBy(F.col("event_type").alias("alert_id_key"), F.window("ts", "1 hour").start.alias("timestamp"))
              .agg(F.count("*").alias("n")))
    results = hourly.select(F.lit("types").alias("alert_id_group"), "alert_id_key", "timestamp",
                            F.when(F.col("n") > 4, "error").otherwise("OK").alias("status"), F.lit("").alias("message"))
    path = scratch_path(spark, "results")
    results.write.parquet(path)
    feed = live.change_feed(live.file_stream(spark, path, results.schema))
    return live.run_available(feed, "change-feed", custom_state=True).drop("message")


@register("st5_late_rows_dropped", f"""
SELECT * FROM (SELECT date_trunc('hour', ts) AS time, count(*) AS y FROM events GROUP BY 1) WHERE {FINAL}""")
def _(spark, folder):
    # The same hours arrive again in a second file, after the watermark has passed them.
    path = scratch_path(spark, "late")
    events = table(spark, folder, "events").select("event_id", "ts")
    events.write.parquet(path)
    first = live.live_series(live.file_stream(spark, path, events.schema), "ts", [], "1 hour", LATE)
    base = scratch_path(spark, "late-run")
    live.run_available(first, "late", base=base)
    newest = events.agg(F.max("ts")).first()[0]
    late = events.where(F.col("ts") < F.lit(newest - timedelta(days=2)).cast("timestamp_ntz"))
    late.write.mode("append").parquet(path)
    return live.run_available(first, "late", base=base)


@register("st6_startup_evaluation", """
SELECT 'startup' AS alert_id_group, 'errors' AS alert_id_key, time AS timestamp, CASE WHEN n > 3 THEN 'error' ELSE 'OK' END AS status, n AS value
FROM (SELECT date_trunc('hour', ts) AS time, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_type = 'error' GROUP BY 1)""")
def _(spark, folder):
    out = scratch_path(spark, "startup")
    rule = AlertDefinition(AlertId("startup", "errors"), Width.parse("1 hour"), 0, value_gt=3.0, message="odd")
    metric = live.live_metric(event_stream(spark, folder).where("event_type = 'error'"), "ts", "1 hour", LATE)

    def write(batch, _):
        live.judge_batch(batch, [rule]).drop("message").write.mode("append").parquet(out)

    live.run_batches(metric, "startup", write, "update")
    return spark.read.parquet(out)


@register("st7_stream_anonymizer", "SELECT event_id, 'kind' AS event_type, '<K>' AS props FROM events")
def _(spark, folder):
    rules = an.chain(an.by_column({"event_type": an.replace_with("kind")}), an.text_pattern(r'^\{"k": [0-9]+\}$', "<K>"))
    rows = event_stream(spark, folder).select("event_id", "event_type", "props")
    return live.run_available(live.anonymize_stream(rows, rules), "scrubbed")



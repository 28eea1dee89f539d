"""Alerts: live evaluation, replay, change log, status and history."""

from __future__ import annotations

import os
from datetime import datetime
from importlib import resources

from pyspark.sql import functions as F

from bucketwise.alerting.definitions import AlertDefinition, AlertId, bucket_header, discover
from bucketwise.alerting import evaluate as ev
from bucketwise.alerting import log as alog
from bucketwise.alerting.ticks import ticks
from bucketwise.functions.buckets import Width
from bucketwise.session import scratch_path
from suite.registry import NOW, register, table, views

HERE = os.path.dirname(os.path.abspath(__file__))
START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)
TYPES = ("error", "click", "view", "signup", "purchase")


def sql_definition(file: str, key: str, event_type: str, **condition) -> AlertDefinition:
    # Workers import this module from a zip file, where only the package's resources can be read.
    text = resources.files(__package__).joinpath("sql", file).read_text(encoding="utf-8")
    width, lag, back = bucket_header(text)
    return AlertDefinition(AlertId("checks", key), width, lag, text, {"event_type": event_type},
                           message=f"{key} out of range", check_every="@15minutes", ts="ts", back=back, **condition)


def family(lag: int = 0, copies: int = 1) -> list[AlertDefinition]:
    """Hourly event counts, one or more alerts per type with rising thresholds."""
    out = []
    for i in range(copies):
        for n, kind in enumerate(TYPES):
            low = {"value_lt": 1.0 + i} if n == 4 else {"value_gt": 3.0 + n + i}
            out.append(AlertDefinition(
                AlertId("events" if n < 3 else "sales", f"{kind}-{i}"), Width.parse("1 hour"), lag,
                params={"event_type": kind}, message=f"{kind} out of range", check_every="@15minutes", **low))
    return out


def definitions_values(definitions) -> str:
    rows = []
    for d in definitions:
        gt, lt = (("NULL" if v is None else str(v)) for v in (d.value_gt, d.value_lt))
        rows.append(f"('{d.id.group}', '{d.id.key}', '{d.params['event_type']}', {d.lag}, CAST({gt} AS DOUBLE), "
                    f"CAST({lt} AS DOUBLE), '{d.message}')")
    return ("(VALUES " + ", ".join(rows) +
            ") d(alert_id_group, alert_id_key, kind, lag, gt, lt, text)")


def replay_sql(definitions, start=START, end=END, minutes: int = 15, measure: str = "count(*)") -> str:
    return f"""
SELECT d.alert_id_group, d.alert_id_key, t.tick AS timestamp,
  CASE WHEN gt IS NOT NULL THEN CASE WHEN coalesce(m.value, 0) > gt THEN 'error' ELSE 'OK' END
       ELSE CASE WHEN coalesce(m.value, 0) < lt THEN 'error' ELSE 'OK' END END AS status,
  CASE WHEN (gt IS NOT NULL AND coalesce(m.value, 0) > gt) OR (gt IS NULL AND coalesce(m.value, 0) < lt)
       THEN text ELSE '' END AS message, m.value
FROM (SELECT CAST(g AS TIMESTAMP) AS tick FROM generate_series(TIMESTAMP '{start}' + INTERVAL {minutes} MINUTE,
      TIMESTAMP '{end}', INTERVAL {minutes} MINUTE) s(g)) t
CROSS JOIN {definitions_values(definitions)}
LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS hour, CAST({measure} AS DOUBLE) AS value FROM events GROUP BY 1, 2) m
  ON m.event_type = d.kind AND m.hour = date_trunc('hour', t.tick) - d.lag * INTERVAL 1 HOUR"""


def changes_sql(results: str) -> str:
    return f"""
SELECT alert_id_group, alert_id_key, timestamp, status, message, value,
       CASE WHEN before <> status THEN 'change' ELSE 'daily' END AS reason
FROM (SELECT *, lag(status) OVER (PARTITION BY alert_id_group, alert_id_key, CAST(timestamp AS DATE) ORDER BY timestamp) AS previous,
             lag(status) OVER (PARTITION BY alert_id_group, alert_id_key ORDER BY timestamp) AS before
      FROM ({results})) WHERE previous IS NULL OR previous <> status"""


def replayed(spark, folder, definitions):
    span = ev.replay_span(definitions, START, END)
    metrics = ev.family_metrics(table(spark, folder, "events"), definitions, "ts", {"event_type": "event_type"}, span=span)
    return ev.replay(spark, definitions, metrics, START, END)


LIVE_AT = datetime(2024, 1, 20, 14, 37)
LIVE_SQL = " UNION ALL ".join(f"""
SELECT 'checks' AS alert_id_group, '{key}' AS alert_id_key, TIMESTAMP '{LIVE_AT}' AS timestamp,
  CASE WHEN coalesce(max(v), 0) {op} THEN 'error' ELSE 'OK' END AS status,
  CASE WHEN coalesce(max(v), 0) {op} THEN '{key} out of range' ELSE '' END AS message, max(v) AS value
FROM (SELECT CAST({measure} AS DOUBLE) AS v FROM events WHERE event_type = '{kind}'
  AND ts >= TIMESTAMP '{bucket}' AND ts < TIMESTAMP '{bucket}' + INTERVAL 1 HOUR HAVING count(*) > 0)"""
    for key, kind, op, measure, bucket in (
        ("errors", "error", "> 2", "count(*)", "2024-01-20 14:00"),
        ("views", "view", "< 1", "count(*)", "2024-01-20 14:00"),
        ("mean-click", "click", "> 40", "avg(value)", "2024-01-20 13:00")))


@register("al2_al3_live_evaluation", LIVE_SQL)
def _(spark, folder):
    views(spark, folder, "events")
    return ev.evaluate_live(spark, [
        sql_definition("event_count_alert.sql", "errors", "error", value_gt=2.0),
        sql_definition("event_count_alert.sql", "views", "view", value_lt=1.0),
        sql_definition("mean_value_alert.sql", "mean-click", "click", value_gt=40.0)], LIVE_AT)


@register("al2_live_family", f"SELECT * FROM ({replay_sql(family(), LIVE_AT, LIVE_AT, 1).replace('INTERVAL 1 MINUTE,', 'INTERVAL 0 MINUTE,')})")
def _(spark, folder):
    return ev.evaluate_family_live(table(spark, folder, "events"), family(), LIVE_AT, "ts", {"event_type": "event_type"})


FIFTY = [sql_definition("event_count_alert.sql", f"{kind}-{i}", kind, **({"value_lt": float(i)} if i % 2 else {"value_gt": float(i)}))
         for kind in TYPES for i in range(10)]


@register("al2_many_texts", f"""
SELECT 'checks' AS alert_id_group, kind || '-' || i AS alert_id_key, TIMESTAMP '{LIVE_AT}' AS timestamp,
  CASE WHEN bad THEN 'error' ELSE 'OK' END AS status, CASE WHEN bad THEN kind || '-' || i || ' out of range' ELSE '' END AS message, value
FROM (SELECT kind, i, value, CASE WHEN i % 2 = 0 THEN coalesce(value, 0) > i ELSE coalesce(value, 0) < i END AS bad
  FROM (VALUES {", ".join(f"('{k}')" for k in TYPES)}) k(kind), range(10) r(i)
  LEFT JOIN (SELECT event_type, CAST(count(*) AS DOUBLE) AS value FROM events
    WHERE ts >= TIMESTAMP '2024-01-20 14:00' AND ts < TIMESTAMP '2024-01-20 15:00' GROUP BY 1) ON event_type = kind)""")
def _(spark, folder):
    views(spark, folder, "events")
    return ev.evaluate_live(spark, FIFTY, LIVE_AT)


@register("al3_lower_and_missing_conditions", """
SELECT event_type, time, CASE event_type WHEN 'error' THEN CASE WHEN total < 20 THEN 'error' ELSE 'OK' END
    WHEN 'click' THEN 'error' ELSE CASE WHEN total > 60 THEN 'error' ELSE 'OK' END END AS status,
  CASE event_type WHEN 'error' THEN CASE WHEN total < 20 THEN 'odd' ELSE '' END WHEN 'click' THEN 'INTERNAL ERROR: no alert_if condition found.'
    ELSE CASE WHEN total > 60 THEN 'odd' ELSE '' END END AS message
FROM (SELECT event_type, date_trunc('hour', ts) AS time, max(value) AS total FROM events GROUP BY 1, 2)""")
def _(spark, folder):
    rows = (table(spark, folder, "events").groupBy("event_type", F.window("ts", "1 hour").start.alias("time"))
            .agg(F.max("value").alias("value")))
    kind = F.col("event_type")
    judged = ev.judge(rows.select(
        "*", F.lit(1).cast("long").alias("n_rows"), F.lit("odd").alias("alert_message"),
        F.when(~kind.isin("error", "click"), 60.0).alias("value_gt"), F.when(kind != "click", 20.0).alias("value_lt")))
    return judged.select("event_type", "time", "status", "message")


@register("al3_threshold_rules", """
SELECT time, n_rows, CASE WHEN n_rows > 1 THEN 'error' WHEN total > 120 THEN 'error' ELSE 'OK' END AS status,
  CASE WHEN n_rows > 1 THEN 'QUERY ERROR: found ' || n_rows || ' result rows, but only 0 or 1 allowed'
       WHEN total > 120 THEN 'too high' ELSE '' END AS message
FROM (SELECT date_trunc('hour', ts) AS time, count(*) AS n_rows, max(value) AS total FROM events WHERE event_type = 'error' GROUP BY 1)""")
def _(spark, folder):
    rows = (table(spark, folder, "events").where("event_type = 'error'")
            .groupBy(F.window("ts", "1 hour").start.alias("time"))
            .agg(F.count("*").alias("n_rows"), F.max("value").alias("value")))
    judged = ev.judge(rows.select("*", F.lit(120.0).alias("value_gt"), F.lit(None).cast("double").alias("value_lt"),
                                  F.lit("too high").alias("alert_message")))
    return judged.select("time", "n_rows", "status", "message")


HUNDRED = family(copies=20)


@register("al4_many_alerts", replay_sql(HUNDRED))
def many_alerts(spark, folder):
    return replayed(spark, folder, HUNDRED)


# Four widths in one family; the quarter hours look 20 minutes back.
MIXED = [AlertDefinition(AlertId("mixed", f"{kind}-{width}"), Width.parse(width), lag, params={"event_type": kind}, back=back,
                         message="odd mean", check_every="@15minutes", **({"value_lt": 45.0} if width == "1 day" else {"value_gt": 55.0}))
         for kind in TYPES for width, lag, back in (("15 minutes", 0, 1200), ("1 hour", 1, 0), ("1 day", 0, 0), ("1 week", 1, 0))]
MIXED_VALUES = "(VALUES " + ", ".join(
    f"('{d.id.key}', '{d.params['event_type']}', {d.width.seconds}, {d.width.offset_seconds}, {d.delay}, {d.value_gt or 'NULL'}, {d.value_lt or 'NULL'})"
    for d in MIXED) + ") d(k, kind, w, o, delay, gt, lt)"


@register("al4_mixed_widths", f"""
WITH ticks AS (SELECT CAST(g AS TIMESTAMP) AS tick, CAST(epoch(g) AS BIGINT) AS s FROM generate_series(
    TIMESTAMP '{START}' + INTERVAL 15 MINUTE, TIMESTAMP '{END}', INTERVAL 15 MINUTE) t(g)),
e AS (SELECT event_type, value, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events),
m AS (SELECT event_type, w, (s - o) // w * w + o AS bucket, avg(value) AS mean FROM e, (SELECT DISTINCT w, o FROM {MIXED_VALUES}) GROUP BY 1, 2, 3)
SELECT 'mixed' AS alert_id_group, k AS alert_id_key, tick AS timestamp, CASE WHEN bad THEN 'error' ELSE 'OK' END AS status,
  CASE WHEN bad THEN 'odd mean' ELSE '' END AS message, round(mean, 9) AS value
FROM (SELECT *, CASE WHEN gt IS NOT NULL THEN coalesce(mean, 0) > gt ELSE coalesce(mean, 0) < lt END AS bad FROM ticks
  CROSS JOIN {MIXED_VALUES} LEFT JOIN m ON m.event_type = d.kind AND m.w = d.w AND m.bucket = (s - o - delay) // d.w * d.w + o)""")
def mixed_widths(spark, folder):
    span = ev.replay_span(MIXED, START, END)
    metrics = ev.family_metrics(table(spark, folder, "events"), MIXED, "ts", {"event_type": "event_type"}, "avg(value)", span)
    return ev.replay(spark, MIXED, metrics, START, END).withColumn("value", F.round("value", 9))


@register("al5_row_thresholds", """
SELECT event_type, time, CASE WHEN value > limit_value THEN 'error' ELSE 'OK' END AS status FROM (
  SELECT event_type, date_trunc('hour', ts) AS time, CAST(count(*) AS DOUBLE) AS value,
         CASE WHEN hour(date_trunc('hour', ts)) < 8 THEN 2 ELSE 4 END AS limit_value FROM events GROUP BY 1, 2)""")
def _(spark, folder):
    rows = (table(spark, folder, "events").groupBy("event_type", F.window("ts", "1 hour").start.alias("time"))
            .agg(F.count("*").cast("double").alias("value")))
    night = F.when(F.hour("time") < 8, F.lit(2.0))
    judged = ev.judge(rows.select("*", F.lit(1).cast("long").alias("n_rows"), night.alias("alert_if_value_gt"),
                                  F.lit(4.0).alias("value_gt"), F.lit(None).cast("double").alias("value_lt"),
                                  F.lit("high").alias("alert_message")))
    return judged.select("event_type", "time", "status")


@register("al6_cron_ticks", """
WITH span AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi FROM events),
m AS (SELECT CAST(unnest(generate_series(lo + INTERVAL 1 MINUTE, hi, INTERVAL 1 MINUTE)) AS TIMESTAMP) AS t FROM span)
SELECT '15,45 */2 * * *' AS check_every, CAST(epoch(t) AS BIGINT) AS tick FROM m WHERE minute(t) IN (15, 45) AND hour(t) % 2 = 0
UNION ALL SELECT '@15minutes', CAST(epoch(t) AS BIGINT) FROM m WHERE minute(t) % 15 = 0
UNION ALL SELECT '30 6 * * 1-5', CAST(epoch(t) AS BIGINT) FROM m WHERE minute(t) = 30 AND hour(t) = 6 AND dayofweek(t) BETWEEN 1 AND 5""")
def _(spark, folder):
    ends = table(spark, folder, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    midnight = {"hour": 0, "minute": 0, "second": 0, "microsecond": 0}
    return ticks(spark, ["15,45 */2 * * *", "@15minutes", "30 6 * * 1-5"],
                 ends.lo.replace(**midnight), ends.hi.replace(**midnight))


@register("al7_replay", replay_sql(family(lag=1)))
def replay_last_full(spark, folder):
    return replayed(spark, folder, family(lag=1))


@register("w3_state_changes", changes_sql(replay_sql(family())))
def change_log(spark, folder):
    return alog.changes(replayed(spark, folder, family()))


@register("al8_changes_against_status", f"""
WITH results AS ({replay_sql(family())}),
first_half AS ({changes_sql("SELECT * FROM results WHERE timestamp <= TIMESTAMP '2024-01-15 12:00'")}),
stored AS (SELECT alert_id_group, alert_id_key, arg_max(status, timestamp) AS status, CAST(max(timestamp) AS DATE) AS day
  FROM first_half GROUP BY 1, 2),
rest AS (SELECT r.*, lag(r.status) OVER (PARTITION BY r.alert_id_group, r.alert_id_key, CAST(timestamp AS DATE) ORDER BY timestamp) AS p,
         lag(r.status) OVER (PARTITION BY r.alert_id_group, r.alert_id_key ORDER BY timestamp) AS b
  FROM results r WHERE timestamp > TIMESTAMP '2024-01-15 12:00'),
known AS (SELECT rest.*, coalesce(b, s.status) AS before, coalesce(p, CASE WHEN s.day = CAST(rest.timestamp AS DATE) THEN s.status END) AS previous
  FROM rest LEFT JOIN stored s USING (alert_id_group, alert_id_key))
SELECT alert_id_group, alert_id_key, timestamp, status, message, value,
  CASE WHEN before <> status THEN 'change' ELSE 'daily' END AS reason
FROM known WHERE previous IS NULL OR previous <> status""")
def _(spark, folder):
    results = replayed(spark, folder, family())
    noon = F.expr("TIMESTAMP_NTZ'2024-01-15 12:00:00'")
    earlier = alog.changes(results.where(F.col("timestamp") <= noon))
    return alog.changes(results.where(F.col("timestamp") > noon), alog.current_status(earlier))


@register("al9_current_status", f"""
SELECT alert_id_group, alert_id_key, max(timestamp) AS latest_timestamp, arg_max(status, timestamp) AS latest_status,
       arg_max(message, timestamp) AS latest_message FROM ({changes_sql(replay_sql(family()))}) GROUP BY 1, 2""")
def _(spark, folder):
    return alog.current_status(change_log(spark, folder))


@register("al10_w1_history", f"""
SELECT concat(alert_id_group, '#', alert_id_key) AS alert_id, alert_id_group, alert_id_key, timestamp AS start, status, message,
  coalesce(lead(timestamp) OVER (PARTITION BY alert_id_group, alert_id_key ORDER BY timestamp), TIMESTAMP '{NOW}') AS "end"
FROM ({changes_sql(replay_sql(family()))}) WHERE alert_id_group ILIKE 'EV%'""")
def _(spark, folder):
    return alog.history(change_log(spark, folder), NOW, "EV%")


@register("al12_notification_states", f"""
SELECT CASE status WHEN 'OK' THEN 'NORMAL' WHEN 'warn' THEN 'WARNING' ELSE 'ERROR' END AS state, reason, count(*) AS n
FROM ({changes_sql(replay_sql(family()))}) GROUP BY 1, 2""")
def _(spark, folder):
    feed = change_log(spark, folder).select(alog.notification_state().alias("state"), "reason")
    return feed.groupBy("state", "reason").agg(F.count("*").alias("n"))


def _log_sql(results: str) -> str:
    return f"SELECT alert_id_group, alert_id_key, timestamp, status, message, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date FROM ({changes_sql(results)})"


@register("s10_append_alert_events", _log_sql(replay_sql(family())))
def _(spark, folder):
    store = alog.AlertLog(spark, scratch_path(spark, "alert-log"))
    store.append(change_log(spark, folder))
    return store.read().withColumn("event_date", F.col("event_date").cast("string"))


@register("al13_s11_clear_and_recompute", _log_sql(replay_sql(family(lag=1))))
def _(spark, folder):
    store = alog.AlertLog(spark, scratch_path(spark, "alert-log"))
    store.append(change_log(spark, folder))
    store.clear()
    store.replace(alog.changes(replay_last_full(spark, folder)))
    return store.read().withColumn("event_date", F.col("event_date").cast("string"))


@register("al1_definitions_from_files", f"""
SELECT key, every, CASE WHEN gt IS NULL AND lt IS NULL THEN 'error' WHEN gt IS NOT NULL THEN CASE WHEN coalesce(v, 0) > gt THEN 'error' ELSE 'OK' END
    ELSE CASE WHEN coalesce(v, 0) < lt THEN 'error' ELSE 'OK' END END AS status, v AS value
FROM (VALUES ('errors', '*/30 * * * *', 2.0, NULL), ('views', '@15minutes', NULL, 3.0), ('mean', '@15minutes', 40.0, 1.0),
             ('unset', '@15minutes', NULL, NULL)) d(key, every, gt, lt)
LEFT JOIN (SELECT 'errors' AS k, CAST(count(*) AS DOUBLE) AS v FROM events WHERE event_type = 'error' AND date_trunc('hour', ts) = TIMESTAMP '2024-01-20 14:00' HAVING count(*) > 0
  UNION ALL SELECT 'views', count(*) FROM events WHERE event_type = 'view' AND date_trunc('hour', ts) = TIMESTAMP '2024-01-20 14:00' HAVING count(*) > 0
  UNION ALL SELECT 'unset', count(*) FROM events WHERE event_type = 'signup' AND date_trunc('hour', ts) = TIMESTAMP '2024-01-20 14:00' HAVING count(*) > 0
  UNION ALL SELECT 'mean', avg(value) FROM events WHERE event_type = 'click' AND date_trunc('hour', ts) = TIMESTAMP '2024-01-20 13:00' HAVING count(*) > 0) ON k = key""")
def _(spark, folder):
    views(spark, folder, "events")
    found = discover([f"{HERE}/sql/alerts.json"])
    every = F.create_map(*[F.lit(x) for d in found for x in (d.id.key, d.check_every)])
    return ev.evaluate_live(spark, found, LIVE_AT).select(F.col("alert_id_key").alias("key"), every[F.col("alert_id_key")].alias("every"), "status", "value")


def refuse_late_ones(row: dict) -> None:
    if row["timestamp"].hour >= 12:
        raise RuntimeError("no route")


@register("al11_failed_notifications", """
SELECT 'g' AS alert_id_group, event_type AS alert_id_key, date_trunc('hour', ts) AS timestamp, CASE WHEN hour(ts) >= 12 THEN 'error' ELSE 'warn' END AS status,
  CASE WHEN hour(ts) >= 12 THEN 'Error triggering notifier: no route' ELSE 'seen' END AS message FROM events GROUP BY 2, 3, 4, 5""")
def _(spark, folder):
    kept = (table(spark, folder, "events").groupBy(F.lit("g").alias("alert_id_group"), F.col("event_type").alias("alert_id_key"),
                                                   F.window("ts", "1 hour").start.alias("timestamp"))
            .agg(F.lit("warn").alias("status"), F.lit("seen").alias("message")))
    return alog.notify(kept, refuse_late_ones)

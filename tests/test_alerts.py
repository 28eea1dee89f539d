import os
import random
import subprocess
import sys
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bucketwise.alerting import definitions as dfn
from bucketwise.alerting import evaluate as ev
from bucketwise.alerting import log as alog
from bucketwise.alerting.ticks import parse_cron, ticks
from bucketwise.functions.buckets import Width
from bucketwise.operators.filters import FilterState, TimeRange
from bucketwise.plans.spec import RunContext
from bucketwise.session import ship_code
from tests.conftest import plan_of

HERE = os.path.dirname(os.path.abspath(__file__))
UTC = timezone.utc


# -- definitions ------------------------------------------------------------------------

def test_definitions_from_files():
    found = {d.id.key: d for d in dfn.parse_definitions(f"{HERE}/fixtures/alerts.yaml")}
    errors = found["tooManyErrors"]
    assert errors.value_gt == 3.0 and errors.width.seconds == 3600 and errors.lag == 0
    assert errors.id.group.endswith("alerts.yaml") and dfn.AlertId.parse(str(errors.id)) == errors.id
    assert found["silence"].thresholds == {"value_lt": 1.0}


@pytest.mark.parametrize("body, text", [
    ({}, "--BUCKET: 1 hour\n"), ({"query_path": "missing.sql"}, "--BUCKET: 1 hour\n"),
    ({"query_path": "q.sql"}, "SELECT 1\n"), ({"query_path": "q.sql"}, "\n\n\n--BUCKET: 1 hour\n"),
    ({"query_path": "q.sql"}, "--BUCKET: now and then\n"),
    ({"query_path": "q.sql", "check_every": "whenever"}, "--BUCKET: 1 hour\n")])
def test_bad_definitions(tmp_path, body, text):
    import json

    (tmp_path / "q.sql").write_text(text)
    (tmp_path / "a.json").write_text(json.dumps({"alerts": {"k": body}}))
    with pytest.raises(ValueError):
        dfn.parse_definitions(str(tmp_path / "a.json"))


# Headers and what they say.
@pytest.mark.parametrize("text, width, lag, back", [
    ("--BUCKET: 15 minutes\nSELECT", 900, 0, 0), ("-- x\n-- y\n--BUCKET: 1 hour lag 1", 3600, 1, 0),
    ("--BUCKET: 15 minutes back 20 minutes", 900, 0, 1200), ("--BUCKET: 1 day LAG 2 back 90 seconds\n", 86400, 2, 90)])
def test_bucket_header(text, width, lag, back):
    found = dfn.bucket_header(text)
    assert (found[0].seconds, *found[1:]) == (width, lag, back)


@pytest.mark.parametrize("text", ["--BUCKET: 1 month", "--BUCKET: 1 hour back month", "--BUCKET: 1 hour back soon", "SELECT 1"])
def test_headers_without_fixed_lengths_are_refused(text):
    with pytest.raises(ValueError):
        dfn.bucket_header(text)


# -- ticks --------------------------------------------------------------------------------

def at(*args, offset=0):
    return datetime(*args, tzinfo=timezone(timedelta(hours=offset)))


@pytest.mark.parametrize("cron, start, end, count, first, last", [
    ("* * * * *", at(2023, 1, 1, 10), at(2023, 1, 1, 10, 10), 10, "10:01", "10:10"),
    ("*/5 * * * *", at(2023, 1, 1, 10, offset=-5), at(2023, 1, 1, 18, offset=1), 24, "15:05", "17:00"),
    ("0 * * * *", at(2023, 1, 1, 22), at(2023, 1, 2, 2), 4, "23:00", "02:00"),
    ("15,45 */2 * * *", at(2023, 1, 1, 8), at(2023, 1, 1, 14), 6, "08:15", "12:45"),
    ("* * * * *", at(2023, 1, 1, 10), at(2023, 1, 1, 10), 0, None, None),
    ("* * * * *", at(2023, 1, 1, 11), at(2023, 1, 1, 10), 0, None, None)])
def test_execution_times(spark, cron, start, end, count, first, last):
    found = [r.t for r in ticks(spark, [cron], start, end)
             .select(F.timestamp_seconds("tick").cast("timestamp_ntz").alias("t")).orderBy("t").collect()]
    assert len(found) == count
    if count:
        assert (f"{found[0]:%H:%M}", f"{found[-1]:%H:%M}") == (first, last)


@pytest.mark.parametrize("cron", ["invalid * * * *", "* * * *", "61 * * * *", "5-1 * * * *", "*/0 * * * *", "@sometimes"])
def test_bad_cron(cron):
    with pytest.raises(ValueError):
        parse_cron(cron)


def test_day_and_weekday_are_alternatives(spark):
    found = ticks(spark, ["0 0 13 * 5"], datetime(2023, 10, 1), datetime(2023, 10, 31, 23))
    days = sorted(datetime.fromtimestamp(r.tick, UTC).day for r in found.collect())
    assert days == [6, 13, 20, 27]
    assert parse_cron("0 0 * * 7").weekday == frozenset({0})


# -- thresholds -----------------------------------------------------------------------------

@pytest.mark.parametrize("n, value, gt, lt, status", [
    (1, 15.0, 10.0, None, "error"), (1, 5.0, 10.0, None, "OK"), (1, 10.0, 10.0, None, "OK"),
    (0, None, 10.0, None, "OK"), (0, None, -1.0, None, "error"), (0, None, None, 1.0, "error"),
    (1, 1.0, None, 1.0, "OK"), (1, float("nan"), 10.0, None, "OK"), (1, None, None, 1.0, "error"),
    (2, 1.0, 10.0, None, "error"), (1, 5.0, None, None, "error"), (1, 20.0, 10.0, 30.0, "error"), (1, 5.0, 10.0, 30.0, "OK")])
def test_threshold_rules(spark, n, value, gt, lt, status):
    df = spark.createDataFrame([(n, value, gt, lt, "bad")],
                               "n_rows long, value double, value_gt double, value_lt double, alert_message string")
    row = ev.judge(df).first()
    assert row.status == status
    expected = {2: ev.TOO_MANY_ROWS % 2}.get(n) or (ev.NO_CONDITION if gt is None and lt is None else "bad" if status == "error" else "")
    assert row.message == expected


# -- evaluation -------------------------------------------------------------------------------

def definition(key, lag=0, **condition):
    with open(f"{HERE}/fixtures/count.sql", encoding="utf-8") as handle:
        return dfn.AlertDefinition(dfn.AlertId("g", key), Width.parse("1 hour"), lag, handle.read(),
                                   {"event_type": key}, message="m", check_every="@30minutes", ts="ts", **condition)


def test_replay_equals_live_tick_by_tick(spark, events):
    events.createOrReplaceTempView("events")
    alerts = [definition("error", value_gt=0.5), definition("view", lag=1, value_lt=1.0)]
    start, end = datetime(2024, 1, 10), datetime(2024, 1, 10, 3)
    columns = ["alert_id_group", "alert_id_key", "timestamp", "status", "message", "value"]
    whole = {tuple(r) for r in ev.replay(spark, alerts, ev.sql_metrics(spark, alerts), start, end).select(columns).collect()}
    single = set()
    for i in range(1, 7):
        single |= {tuple(r) for r in ev.evaluate_live(spark, alerts, start + timedelta(minutes=30 * i)).select(columns).collect()}
    assert whole == single and len(whole) == 12


def test_family_equals_query_texts(spark, events):
    events.createOrReplaceTempView("events")
    alerts = [definition("error", value_gt=0.5), definition("click", value_gt=0.5)]
    span = ev.replay_span(alerts, datetime(2024, 1, 10), datetime(2024, 1, 12))
    family = ev.family_metrics(events, alerts, "ts", {"event_type": "event_type"}, span=span)
    plan = plan_of(family)
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(ts" in plan and "In(event_type" in plan
    columns = ["alert_id_group", "alert_id_key", "timestamp", "status"]
    a, b = (ev.replay(spark, alerts, m, datetime(2024, 1, 10), datetime(2024, 1, 12)).select(columns)
            for m in (family, ev.sql_metrics(spark, alerts)))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert "Cartesian" not in plan_of(a) and "NestedLoop" not in plan_of(a)


def test_live_evaluation_reads_one_bucket(events):
    d = dfn.AlertDefinition(dfn.AlertId("g", "k"), Width.parse("15 minutes"), 1, params={"event_type": "error"}, value_gt=1.0)
    assert ev.live_span(d, datetime(2024, 1, 5, 10, 17)) == (datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 10, 15))
    plan = plan_of(ev.evaluate_family_live(events, [d], datetime(2024, 1, 5, 10, 17), "ts", {"event_type": "event_type"}))
    assert "LessThan(ts,2024-01-05T10:15)" in plan


def test_query_texts_are_bounded_too(spark, events):
    events.createOrReplaceTempView("events")
    d = definition("error", value_gt=1.0)
    plan = plan_of(ev.evaluate_live(spark, [d], datetime(2024, 1, 5, 10, 17)))
    assert "GreaterThanOrEqual(ts,2024-01-05T10:00)" in plan and "LessThan(ts,2024-01-05T11:00)" in plan
    span = ev.replay_span([d], datetime(2024, 1, 10), datetime(2024, 1, 11))
    whole, part = (ev.replay(spark, [d], ev.sql_metrics(spark, [d], s), datetime(2024, 1, 10), datetime(2024, 1, 11))
                   for s in (None, span))
    assert whole.exceptAll(part).count() == 0 and whole.count() == part.count() == 48
    assert "1=1" in dfn.AlertDefinition(d.id, d.width, query=d.query).live_sql(0)


def test_series_of_an_alert_with_filters_and_thresholds(spark, events):
    events.createOrReplaceTempView("events")
    d = definition("error", value_gt=3.0, value_lt=1.0)
    ctx = RunContext(spark, datetime(2024, 1, 31), FilterState(TimeRange("168h"), ("user_id % 2 = 0",)), ts="ts")
    found = ev.alert_series(d, ctx)
    assert found.thresholds == {"value_gt": 3.0, "value_lt": 1.0} and found.bucket_ms == 3600000 and found.time_range.seconds == 604800
    want = (events.where("event_type = 'error' AND user_id % 2 = 0 AND ts >= TIMESTAMP_NTZ'2024-01-24'")
            .groupBy(F.window("ts", "1 hour").start.alias("t")).count().selectExpr("unix_timestamp(t) AS time_ts", "CAST(count AS DOUBLE) AS value"))
    assert sorted(map(tuple, found.df.collect())) == sorted(map(tuple, want.collect())) and found.df.columns == ["time_ts", "value"]
    whole = ev.alert_series(d, RunContext(spark, datetime(2024, 1, 31), ts="ts"))
    assert whole.time_range is None and whole.df.agg(F.sum("value")).first()[0] == events.where("event_type = 'error'").count()


@pytest.mark.parametrize("lag, back", [(0, 0), (1, 0), (0, 1200), (1, 90), (0, 3600)])
def test_the_clock_is_set_back_by_any_time(spark, lag, back):
    d = dfn.AlertDefinition(dfn.AlertId("g", "k"), Width.parse("15 minutes"), lag, value_gt=1.0, back=back)
    for minute in (0, 7, 14, 15, 44):
        now = datetime(2023, 8, 15, 10, minute, 30)
        seconds = int((now - datetime(1970, 1, 1)).total_seconds()) - 900 * lag - back
        assert ev.live_bucket(d, now) == seconds // 900 * 900
        at_tick = dfn.definitions_df(spark, [d]).withColumn("tick", F.lit(seconds + 900 * lag + back).cast("long"))
        assert at_tick.select(ev.tick_bucket()).first()[0] == seconds // 900 * 900
        assert ev.live_bucket(d, now) >= int((ev.replay_span([d], now, now)[0].replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()) - 900


COLUMNS = ["alert_id_group", "alert_id_key", "timestamp", "status", "message", "value"]


def test_alerts_of_one_text_share_one_scan(spark, events):
    events.createOrReplaceTempView("events")
    now = datetime(2024, 1, 20, 14, 37)
    alerts = [replace(definition(kind, value_gt=float(i)), id=dfn.AlertId("g", f"{kind}{i}")) for kind in ("error", "click", "none", "view", "it's")
              for i in range(10)]
    alerts += [replace(definition("view", lag=1, value_lt=2.0), id=dfn.AlertId("g", "late"))]
    shared = ev.evaluate_live(spark, alerts[:50], now)
    assert plan_of(shared).count("FileScan") == 1 and "GreaterThanOrEqual(ts,2024-01-20T14:00)" in plan_of(shared)
    some = alerts[:50:7] + alerts[50:]
    alone = [tuple(r) for d in some for r in ev.evaluate_live(spark, [d], now).select(COLUMNS).collect()]
    together = {r.alert_id_key: tuple(r) for r in ev.evaluate_live(spark, alerts, now).select(COLUMNS).collect()}
    assert len(together) == 51 and [together[d.id.key] for d in some] == alone
    span = ev.replay_span(alerts, datetime(2024, 1, 10), datetime(2024, 1, 11))
    metrics = ev.sql_metrics(spark, alerts[:50], span)
    assert plan_of(metrics).count("FileScan") == 1
    for d in alerts[:50:13]:
        single = sorted(map(tuple, ev.sql_metrics(spark, [d], span).collect()))
        assert sorted(map(tuple, metrics.where(F.col("alert_id_key") == d.id.key).collect())) == single


def test_markers_in_any_place_of_a_text(spark, events):
    events.createOrReplaceTempView("events")
    text = """SELECT 0 AS time_ts, sum(CASE WHEN event_type = :kind THEN :weight ELSE 0 END) AS value, :weight * 2 AS alert_if_value_gt
      FROM events WHERE ':kind' <> ":weight" /* :kind */ AND event_id::int >= 0 -- :weight and it's
      """
    alerts = [dfn.AlertDefinition(dfn.AlertId("g", f"{k}{w}"), Width.parse("1 hour"), query=text, params={"kind": k, "weight": w}, value_gt=1.0)
              for k in ("error", "view") for w in (2, 3)]
    found = {r.alert_id_key: (r.value, r.alert_if_value_gt) for r in ev.sql_metrics(spark, alerts).collect()}
    n = {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert found == {f"{k}{w}": (float(n[k] * w), 2.0 * w) for k in ("error", "view") for w in (2, 3)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("alert_parameters")]


def test_texts_that_cannot_be_correlated_still_run(spark, events):
    events.createOrReplaceTempView("events")
    text = "WITH e AS (SELECT * FROM events WHERE event_type = :kind LIMIT 7) SELECT 0 AS time_ts, count(*) AS value FROM e"
    alerts = [dfn.AlertDefinition(dfn.AlertId("g", k), Width.parse("1 hour"), query=text, params={"kind": k}, value_gt=1.0)
              for k in ("error", "view", "none")]
    assert {r.alert_id_key: r.value for r in ev.sql_metrics(spark, alerts).collect()} == {"error": 7.0, "view": 7.0, "none": 0.0}


@pytest.mark.parametrize("measure", ["count(*)", "sum(value)", "min(value + 1)", "max(value)", "avg(CASE WHEN value > 20 THEN value END)"])
def test_widths_of_one_family_share_one_scan(events, measure):
    alerts = [dfn.AlertDefinition(dfn.AlertId("g", f"{kind} {width}"), Width.parse(width), params={"event_type": kind}, value_gt=1.0)
              for kind in ("error", "click") for width in ("20 minutes", "1 hour", "1 week", "45 minutes")]
    mixed = ev.family_metrics(events, alerts, "ts", {"event_type": "event_type"}, measure)
    assert plan_of(mixed).count("FileScan") == 1
    single = None
    for width in {d.width for d in alerts}:
        one = ev.family_metrics(events, [d for d in alerts if d.width == width], "ts", {"event_type": "event_type"}, measure)
        single = one if single is None else single.unionByName(one)
    rounded = lambda df: sorted((r.alert_id_key, r.time_ts, r.value and round(r.value, 6)) for r in df.collect())
    assert rounded(mixed) == rounded(single)
    unfiltered = [replace(d, params={}) for d in alerts if d.params["event_type"] == "error"]
    total = ev.family_metrics(events, unfiltered, "ts", {}, "count(*)").where("alert_id_key LIKE '%week'").agg(F.sum("value")).first()[0]
    assert total == events.count()


@pytest.mark.parametrize("measure", ["count(DISTINCT user_id)", "percentile(value, 0.5)", "count(*) + sum(value)", "sum(value) / count(*)", "1"])
def test_measures_that_cannot_be_merged_need_one_width(events, measure):
    alerts = [dfn.AlertDefinition(dfn.AlertId("g", w), Width.parse(w), params={"event_type": "error"}, value_gt=1.0) for w in ("1 hour", "1 day")]
    with pytest.raises(ValueError, match="widths"):
        ev.family_metrics(events, alerts, "ts", {"event_type": "event_type"}, measure)
    assert ev.family_metrics(events, alerts[:1], "ts", {"event_type": "event_type"}, measure).count() > 0


# -- log ------------------------------------------------------------------------------------------

RESULTS = "alert_id_group string, alert_id_key string, timestamp timestamp_ntz, status string, message string, value double"


def sequential(rows, current=None):
    """The rule applied one result after the other."""
    last, kept = dict(current or {}), []
    for g, k, t, status, *_ in sorted(rows, key=lambda r: r[2]):
        if last.get((g, k)) != (status, t.date()):
            kept.append((g, k, t, status))
            last[(g, k)] = (status, t.date())
    return set(kept), last


def random_results(seed, n=400):
    rnd = random.Random(seed)
    used, out = set(), []
    while len(out) < n:
        k, t = f"k{rnd.randrange(5)}", datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(7200))
        if (k, t) not in used:
            used.add((k, t))
            out.append(("g", k, t, rnd.choice(["OK", "OK", "error", "warn"]), "", 0.0))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_equal_the_sequential_rule(spark, seed):
    rows = random_results(seed)
    cut = sorted(r[2] for r in rows)[len(rows) // 2]
    first, rest = [r for r in rows if r[2] <= cut], [r for r in rows if r[2] > cut]
    key = lambda df: {(r.alert_id_group, r.alert_id_key, r.timestamp, r.status) for r in df.collect()}
    early = alog.changes(spark.createDataFrame(first, RESULTS))
    want, state = sequential(first)
    assert key(early) == want
    late = alog.changes(spark.createDataFrame(rest, RESULTS), alog.current_status(early))
    assert key(late) == sequential(rest, state)[0]


def test_log_append_current_history_and_clear(spark, tmp_path):
    store = alog.AlertLog(spark, str(tmp_path / "log"))
    store.clear()
    assert store.read().count() == 0
    t = datetime(2025, 4, 4, 15, 0, 1)
    step = lambda when, status, message: store.append(alog.changes(
        spark.createDataFrame([("g1", "k1", when, status, message, 1.0)], RESULTS), store.current()))
    step(t, "warn", "Warning 1")
    step(t + timedelta(minutes=1), "warn", "repeated")
    assert store.read().count() == 1
    step(datetime(2025, 4, 5, 0, 5, 1), "warn", "next day")
    step(datetime(2025, 4, 5, 0, 6, 1), "OK", "")
    latest = store.current().first()
    assert (latest.latest_status, latest.latest_message) == ("OK", "")
    intervals = alog.history(store.read(), datetime(2025, 4, 6), "G%").orderBy("start").collect()
    assert [i.end for i in intervals] == [datetime(2025, 4, 5, 0, 5, 1), datetime(2025, 4, 5, 0, 6, 1), datetime(2025, 4, 6)]
    assert alog.history(store.read(), datetime(2025, 4, 6), "x%").count() == 0
    store.clear()
    assert store.read().count() == 0


def test_failed_notification_becomes_an_error(spark):
    def send(row):
        if row["alert_id_key"] == "k2":
            raise RuntimeError("no route")

    rows = [("g", "k1", datetime(2024, 1, 1), "OK", "fine", 1.0), ("g", "k2", datetime(2024, 1, 1), "OK", "fine", 1.0)]
    out = {r.alert_id_key: (r.status, r.message) for r in alog.notify(spark.createDataFrame(rows, RESULTS), send).collect()}
    assert out == {"k1": ("OK", "fine"), "k2": ("error", "Error triggering notifier: no route")}


def test_modules_of_notifiers_are_importable_from_the_shipped_code(tmp_path):
    shipped = []
    ship_code(SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=shipped.append)), "suite")
    code = "import pickle, suite.alerts as a; assert '.zip' in a.__file__; pickle.loads(pickle.dumps(a.refuse_late_ones))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": shipped[0]}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_retention_prunes(spark):
    df = spark.createDataFrame([(datetime(2023, 1, 1),), (datetime(2024, 1, 2),)], "t timestamp_ntz")
    assert alog.within_retention(df, "t", datetime(2024, 12, 31)).count() == 1


def test_reason_looks_across_midnight(spark):
    rows = [("2024-01-01 22:00:00", "OK"), ("2024-01-01 23:00:00", "OK"), ("2024-01-02 00:00:00", "error"),
            ("2024-01-03 00:00:00", "error"), ("2024-01-03 01:00:00", "OK")]
    df = spark.createDataFrame([("g", "k", t, s, "") for t, s in rows],
                               "alert_id_group string, alert_id_key string, timestamp string, status string, message string")
    kept = alog.changes(df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))).orderBy("timestamp").collect()
    assert [(r.timestamp.day, r.timestamp.hour, r.reason) for r in kept] == [
        (1, 22, "daily"), (2, 0, "change"), (3, 0, "daily"), (3, 1, "change")]


def test_cron_names():
    assert parse_cron("0 9 ? jan,MAR MON-FRI") == parse_cron("0 9 * 1,3 1-5")
    assert parse_cron("0 0 * * fri-SUN").weekday == frozenset({5, 6, 0}) and parse_cron("0 0 * * sun").weekday == frozenset({0})
    with pytest.raises(ValueError):
        parse_cron("0 0 * * MOND")

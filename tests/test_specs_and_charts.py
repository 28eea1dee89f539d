import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bucketwise.functions import fields as fld
from bucketwise.operators.filters import FilterState, TimeRange
from bucketwise.plans import charts as ch
from bucketwise.plans.spec import QuerySpec, RunContext, compile_query, from_table, query_from_json, query_to_json
from bucketwise.sources import sqltext
from tests.conftest import plan_of

NOW = datetime(2024, 1, 31)
TIME, CNT = fld.auto_bucket("ts"), fld.count()


@pytest.fixture
def ctx(spark, events):
    events.createOrReplaceTempView("events")
    return RunContext(spark, NOW, FilterState(TimeRange("720h")), {"events": events}, ts="ts")


@pytest.mark.parametrize("field", [
    fld.field("a + 1", "b"), fld.count("logs"), fld.enum("level"), fld.enum("level").with_alias("lvl"),
    fld.auto_bucket("ts"), fld.auto_bucket("ts", "bucket"), fld.every("ts", "1 hour"),
    fld.json_text("payload", "user", "id"), fld.time_field("f(ts)", "t", 1000)])
def test_field_round_trip(field):
    assert fld.Field.from_dict(json.loads(json.dumps(field.to_dict()))) == field


def test_bad_fields():
    with pytest.raises(ValueError):
        fld.Field.from_dict({"kind": "banana"})
    with pytest.raises(ValueError):
        fld.Field.from_dict({"kind": "autoBucket"})
    assert fld.Field.from_dict(None) is None


@pytest.mark.parametrize("query", [
    from_table("logs").filtering("level = 'error' OR level = 'fatal'"),
    from_table("logs", TIME, CNT).grouping(TIME).ordering(TIME).limiting(100),
    from_table("metrics", fld.max_of("pct", "pct")).ordering(fld.ref("time")).filling("1 hour").on_catalog("a").unfiltered(),
    sqltext.from_file("q.sql").with_where("a"), sqltext.from_string("x {{FILTERS}}").with_auto_bucket(),
    sqltext.from_string_unfiltered("SELECT 1")])
def test_query_round_trip(query):
    assert query_from_json(query_to_json(query)) == query


def test_unknown_query_kind():
    assert query_from_json("null") is None
    with pytest.raises(ValueError):
        query_from_json('{"kind": "nope"}')


def test_deriving_leaves_the_original_alone():
    base = from_table("t", CNT)
    base.filtering("a").grouping(TIME)
    assert base == from_table("t", CNT)
    chart = ch.Chart("timeBar", base, x=TIME, y=CNT)
    assert chart.derive(fill=fld.enum("k")).fill is not None and chart.fill is None


def test_limit_zero_removes_and_later_wins(ctx):
    spec = from_table("events").limiting(5)
    assert compile_query(spec, ctx).df.count() == 5
    assert compile_query(spec.limiting(3), ctx).df.count() == 3
    assert "Limit" not in plan_of(compile_query(spec.limiting(0), ctx).df)


ALL = dict(fill=fld.enum("event_type"), fx=fld.field("user_id % 2", "fx"), fy=fld.field("user_id % 3", "fy"))


@pytest.mark.parametrize("chart, columns", [
    (ch.Chart("timeBar", from_table("events"), x=TIME, y=CNT), ["time", "cnt"]),
    (ch.Chart("timeBar", from_table("events"), x=TIME, y=CNT, **ALL), ["fy", "fx", "event_type", "time", "cnt"]),
    (ch.Chart("timeLine", from_table("events"), x=TIME, y=CNT, stroke=fld.enum("event_type"), z=fld.field("user_id % 2", "z")),
     ["z", "event_type", "time", "cnt"]),
    (ch.Chart("barVertical", from_table("events"), x=fld.enum("event_type"), y=CNT, fx=ALL["fx"]), ["fx", "event_type", "cnt"]),
    (ch.Chart("barHorizontal", from_table("events"), x=CNT, y=fld.enum("event_type"), fill=ALL["fx"]), ["fx", "event_type", "cnt"]),
    (ch.Chart("timeHeatmap", from_table("events"), x=TIME, y=fld.field("value"), fill=CNT), ["value", "time", "cnt"]),
    (ch.Chart("timeHeatmapOrdinal", from_table("events"), x=TIME, y=fld.enum("event_type")), ["event_type", "time"])])
def test_column_order(ctx, chart, columns):
    assert chart.run(ctx).df.columns == columns
    assert ch.Chart.from_dict(json.loads(json.dumps(chart.to_dict()))) == chart


def test_rows_are_ordered_and_sum_to_the_total(ctx, events):
    rows = ch.Chart("timeBar", from_table("events"), x=TIME, y=CNT, fill=ALL["fill"]).run(ctx).df.collect()
    keys = [(r.time, r.event_type) for r in rows]
    assert keys == sorted(keys)
    assert sum(r.cnt for r in rows) == events.count()


@pytest.mark.parametrize("text", [
    '{"type": "nope", "props": {}}', '{"type": "timeBar", "props": {}}',
    '{"type": "barHorizontal", "props": {"sql": {"kind": "table", "table": "", "where": []}}}',
    '{"type": "timeBar", "props": {"sql": {"kind": "table", "table": "events"}, '
    '"x": {"kind": "enum", "definition": "event_type", "alias": "e"}, "y": {"kind": "count", "definition": "count(*)", "alias": "c"}}}'])
def test_incomplete_charts_raise(ctx, text):
    with pytest.raises(ValueError):
        ch.run_chart(text, ctx)


def test_dashboard_skips_what_draws_no_data(ctx):
    bar = ch.Chart("timeBar", from_table("events"), x=TIME, y=CNT).to_dict()
    result = ch.run_dashboard({"title": "t", "widgets": [
        {"type": "markdown", "props": {}},
        {"type": "checkboxGroup", "props": {"name": "kinds", "defaults": ["error"]}},
        {"type": "collapsibleGroup", "props": {"widgets": [bar, {"type": "alertOverview", "props": {}}]}}]}, ctx)
    assert list(result.charts) == ["2.0:timeBar"] and len(result.notes) == 2
    assert ch.default_params([{"type": "checkboxGroup", "props": {"name": "k", "defaults": ["a"]}}]) == {"k": '["a"]'}


def test_charts_of_a_dashboard_share_one_scan(ctx, monkeypatch):
    counted = fld.field("count(*) + 0", "n")
    mean, kind = fld.field("round(avg(value), 6)", "mean"), fld.enum("event_type")
    charts = [ch.Chart("timeBar", from_table("events"), x=TIME, y=CNT, fill=kind),
              ch.Chart("timeLine", from_table("events").filtering("value > 20", "user_id > 3"), x=TIME, y=mean, stroke=kind, fill_step="1 hour"),
              ch.Chart("barVertical", from_table("events").filtering("event_type <> 'error'"), x=kind, y=counted),
              ch.Chart("barVertical", from_table("events"), x=kind, y=CNT),
              ch.Chart("stats", from_table("events", fld.field("max(value)", "most")), title=kind),
              ch.Chart("timeBar", from_table("events"), x=fld.every("ts", "1 day"), y=fld.distinct_of("user_id", "users", exact=True)),
              ch.Chart("table", from_table("events"), limit=5)]
    scans = []
    whole = type(ctx).table
    monkeypatch.setattr(type(ctx), "table", lambda self, name, catalog=None: scans.append(name) or whole(self, name, catalog))
    result = ch.run_dashboard({"widgets": [c.to_dict() for c in charts]}, ctx)
    assert len(scans) == 3  # together, the exact distinct count, the list of rows
    for chart, got in zip(charts[:5], result.charts.values(), strict=False):
        want = chart.run(ctx)
        assert "FileScan" not in plan_of(got.df) and got.df.columns == want.df.columns and got.bucket_ms == want.bucket_ms
        assert got.df.count() > 0 and sorted(map(str, got.df.collect())) == sorted(map(str, want.df.collect()))
    assert [c.df.count() > 0 for c in list(result.charts.values())[5:]] == [True, True]


def test_two_buckets_in_one_query(ctx):
    other = fld.every("ts", "1 day", "day")
    spec = from_table("events", TIME, other, CNT).grouping(TIME, other)
    row = compile_query(spec, ctx).df.orderBy("time").first()
    assert row.day <= row.time


def test_one_pass_over_the_table(ctx):
    plan = plan_of(ch.Chart("timeLine", from_table("events"), x=TIME, y=CNT, stroke=ALL["fill"], fill_step="1 hour").run(ctx).df)
    assert plan.count("FileScan") == 1 and "Cartesian" not in plan and "BatchEvalPython" not in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_processed_results_skip_the_sort(ctx):
    chart = ch.Chart("timeBar", from_table("events"), x=TIME, y=CNT, fill=ALL["fill"])
    out = ch.shares(chart, chart.run(ctx, ordered=False))
    out.collect()
    plan = plan_of(out).split("== Initial Plan ==")[0]  # as it ran: the totals use the chart's own groups again
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan and "rangepartitioning" not in plan


def test_chart_over_a_frame(events):
    from datetime import timedelta

    chart = ch.Chart("timeBar", x=TIME, y=CNT)
    span = FilterState(TimeRange(start=NOW - timedelta(days=1), end=NOW))
    result = chart.over(events, NOW, span, ts="ts")
    assert result.bucket_ms == 300_000 and result.df.columns == ["time", "cnt"] and chart.query is None


def test_filters_without_a_range_use_the_default_width(ctx, spark, events):
    open_ctx = RunContext(spark, NOW, tables={"events": events}, ts="ts")
    assert ch.Chart("timeBar", from_table("events"), x=TIME, y=CNT).run(open_ctx).bucket_ms == 900_000
    assert compile_query(from_table("events", CNT), open_ctx).bucket_ms is None


def test_auto_chart(spark, events):
    assert ch.auto_chart("e", events).type == "timeBar"
    assert ch.auto_chart("e", events.select("event_type")).type == "barVertical"
    assert ch.auto_chart("e", events.select("value")).type == "table"


def test_folded_stacks(spark):
    df = spark.createDataFrame([("a;b", 2), ("a;b", 3), ("a", 1)], "s string, n int")
    assert sorted(r.value for r in ch.folded_stacks(df, "s", "n").collect()) == ["a 1", "a;b 5"]


def test_catalog_prefix():
    assert QuerySpec("t").on_catalog("cat.db").catalog == "cat.db"
    assert F is not None

from datetime import datetime, timedelta

import pytest

from bucketwise.operators import filters as flt
from bucketwise.sources import sqltext
from tests.conftest import plan_of

NOW = datetime(2024, 1, 31)


def test_presets_and_errors():
    span = flt.TimeRange("24h").resolve(NOW)
    assert (span.start, span.end, span.seconds) == (datetime(2024, 1, 30), NOW, 86400)
    assert span.to_ms - span.from_ms == 86_400_000
    assert span.bind() == {"__from": span.from_ms // 1000, "__to": span.to_ms // 1000}
    for bad in (flt.TimeRange("2y"), flt.TimeRange(custom="yesterday"), flt.TimeRange(custom="a to b"), flt.TimeRange()):
        with pytest.raises(ValueError):
            bad.resolve(NOW)


def test_custom_range_uses_the_given_zone():
    span = flt.TimeRange(custom="2024-07-01 12:00 to 2024-07-01 13:30").resolve(NOW, "Europe/Berlin")
    assert (span.start, span.end) == (datetime(2024, 7, 1, 10), datetime(2024, 7, 1, 11, 30))


def test_filter_state_round_trip_and_immutability():
    state = flt.FilterState(flt.TimeRange("1h"), ("a = 1",))
    more = state.add("b = 2 OR c = 3")
    assert state.where == ("a = 1",) and more.where[-1] == "b = 2 OR c = 3"
    assert flt.FilterState.from_dict(more.to_dict()) == more
    assert flt.join_clauses([]) == "1=1"
    assert flt.join_clauses(["a", "b OR c"]) == "(a) AND (b OR c)"


def test_templates_bind_values_safely():
    assert flt.PredicateTemplate("user", "user_id = ...").bind(5) == "user_id = 5"
    assert flt.PredicateTemplate("like", "path LIKE '%...%'").bind("o'x") == "path LIKE '%o\\'x%'"
    assert flt.PredicateTemplate("fixed", "a = 1").bind() == "a = 1"
    with pytest.raises(ValueError):
        flt.PredicateTemplate("user", "user_id = ...").bind()


def test_quoted_values_do_not_escape(spark):
    df = spark.createDataFrame([("it's \\ fine",), ("x",)], "s string")
    assert df.where(flt.equals("s", "it's \\ fine")).count() == 1
    assert df.where(flt.contains("s", "'s \\")).count() == 1


def test_time_filter_reaches_the_reader(events):
    plan = plan_of(flt.FilterState(flt.TimeRange("24h")).apply(events, "ts", NOW).select("event_id"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


def test_recent_is_strict_and_explicit_where_wins(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-30 00:00:00'), (2, TIMESTAMP_NTZ'2024-01-30 00:00:01') t(id, ts)")
    assert [r.id for r in flt.recent(df, timedelta(days=1), NOW).collect()] == [2]
    assert [r.id for r in flt.recent(df, timedelta(days=1), NOW, where="id = 1").collect()] == [1]
    assert flt.recent(df.select("id"), timedelta(days=1), NOW).count() == 2


def test_null_dimensions_match(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), (NULL, 2), ('b', 3) t(d, id)")
    wanted = spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING)), ('b') t(d)")
    assert sorted(r.id for r in flt.matching_dims(df, wanted, ["d"]).collect()) == [2, 3]


def test_search(spark):
    df = spark.sql("SELECT * FROM VALUES ('Alpha', 10), ('beta', 25), (NULL, 25) t(name, n)")
    assert flt.search_columns(df, "ALPHA").count() == 1
    assert flt.search_columns(df, "25").count() == 2
    assert flt.search_each(df, {"name": "BET", "n": "2"}).count() == 1
    assert df.where(flt.any_selected("name", "[]")).count() == 0
    assert df.where(flt.starts_with_pattern("name", "")).count() == 3


def test_text_needs_the_filter_token(tmp_path):
    with pytest.raises(ValueError):
        sqltext.from_string("SELECT 1").render()
    assert sqltext.from_string_unfiltered("SELECT 1;\n").render() == "SELECT 1"
    text = sqltext.from_string("SELECT * FROM t WHERE {{FILTERS}}")
    assert text.render().endswith("WHERE 1=1")
    assert text.with_where("a = 1", "b").render().endswith("WHERE (a = 1) AND (b)")
    file = tmp_path / "q.sql"
    file.write_text("SELECT 1")
    with pytest.raises(ValueError):
        sqltext.from_file(str(file)).render()
    assert sqltext.from_file_unfiltered(str(file)).render() == "SELECT 1"


def test_bucket_token_is_opt_in():
    text = sqltext.from_string("SELECT {{BUCKET:ts}} AS t FROM e WHERE {{FILTERS}}")
    with pytest.raises(ValueError):
        text.resolve(3600).render()
    with pytest.raises(ValueError):
        text.with_auto_bucket().render()
    assert "window(ts, '60 seconds').start" in text.with_auto_bucket().resolve(3600).render()


def test_typed_parameters():
    assert sqltext.typed_params({"a": "1", "b": "x", "c": "true"}, {"a": "Int64", "c": "Bool"}) == {"a": 1, "b": "x", "c": True}
    with pytest.raises(ValueError):
        sqltext.typed_params({"a": "1"}, {"a": "Shape"})

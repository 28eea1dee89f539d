import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from bucketwise.alerting.definitions import AlertDefinition, AlertId
from bucketwise.alerting.log import AlertLog, changes
from bucketwise.functions.buckets import Width
from bucketwise.operators import anonymize as an
from bucketwise.session import scratch_path
from bucketwise.streaming import live
from tests.test_alerts import RESULTS, random_results

T0 = datetime(2024, 1, 1)


def files(spark, df, label, parts=1):
    path = scratch_path(spark, label)
    for i in range(parts):
        df.where(F.abs(F.hash(*df.columns)) % parts == i).coalesce(1).write.mode("append").parquet(path)
    return live.file_stream(spark, path, df.schema, files_per_trigger=1)


def test_bounded_stream_equals_batch(spark, events):
    wide = live.live_series(files(spark, events, "in", 3), "ts", ["event_type"], "1 hour", "40 days")
    out = scratch_path(spark, "updates")
    live.run_batches(wide, "upd", lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out), "update")
    last = spark.read.parquet(out).groupBy("time", "event_type").agg(F.max_by("y", "batch").alias("y"))
    batch = events.groupBy(F.window("ts", "1 hour").start.alias("time"), "event_type").agg(F.count("*").alias("y"))
    assert last.exceptAll(batch).count() == 0 and batch.exceptAll(last).count() == 0
    assert dict(wide.dtypes)["time"] == "timestamp_ntz"


def test_change_feed_equals_batch_over_several_triggers(spark):
    rows = sorted(random_results(11, 300), key=lambda r: r[2])
    path = scratch_path(spark, "results")
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, RESULTS).coalesce(1).write.mode("append").parquet(path)
        spark.range(1).count()
    stream = live.file_stream(spark, path, spark.createDataFrame(rows[:1], RESULTS).schema, files_per_trigger=1)
    got = live.run_available(live.change_feed(stream), "feed", custom_state=True)
    want = changes(spark.createDataFrame(rows, RESULTS))
    columns = ["alert_id_key", "timestamp", "status", "reason"]
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0
    assert want.select(columns).exceptAll(got.select(columns)).count() == 0


def test_silence_is_noticed_through_the_heartbeat(spark):
    schema = "ts timestamp_ntz"
    busy = [(T0 + timedelta(minutes=m),) for m in (5, 20, 130, 200)]
    beats = [(T0 + timedelta(minutes=m),) for m in range(0, 300, 30)]
    stream = live.with_heartbeat(files(spark, spark.createDataFrame(busy, schema), "busy"),
                                 files(spark, spark.createDataFrame(beats, schema), "beats"), "ts")
    metric = live.live_metric(stream, "ts", "1 hour", "1 minute", "sum(weight)")
    store = AlertLog(spark, scratch_path(spark, "log"))
    store.clear()
    rule = AlertDefinition(AlertId("g", "silence"), Width.parse("1 hour"), 1, value_lt=1.0, message="silent")
    live.run_batches(metric, "silence", live.alert_writer([rule], store), "append")
    got = [(r.timestamp.hour, r.status) for r in store.read().orderBy("timestamp").collect()]
    assert got == [(1, "OK"), (2, "error"), (3, "OK")]


def test_several_rules_over_one_metric(spark):
    metric = spark.createDataFrame([(0, 5.0), (3600, 0.0)], "time_ts long, value double")
    rules = [AlertDefinition(AlertId("g", "high"), Width.parse("1 hour"), 0, value_gt=3.0, message="h"),
             AlertDefinition(AlertId("g", "low"), Width.parse("1 hour"), 1, value_lt=1.0, message="l")]
    got = {(r.alert_id_key, r.timestamp.hour): r.status for r in live.judge_batch(metric, rules).collect()}
    assert got == {("high", 0): "error", ("high", 1): "OK", ("low", 1): "OK", ("low", 2): "error"}


def test_stream_anonymizer_equals_batch(spark):
    df = spark.createDataFrame([("a@b.org", 1), ("fine", 2)], "message string, n int")
    got = live.run_available(live.anonymize_stream(files(spark, df, "pii"), an.default_rules()), "clean")
    assert got.exceptAll(an.anonymize(df, an.default_rules())).count() == 0 and got.count() == 2


SERIES = "k string, time timestamp_ntz, y long"


def batch_rows(rnd, number, size=6):
    """Rows of the last hours before a batch's time, now and then of any earlier day or without a time."""
    out = {}
    for _ in range(size):
        hours = rnd.randrange(max(0, number - 30), number + 1) if rnd.random() < 0.9 else rnd.randrange(number + 1)
        out[rnd.choice("abc"), None if rnd.random() < 0.03 else T0 + timedelta(hours=hours)] = rnd.randrange(1000)
    return out


def table_of(df):
    rows = [((r.k, r.time), r.y) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_a_running_table_stays_small(spark, tmp_path):
    rnd, want, files = random.Random(4), {}, []
    store = live.RunningTable(spark, str(tmp_path / "t"), ["k", "time"], "time", compact_every=4, tasks_a_day=1)
    assert not store.exists()
    for number in range(48):
        rows = batch_rows(rnd, number)
        if number % 13:
            want.update(rows)
        frame = spark.createDataFrame([(k, t, y) for (k, t), y in rows.items()] if number % 13 else [], SERIES).coalesce(1)
        store.write(frame, number)
        if number % 12 == 11:
            assert table_of(store.read()) == want
            since = T0.date() + timedelta(days=number // 30)
            assert table_of(store.read(since)) == {key: y for key, y in want.items() if key[1] is None or key[1].date() >= since}
            files.append((len(store.read().inputFiles()), len([f for f in (tmp_path / "t").rglob("*.parquet")])))
    days = 48 // 24 + 2
    assert max(read for read, _ in files) <= days + 5 * 3 and max(kept for _, kept in files) <= 2 * days + 2 * 5 * 3
    store.write(spark.createDataFrame([("a", T0, 5)], SERIES), 48)
    store.write(spark.createDataFrame([("a", T0, 6)], SERIES), 48)  # the same batch again
    assert table_of(store.read())["a", T0] == 6


@pytest.mark.parametrize("failing", ["put", "write", "remove"])
def test_a_failed_compaction_loses_nothing(spark, tmp_path, monkeypatch, failing):
    rnd, want = random.Random(5), {}
    store = live.RunningTable(spark, str(tmp_path / "t"), ["k", "time"], "time", compact_every=3, tasks_a_day=1)

    def add(number):
        rows = batch_rows(rnd, number)
        want.update(rows)
        store.write(spark.createDataFrame([(k, t, y) for (k, t), y in rows.items()], SERIES).coalesce(1), number)

    def fail(*_):
        raise OSError("lost")

    for number in range(7):
        add(number)
    with monkeypatch.context() as broken:
        if failing == "put":  # everything is written, the manifest isn't
            broken.setattr(store._files, "put", fail)
        elif failing == "write":  # half of the days are written
            whole = store._newest
            broken.setattr(store, "_newest", lambda stored: whole(stored).withColumn("y", F.expr(
                "CASE WHEN k = 'a' THEN CAST(raise_error('lost') AS BIGINT) ELSE y END")))
        else:  # the manifest is there, what it replaces isn't gone
            broken.setattr(store._files, "remove", fail)
        failures = 0
        for number in range(7, 11):
            try:
                add(number)
            except Exception as error:  # noqa: BLE001
                assert "lost" in str(error)
                failures += 1
        assert failures
    assert table_of(store.read()) == want
    for number in range(11, 17):
        add(number)
    assert table_of(store.read()) == want
    assert len(list((tmp_path / "t" / "batches").iterdir())) <= 9


def test_readers_at_work_keep_their_files(spark, tmp_path):
    store = live.RunningTable(spark, str(tmp_path / "t"), ["k", "time"], "time", compact_every=3)
    for number in range(8):
        store.write(spark.createDataFrame([("a", T0 + timedelta(hours=number), number)], SERIES), number)
    early = store.read()
    for number in range(8, 11):  # one more compaction
        store.write(spark.createDataFrame([("a", T0 + timedelta(hours=number), number)], SERIES), number)
    assert len(table_of(early)) == 8 and len(table_of(store.read())) == 11

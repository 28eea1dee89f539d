from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from bucketwise.functions.buckets import Width, bucket, bucket_sql, epoch_bucket, per_second, pick_width


@pytest.mark.parametrize("seconds, width", [
    (60, 1), (3600, 60), (86400, 300), (2592000, 3600), (365 * 86400, 86400), (0, 1), (721, 1), (722, 60),
    (722 * 86400, 604800), (10 ** 10, 604800)])
def test_ladder(seconds, width):
    assert pick_width(seconds) == width


@pytest.mark.parametrize("text, seconds", [("15 minutes", 900), ("1 hour", 3600), ("hour", 3600), ("2 weeks", 1209600), (5, 5)])
def test_width_parsing(text, seconds):
    assert Width.parse(text).seconds == seconds


@pytest.mark.parametrize("text", ["", "fast", "0 minutes", "0 months", 0, -5])
def test_bad_widths(text):
    with pytest.raises(ValueError):
        Width.parse(text)


def test_buckets_keep_the_type_and_weeks_start_on_sunday(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-10 10:44:20' AS ts")
    row = df.select(bucket("ts", "15 minutes").alias("a")).withColumn("ts", F.lit("2024-01-10 10:44:20").cast("timestamp_ntz")) \
        .withColumn("w", bucket("ts", "1 week")).withColumn("m", bucket("ts", "month")).first()
    assert row.a == datetime(2024, 1, 10, 10, 30)
    assert row.w == datetime(2024, 1, 7) and row.w.weekday() == 6
    assert row.m == datetime(2024, 1, 1)
    assert dict(df.select(bucket("ts", "1 hour").alias("b")).dtypes) == {"b": "timestamp_ntz"}
    by_sql = spark.sql(f"SELECT {bucket_sql('ts', '1 week')} AS w FROM VALUES (TIMESTAMP_NTZ'2024-01-10 10:44:20') t(ts)")
    assert by_sql.first().w == row.w


@pytest.mark.parametrize("at, width, lag, expected", [
    ("10:14:30", "15 minutes", 0, "10:00:00"), ("10:17:45", "15 minutes", 0, "10:15:00"),
    ("10:31:20", "15 minutes", 0, "10:30:00"), ("10:44:20", "15 minutes", 0, "10:30:00"),
    ("10:14:30", "15 minutes", 1, "09:45:00"), ("10:17:45", "15 minutes", 1, "10:00:00"),
    ("10:31:20", "15 minutes", 1, "10:15:00"), ("10:14:30", "1 hour", 0, "10:00:00"),
    ("10:59:59", "1 hour", 0, "10:00:00"), ("11:00:01", "1 hour", 0, "11:00:00")])
def test_buckets_of_execution_times(spark, at, width, lag, expected):
    df = spark.sql(f"SELECT unix_timestamp(TIMESTAMP'2023-08-15 {at}') AS s, unix_timestamp(TIMESTAMP'2023-08-15 {expected}') AS e")
    row = df.select(epoch_bucket("s", width, lag).alias("b"), "e").first()
    assert row.b == row.e


def test_rate(spark):
    assert spark.range(1).select(per_second(F.lit(1800), 900_000).alias("r")).first().r == 2.0


def plain_bucket(at, months, origin):
    number = at.year * 12 + at.month - 1 - origin
    number = number // months * months + origin
    return datetime(number // 12, number % 12 + 1, 1)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
@pytest.mark.parametrize("width, months, origin", [("month", 1, 0), ("2 months", 2, 0), ("quarter", 3, 0), ("7 months", 7, 22800), ("3 years", 36, 0)])
def test_calendar_buckets_keep_the_type_on_both_paths(spark, kind, width, months, origin):
    df = spark.sql(f"SELECT CAST(t AS {kind}) AS ts FROM VALUES (TIMESTAMP_NTZ'2024-02-29 23:59:59.5'), (TIMESTAMP_NTZ'1999-12-31 00:00:00'), "
                   "(TIMESTAMP_NTZ'1969-03-01 05:00:00'), (NULL) v(t)")
    out = df.select("ts", bucket("ts", width).alias("a"), F.expr(bucket_sql("ts", width)).alias("b"))
    assert dict(out.dtypes) == {"ts": kind, "a": kind, "b": kind}
    for r in out.selectExpr("CAST(ts AS timestamp_ntz) AS ts", "CAST(a AS timestamp_ntz) AS a", "CAST(b AS timestamp_ntz) AS b").collect():
        assert r.a == r.b == (r.ts and plain_bucket(r.ts, months, origin))


@pytest.mark.parametrize("zone, width", [("Europe/Berlin", "1 day"), ("America/New_York", "1 week"), ("Europe/Berlin", "month"),
                                         ("America/Sao_Paulo", "1 day"), ("Asia/Kathmandu", "3 days")])
def test_days_of_a_zone(spark, zone, width):
    """Every instant of a year, hour by hour: over missing and doubled hours, also where midnight is missing (Sao Paulo)."""
    local_zone, utc = ZoneInfo(zone), ZoneInfo("UTC")
    df = spark.sql("SELECT TIMESTAMP_NTZ'2018-01-01 00:30:00' + make_dt_interval(0, CAST(id AS INT), 0, 0) AS ts FROM range(8760)")
    out = df.select("ts", bucket("ts", width, zone).alias("a"), F.expr(bucket_sql("ts", width, zone)).alias("b"),
                    bucket(F.col("ts").cast("timestamp"), width, zone).cast("timestamp_ntz").alias("c"))
    assert dict(out.dtypes)["a"] == dict(out.dtypes)["b"] == "timestamp_ntz"
    for r in out.collect():
        local = r.ts.replace(tzinfo=utc).astimezone(local_zone)
        day = local.date().toordinal() - date(1970, 1, 1).toordinal()
        if width == "month":
            first = local.date().replace(day=1)
        else:
            n, offset = {"1 day": (1, 0), "1 week": (7, 3), "3 days": (3, 0)}[width]
            first = date(1970, 1, 1) + timedelta(days=(day - offset) // n * n + offset)
        start = datetime(first.year, first.month, first.day, tzinfo=local_zone)  # the earlier one of two
        assert r.a == r.b == r.c == start.astimezone(utc).replace(tzinfo=None)


def test_hours_are_the_same_instants_in_every_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-10-27 00:30:00' + make_dt_interval(0, CAST(id AS INT), 0, 0) AS ts FROM range(5)")
    assert [r.b for r in df.select(bucket("ts", "1 hour", "Europe/Berlin").alias("b")).collect()] == [datetime(2024, 10, 27, h) for h in range(5)]

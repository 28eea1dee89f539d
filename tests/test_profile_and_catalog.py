from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.functions import schema as sch
from bucketwise.operators import profile as pr
from bucketwise.operators.anonymize import by_column, replace_with
from bucketwise.sources import catalog, sinks, tables
from tests.conftest import plan_of

NOW = datetime(2024, 1, 31)


@pytest.mark.parametrize("dtype, wanted", [
    (T.DateType(), "temporal"), (T.TimestampNTZType(), "temporal"), (T.TimestampType(), "temporal"),
    (T.IntegerType(), "continuous"), (T.DecimalType(10, 2), "continuous"), (T.DoubleType(), "continuous"),
    (T.StringType(), "categorical"), (T.BooleanType(), "categorical"), (T.ArrayType(T.StringType()), ""),
    (T.MapType(T.StringType(), T.StringType()), ""), (T.StructType([]), ""), (T.VariantType(), "")])
def test_column_classes(dtype, wanted):
    assert sch.column_class(dtype) == wanted


def test_dimensions_are_chosen():
    config = pr.ProfileConfig(preferred_dims=("event_dataset", "level"), avoided_dims=("host_name",))
    assert pr.choose_dims(["level", "x", "event_dataset"], ["x"], config) == ["event_dataset", "level"]
    assert pr.choose_dims(["a", "host_name", "b", "c", "d"], ["a", "host_name", "b", "c", "d"], config) == ["a", "b", "c"]
    assert pr.choose_dims(["a"], [], config) == []


def test_time_column_prefers_the_sort_key(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t, 1 AS n")
    assert sch.time_column(df) == "d" and sch.time_column(df, "t") == "t"
    assert sch.time_column(df.withMetadata("t", {"sort_key": 0})) == "t"
    assert sch.time_column(df.select("n")) is None
    with pytest.raises(ValueError):
        sch.require_columns(df, ["missing"])


def sample(spark, n=9000):
    """A third of the rows share one dimension tuple."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 7).cast("string"))).alias("level"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("h"), (F.col("id") % 4).cast("string"))).alias("host"),
        (F.col("id") % 2 == 0).alias("flag"), F.concat(F.lit("text "), "id").alias("message"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"), F.col("id"))


def test_profile(spark):
    df = sample(spark)
    profile = pr.profile_table(df, "logs", NOW, pr.ProfileConfig(preferred_dims=("level", "host"), tie_break=("id",)))
    stats = {r.column: r for r in profile.column_stats.collect()}
    assert stats["level"].cardinality == 8 and stats["flag"].cardinality == 2
    assert stats["message"].cardinality is None and stats["message"].cardinality_approx > 8000
    assert stats["id"].cardinality is None
    counts = {(r.value): r["count"] for r in profile.column_values.where("column = 'level'").collect()}
    want = {r.level: r["count"] for r in df.groupBy("level").count().collect()}
    assert counts == want
    got = profile.bucket_samples.collect()
    tuples = {(r.level, r.host): r["count"] for r in got}
    assert tuples == {(r.level, r.host): r["count"] for r in df.groupBy("level", "host").count().collect()}
    newest = df.where("level = 'hot' AND host IS NULL").orderBy(F.col("ts").desc()).limit(3).collect()
    assert [r.sample.id for r in sorted((r for r in got if r.level == "hot" and r.host is None), key=lambda r: r.sample_no)] \
        == [r.id for r in newest]
    plan = plan_of(profile.bucket_samples)
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_recent_profile(spark):
    config = pr.ProfileConfig(recent=timedelta(seconds=100), ts="ts", preferred_dims=("level",), tie_break=("id",))
    profile = pr.profile_table(sample(spark), "logs", datetime(2024, 1, 1, 2, 30), config)
    assert profile.column_values.where("column = 'flag'").agg(F.sum("count")).first()[0] == 99


def test_bucket_names_are_safe_and_unique(spark):
    df = spark.createDataFrame([("a b", "x"), ("a/b", "x"), ("", None), ("y" * 40, "z")], "k string, l string")
    names = [r.bucket_name for r in pr.bucket_names(df, ["l", "k"]).collect()]
    assert len(set(names)) == 4 and sum(n.startswith("k=a_b__l=x__") for n in names) == 2
    assert any(n.startswith("k=empty__l=nil__") for n in names) and any(n.startswith(f"k={'y' * 40}__l=z__") for n in names)


def test_profile_written_twice_leaves_no_stale_buckets(spark, tmp_path):
    df, path = sample(spark, 300), str(tmp_path / "p")
    config = pr.ProfileConfig(preferred_dims=("level",), tie_break=("id",))
    sinks.write_profile(pr.profile_table(df, "t", NOW, config), path)
    second = pr.profile_table(df.where("level = 'hot'"), "t", NOW, config)
    sinks.write_profile(second, path)
    back = sinks.read_profile(spark, path, second)
    assert [r.level for r in back.bucket_samples.select("level").distinct().collect()] == ["hot"]
    assert back.metadata["bucket_dimensions"] == ["level"]
    assert back.column_values.count() == second.column_values.count()


def test_no_raw_value_leaks_from_an_anonymized_profile(spark):
    df = spark.createDataFrame([("8.8.4.4", "GET", i) for i in range(5)], "ip string, method string, id int")
    profile = pr.profile_table(df, "t", NOW, pr.ProfileConfig(preferred_dims=("ip", "method"), tie_break=("id",)))
    masked = pr.anonymize_profile(profile, by_column({"ip": replace_with("x")}))
    text = str(masked.bucket_samples.collect()) + str(masked.column_values.collect())
    assert "8.8.4.4" not in text and "GET" in text


def test_catalog(spark):
    a, b = spark.range(1).withColumn("x", F.lit("1")), spark.range(1).withColumn("y", F.lit(1.0))
    a.createOrReplaceTempView("cat_a"), b.createOrReplaceTempView("cat_b")
    assert catalog.list_tables(spark, include=["CAT\\_%".replace("\\", "")]) == ["cat_a", "cat_b"]
    assert catalog.list_tables(spark, include=["cat_%"], exclude=["%b"]) == ["cat_a"]
    assert "cat_a" not in catalog.list_tables(spark, views=False)
    columns = catalog.columns_of({"a": a, "b": b}, spark)
    assert {(r.table, r.column, r["class"]) for r in columns.collect()} == {
        ("a", "id", "continuous"), ("a", "x", "categorical"), ("b", "id", "continuous"), ("b", "y", "continuous")}
    assert [r.column for r in catalog.common_columns(columns, 2).collect()] == ["id"]


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT parse_json('{\"a\": 1}') AS v, array(parse_json('[2]')) AS vs, 5 AS n")
    from bucketwise.operators.shape import export_safe

    safe = export_safe(df)
    assert [t for _, t in safe.dtypes] == ["string", "string", "int"] and safe.columns == df.columns
    assert safe.toArrow().column("v").to_pylist() == ['{"a":1}']
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "docx")
    path = str(tmp_path / "t")
    sinks.load_into(spark.range(3), path)
    sinks.load_into(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
    sinks.clear(spark.range(1), path)
    assert spark.read.parquet(path).count() == 0


def test_retention_rewrite(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.range(6).select("id", F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"))
    rows.write.partitionBy("day").parquet(path)
    assert len(sinks.purge_expired(spark, path, "day", date(2024, 1, 4))) == 3
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4, 5]


def test_json_lines_skip_blank_and_broken(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("  ",), ("{broken",), ("[1]",), ('{"a": 2, "b": 3}',)], "value string")
    assert [r.a for r in sinks.parse_json_lines(lines, "a int").collect()] == [1, 2]


def test_grid(spark):
    grid = tables.time_grid(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 1), "25 minutes")
    assert [r.time.minute for r in grid.orderBy("n").collect()] == [0, 25, 50]
    assert tables.time_grid(spark, NOW, NOW, 60).count() == 0

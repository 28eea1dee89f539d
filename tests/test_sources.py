import json

import pandas as pd
import pytest
from datetime import datetime
from pyspark.sql import functions as F

from bucketwise.functions import fields as fld
from bucketwise.functions import scalars as sc
from bucketwise.operators import anonymize as an
from bucketwise.operators.filters import FilterState
from bucketwise.plans.spec import RunContext, compile_query, from_table
from bucketwise.session import checkpointed, scratch_path, shared_dir
from bucketwise.sources import sinks, sqltext, tables

NOW = datetime(2024, 1, 31)


def test_tables_of_another_catalog(spark, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS default.routed USING parquet LOCATION '{tmp_path}/routed' AS SELECT 7 AS n")
    query = from_table("routed", fld.field("n")).on_catalog("spark_catalog.default").unfiltered()
    assert compile_query(query, RunContext(spark, NOW)).df.first().n == 7
    assert tables.scan(spark, "routed", "spark_catalog.default").count() == 1
    sinks.load_into(spark.sql("SELECT 8 AS n"), "routed")
    assert tables.scan(spark, "routed").count() == 2


def test_partitioned_and_sorted_load(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("day"))
    sinks.load_into(rows, path, partition_by=["day"], sort_by=["id"])
    assert spark.read.parquet(path).groupBy("day").count().count() == 3
    assert len(list((tmp_path / "t" / "day=0").glob("*.parquet"))) == 1


def test_user_functions_in_query_texts(spark):
    @F.pandas_udf("long")
    def doubled(v: pd.Series) -> pd.Series:
        return v * 2

    spark.udf.register("doubled", doubled)
    spark.range(3).createOrReplaceTempView("three")
    query = sqltext.from_string("SELECT sum(doubled(id)) AS s FROM three WHERE {{FILTERS}}")
    ctx = RunContext(spark, NOW, FilterState(where=("id > 0",)))
    assert compile_query(query, ctx).df.first().s == 6


def test_range_bounds_are_bound_as_parameters(spark):
    from bucketwise.operators.filters import TimeRange

    query = sqltext.from_string("SELECT :__from AS f, :__to AS t FROM (SELECT TIMESTAMP_NTZ'2024-01-30 12:00:00' AS ts) WHERE {{FILTERS}}")
    row = compile_query(query, RunContext(spark, NOW, FilterState(TimeRange("24h")), ts="ts")).df.first()
    assert row.t - row.f == 86400


def test_local_rows_keep_nulls_and_types(spark):
    df = tables.local_rows(spark, [(1, None), (None, "x")], "n long, s string")
    assert [tuple(r) for r in df.collect()] == [(1, None), (None, "x")] and df.dtypes == [("n", "bigint"), ("s", "string")]
    assert tables.local_rows(spark, [], "n long").count() == 0
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_go_to_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))
    df = checkpointed(spark.range(5))
    assert df.count() == 5 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_scalars(spark):
    df = spark.sql("""SELECT 'a.b.c' AS s, '{"a": "x", "n": 69, "o": {"k.z": "deep"}}' AS j, '{broken' AS b, array(1, 2) AS arr""")
    row = df.select(
        sc.replace_first("s", ".", "-").alias("first"), sc.count_substrings("s", ".").alias("dots"),
        sc.json_string("j", "a").alias("text"), sc.json_string("j", "n").alias("number"), sc.json_string("b", "a").alias("broken"),
        sc.json_string("j", "o", "k.z").alias("deep"), sc.json_number("j", "n").alias("n"), sc.json_number("j", "a").alias("zero"),
        sc.element_or_null("arr", 5).alias("none"), F.size(sc.half_open_range(3, 3)).alias("empty"),
        *[c.alias(n) for c, n in zip(sc.split_id(F.lit("g#k#more")), ("g", "k"))]).first()
    assert row.asDict() == {"first": "a-b.c", "dots": 2, "text": "x", "number": "", "broken": "", "deep": "deep",
                            "n": 69.0, "zero": 0.0, "none": None, "empty": 0, "g": "g", "k": "k#more"}


def test_nested_columns_are_exported_as_json(spark, tmp_path):
    df = spark.sql("SELECT 1 AS i, array(1, 2) AS a, map('k', 'v') AS m, named_struct('x', 1) AS s, CAST(NULL AS ARRAY<INT>) AS z")
    for fmt in ("csv", "tsv"):
        sinks.export(df, str(tmp_path / fmt), fmt)
        back = spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", "\\").csv(str(tmp_path / fmt))
        assert tuple(back.first()) == ("1", "[1,2]", '{"k":"v"}', '{"x":1}', None)


def test_json_lines_without_a_schema(spark, tmp_path):
    lines = ['{"a":1,"odd `k` <VOID>, x":"q"}', "", " ", "{broken", "[1]", "7", '{"a":2.5,"m":"t","n":null}', '{"m":4,"o":{"p":[1,"x"],"q":{}},"OBJECT":true}',
             '  {"o":{"p":[],"r":"deep"}}  ']
    (tmp_path / "in.txt").write_text("\n".join(lines))
    rows = sinks.read_json_lines(spark, str(tmp_path / "in.txt"))
    assert dict(rows.dtypes) == {"OBJECT": "boolean", "a": "decimal(21,1)", "m": "string", "n": "string", "odd `k` <VOID>, x": "string",
                                 "o": "struct<p:array<string>,q:string,r:string>"}
    got = list(map(str, rows.collect()))
    assert len(got) == 4 and "Decimal('2.5')" in "".join(got) and "p=['1', 'x'], q='{}'" in "".join(got)
    (tmp_path / "none.txt").write_text("\n{}\nx\n")
    assert sinks.read_json_lines(spark, str(tmp_path / "none.txt")).columns == []


def test_streams_of_json_lines_need_a_schema_or_the_scrubber(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "1.txt").write_text('{"user_name":"Jane","n":{"password":"x","m":"a@b.org"}}\n\n{broken\n[1]\n')
    stream = spark.readStream.text(str(folder))
    with pytest.raises(ValueError, match="schema"):
        sinks.parse_json_lines(stream)
    rules = an.chain(an.drop_fields("password"), an.default_rules())
    query = (sinks.scrub_json_lines(stream, rules).writeStream.format("text").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    assert query.awaitTermination(120)
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 1 and got[0]["n"] == {"m": "<EMAIL>"} and got[0]["user_name"] not in ("Jane", "") and len(got[0]["user_name"]) == 4
    assert [r.value for r in sinks.scrub_json_lines(spark.read.text(str(folder)), rules).collect()] == [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]


def test_texts_of_another_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    for home, n in (("elsewhere", 5), ("default", 7)):
        spark.sql(f"DROP TABLE IF EXISTS {home}.plain_name")
        spark.range(n).write.option("path", scratch_path(spark, "plain")).saveAsTable(f"{home}.plain_name")
    text = sqltext.from_string_unfiltered("SELECT count(*) AS n FROM plain_name")
    for catalog, n in ((None, 7), ("elsewhere", 5), ("spark_catalog.elsewhere", 5)):
        query = sqltext.SqlText.from_dict({**text.to_dict(), "database": catalog})
        assert compile_query(query, RunContext(spark, NOW)).df.first().n == n
        assert spark.catalog.currentDatabase() == "default" and spark.catalog.currentCatalog() == "spark_catalog"
    with pytest.raises(Exception, match="missing_one"):
        sqltext.SqlText("SELECT * FROM missing_one", skip_filters=True, catalog="elsewhere").to_df(spark)
    assert spark.catalog.currentDatabase() == "default"

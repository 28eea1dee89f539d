"""Sources, sinks, projection and fields."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from bucketwise.functions import fields as fld
from bucketwise.functions import schema
from bucketwise.functions.scalars import composite_id, json_number, split_id
from bucketwise.alerting.log import within_retention
from bucketwise.operators import shape
from bucketwise.operators.filters import FilterState, TimeRange
from bucketwise.operators.profile import row_count
from bucketwise.plans.charts import folded_stacks
from bucketwise.plans.spec import RunContext, compile_query, from_table
from bucketwise.session import scratch_path
from bucketwise.sources import catalog, sinks, sqltext, tables
from suite.registry import EVENTS_FROM, EVENTS_TO, NOW, register, table, views

HERE = os.path.dirname(os.path.abspath(__file__))
MONTH = FilterState(TimeRange("720h"))


def context(spark, folder, *names, filters=MONTH, **more):
    views(spark, folder, *names)
    return RunContext(spark, NOW, filters, {n: table(spark, folder, n) for n in names}, ts="ts", **more)


@register("s1_table_scan", "SELECT * FROM customer")
def _(spark, folder):
    return compile_query(from_table("customer").unfiltered(), context(spark, folder, "customer")).df


@register("s2_sql_file_filtered", f"""
SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS cnt FROM events
WHERE ts >= TIMESTAMP '{EVENTS_FROM}' AND ts <= TIMESTAMP '{EVENTS_TO}' AND value > 10
  AND event_type IN ('error', 'click') GROUP BY 1, 2""")
def _(spark, folder):
    ctx = context(spark, folder, "events", filters=MONTH.add("value > 10"))
    return compile_query(sqltext.from_file(f"{HERE}/sql/hourly_errors.sql"), ctx).df


@register("s3_sql_file_unfiltered", """
SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def _(spark, folder):
    ctx = context(spark, folder, "customer")
    return compile_query(sqltext.from_file_unfiltered(f"{HERE}/sql/segment_balance.sql"), ctx).df


JOIN_SQL = """
SELECT n.n_name, o.o_orderpriority, count(*) AS orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, o.o_orderpriority"""


@register("s4_inline_sql_join", JOIN_SQL)
def _(spark, folder):
    ctx = context(spark, folder, "orders", "customer", "nation")
    return compile_query(sqltext.from_string_unfiltered(JOIN_SQL), ctx).df


@register("s6_parquet_glob", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, folder):
    return tables.scan(spark, f"{folder}/order*.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@register("s7_delimited_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, folder):
    path = scratch_path(spark, "tsv")
    table(spark, folder, "supplier").write.option("sep", "\t").csv(path)
    return tables.delimited(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@register("s8_time_grid", f"""
WITH grid AS (SELECT CAST(g AS TIMESTAMP) AS time
  FROM generate_series(TIMESTAMP '{EVENTS_FROM}', TIMESTAMP '{EVENTS_TO}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR) t(g)),
c AS (SELECT date_trunc('hour', ts) AS time, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT grid.time, coalesce(c.n, 0) AS n FROM grid LEFT JOIN c ON grid.time = c.time""")
def _(spark, folder):
    grid = tables.time_grid(spark, datetime(2024, 1, 1), NOW, "1 hour").select("time")
    hourly = (table(spark, folder, "events").where("event_type = 'error'")
              .groupBy(F.window("ts", "1 hour").start.alias("time")).agg(F.count("*").alias("n")))
    return grid.join(hourly, "time", "left").select("time", F.coalesce("n", F.lit(0)).alias("n"))


@register("s9_load_job", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, event_type, event_id, value FROM events WHERE value > 100""")
def _(spark, folder):
    path = scratch_path(spark, "load")
    rows = table(spark, folder, "events").where("value > 100").select(
        F.to_date("ts").alias("event_date"), "event_type", "event_id", "value")
    sinks.load_into(rows, path, partition_by=["event_date"], sort_by=["event_type"])
    return spark.read.parquet(path).select(F.col("event_date").cast("string").alias("event_date"), "event_type", "event_id", "value")


@register("s12_retention", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-08-01' """)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return within_retention(orders, "o_orderdate", datetime(2001, 8, 1, 12), 365)


@register("s13_export_safe", "SELECT event_id, replace(props, ' ', '') AS props, value FROM events")
def _(spark, folder):
    parsed = table(spark, folder, "events").select(
        "event_id", F.try_parse_json("props").alias("props"), "value")
    return shape.export_safe(parsed)


@register("s14_export_formats", """
SELECT f.format, count(*) AS n, round(sum(p_retailprice), 2) AS price
FROM part, (VALUES ('parquet'), ('json'), ('xml'), ('csv'), ('tsv'), ('orc')) f(format) GROUP BY 1""")
def _(spark, folder):
    base, part = scratch_path(spark, "export"), table(spark, folder, "part")
    schema = part.schema
    readers = {
        "parquet": lambda p: spark.read.parquet(p), "orc": lambda p: spark.read.orc(p),
        "json": lambda p: spark.read.schema(schema).json(p),
        "xml": lambda p: spark.read.schema(schema).option("rowTag", "row").xml(p),
        "csv": lambda p: spark.read.schema(schema).option("header", True).csv(p),
        "tsv": lambda p: spark.read.schema(schema).option("header", True).option("sep", "\t").csv(p),
    }
    back = {}
    for fmt, read in readers.items():
        sinks.export(part, f"{base}/{fmt}", fmt)
        back[fmt] = read(f"{base}/{fmt}").select("p_partkey", "p_retailprice")
    return shape.union_tagged(back, "format").groupBy("format").agg(
        F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@register("s15_folded_stacks", """
SELECT concat(s, ' ', n) AS value FROM (
  SELECT concat(o_orderstatus, ';', o_orderpriority) AS s, count(*) AS n FROM orders GROUP BY 1)""")
def _(spark, folder):
    stacks = table(spark, folder, "orders").select(
        F.concat_ws(";", "o_orderstatus", "o_orderpriority").alias("stack"), F.lit(1).alias("n"))
    path = scratch_path(spark, "stacks")
    sinks.write_text(folded_stacks(stacks, "stack", "n"), path)
    return spark.read.text(path)


@register("s20_row_counts", """
SELECT 'events' AS name, count(*) AS total_rows FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'orders', count(*) FROM orders""")
def _(spark, folder):
    names = ("events", "lineitem", "documents", "orders")
    return shape.union_tagged({n: row_count(table(spark, folder, n)) for n in names}, "name")


@register("s22_json_lines", """
SELECT event_id, event_type, 'REDACTED' AS user_agent, '<EMAIL> wrote from <IP>' AS note FROM events""")
def _(spark, folder):
    from bucketwise.operators.anonymize import anonymize, default_rules

    path = scratch_path(spark, "lines")
    source = table(spark, folder, "events").select(
        "event_id", "event_type", F.concat(F.lit("agent "), "user_id").alias("user_agent"),
        F.concat(F.lit("u"), "user_id", F.lit("@example.com wrote from 10.0.0."),
                 (F.col("user_id") % 250).cast("string")).alias("note"))
    line = F.to_json(F.struct("*"))
    # Every fourth line is followed by a blank or a broken one.
    noise = F.when(F.col("event_id") % 4 == 0, F.array(line, F.lit("  "))).when(
        F.col("event_id") % 4 == 1, F.array(line, F.concat(F.lit("{broken"), line))).otherwise(F.array(line))
    source.select(F.explode(noise).alias("value")).write.text(path)
    rows = sinks.read_json_lines(spark, path, "event_id long, event_type string, user_agent string, note string")
    out = scratch_path(spark, "scrubbed")
    sinks.write_json_lines(anonymize(rows, default_rules()), out)
    return spark.read.schema("event_id long, event_type string, user_agent string, note string").json(out)


# What each line holds follows from the event: clicks have an agent, errors a nested object, and "extra" changes its type.
OPEN_LINE = """concat('{"event_id":', event_id, ',"kind":"', event_type, '"',
  CASE WHEN event_type = 'click' THEN concat(',"user_agent":"agent ', user_id, '"') ELSE '' END,
  CASE WHEN event_type = 'error' THEN concat(',"more":{"ip":"10.0.0.', user_id % 250, '","tags":["a","u', user_id, '@example.com"]}') ELSE '' END,
  CASE WHEN event_id % 2 = 0 THEN concat(',"extra":', user_id) ELSE concat(',"extra":"x', user_id, '"') END,
  CASE WHEN event_id % 7 = 0 THEN concat(',"odd name":{"k', event_id % 3, '":null}') ELSE '' END, '}')"""


def open_lines(spark, folder):
    """JSON lines with blank, broken and foreign ones among them."""
    path = scratch_path(spark, "open-lines")
    lines = table(spark, folder, "events").select("event_id", F.expr(OPEN_LINE).alias("value"))
    noise = F.when(F.col("event_id") % 4 == 0, F.array("value", F.lit("  "), F.lit("[1]"))).when(
        F.col("event_id") % 4 == 1, F.array("value", F.concat(F.lit("{broken"), "value"))).otherwise(F.array("value"))
    lines.select(F.explode(noise).alias("value")).write.text(path)
    return path


@register("s22_json_lines_open_schema", """
SELECT event_id, event_type AS kind, CASE WHEN event_type = 'click' THEN concat('agent ', user_id) END AS user_agent,
  CASE WHEN event_type = 'error' THEN concat('10.0.0.', user_id % 250) END AS ip,
  CASE WHEN event_type = 'error' THEN concat('u', user_id, '@example.com') END AS tag,
  CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE concat('x', user_id) END AS extra,
  event_id % 7 = 0 AS odd, 'bigint string string' AS kinds FROM events""")
def _(spark, folder):
    rows = sinks.read_json_lines(spark, open_lines(spark, folder))
    kinds = dict(rows.dtypes)
    return rows.select("event_id", "kind", "user_agent", "more.ip", F.col("more.tags")[1].alias("tag"), "extra",
                       F.col("odd name").isNotNull().alias("odd"),
                       F.lit(f"{kinds['event_id']} {kinds['kind']} {kinds['extra']}").alias("kinds"))


@register("s22_json_lines_scrubbed", """
SELECT concat('{"event_id":', event_id, CASE WHEN event_id % 2 = 0 THEN concat(',"extra":', user_id) ELSE concat(',"extra":"x', user_id, '"') END,
  ',"kind":"', event_type, '"', CASE WHEN event_type = 'error' THEN ',"more":{"ip":"<IP>","tags":["a","<EMAIL>"]}' ELSE '' END,
  CASE WHEN event_id % 7 = 0 THEN ',"odd name":{}' ELSE '' END,
  CASE WHEN event_type = 'click' THEN ',"user_agent":"REDACTED"' ELSE '' END, '}') AS value FROM events""")
def _(spark, folder):
    from bucketwise.operators.anonymize import by_column, chain, default_rules, drop_fields, replace_with

    rules = chain(drop_fields("k0", "k1", "k2"), by_column({"ip": replace_with("10.1.2.3")}), default_rules())
    return sinks.scrub_json_lines(spark.read.text(open_lines(spark, folder)), rules)


# -- projection and fields -----------------------------------------------------------

@register("p1_expression_field", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(spark, folder):
    spec = from_table("lineitem", fld.field("l_orderkey"),
                      fld.field("l_extendedprice * (1 - l_discount)", "net")).unfiltered()
    return compile_query(spec, context(spark, folder, "lineitem")).df


@register("p2_p3_alias_and_order", "SELECT o_orderstatus AS status, o_orderkey, o_custkey AS buyer FROM orders")
def _(spark, folder):
    spec = (from_table("orders", fld.field("o_orderkey")).selecting(fld.field("o_custkey").with_alias("buyer"))
            .selecting_first(fld.field("o_orderstatus").with_alias("status")).unfiltered())
    return compile_query(spec, context(spark, folder, "orders")).df


@register("p4_all_except", "SELECT event_id, ts, user_id, event_type FROM events")
def _(spark, folder):
    return shape.all_except(table(spark, folder, "events"), "props", "value")


@register("p5_replace_in_place", """
SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation""")
def _(spark, folder):
    return shape.cast_in_place(table(spark, folder, "nation"), {"n_nationkey": "string", "n_regionkey": "string"})


@register("p6_category_field", "SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS cnt FROM lineitem GROUP BY 1")
def _(spark, folder):
    spec = from_table("lineitem", fld.enum("l_linenumber"), fld.count()).grouping(fld.enum("l_linenumber")).unfiltered()
    return compile_query(spec, context(spark, folder, "lineitem")).df


@register("p7_p8_existing_columns", """
SELECT time, event_type, cnt FROM (SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS cnt
  FROM events GROUP BY 1, 2)""")
def _(spark, folder):
    hourly = table(spark, folder, "events").groupBy(
        F.window("ts", "1 hour").start.alias("time"), "event_type").agg(F.count("*").alias("cnt"))
    time = fld.ref("time", 3_600_000)
    spec = from_table("hourly", time, fld.ref("event_type"), fld.ref("cnt")).unfiltered()
    ctx = RunContext(spark, NOW, tables={"hourly": hourly})
    return compile_query(spec, ctx).df


@register("p9_json_fields", """
SELECT event_id, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN props->>'$.k' ELSE '' END AS k,
       CAST(coalesce(TRY_CAST(props->>'$.k' AS DOUBLE), 0) AS DOUBLE) AS k_number FROM events""")
def _(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", fld.json_text("props", "k").column().alias("k"),
                         json_number("props", "k").alias("k_number"))


@register("p9_json_text_found", "SELECT c_custkey, c_name AS name, '' AS missing FROM customer")
def _(spark, folder):
    body = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")).alias("a.b")))
    rows = table(spark, folder, "customer").select("c_custkey", body.alias("body"))
    return rows.select("c_custkey", fld.json_text("body", "a.b", "name").column().alias("name"),
                       fld.json_text("body", "a.b", "id").column().alias("missing"))


@register("p10_composite_id", """
SELECT concat(o_orderstatus, '#', o_orderpriority, '#', o_orderkey) AS id, o_orderstatus AS id_group,
       concat(o_orderpriority, '#', o_orderkey) AS id_key FROM orders""")
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        composite_id("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("id"))
    group, key = split_id("id")
    return rows.select("id", group.alias("id_group"), key.alias("id_key"))


P11_SQL = """
WITH top AS (SELECT max(o_totalprice) AS price FROM orders)
SELECT o_orderkey, round(o_totalprice / (SELECT price FROM top), 6) AS part_of_top FROM orders"""


@register("p11_scalar_cte", P11_SQL)
def _(spark, folder):
    return compile_query(sqltext.from_string_unfiltered(P11_SQL), context(spark, folder, "orders")).df


@register("s17_s18_columns_and_classes", """
SELECT table_name AS "table", column_name AS "column", CASE
    WHEN data_type LIKE '%[]' OR data_type LIKE 'STRUCT%' OR data_type LIKE 'MAP%' THEN ''
    WHEN data_type IN ('VARCHAR', 'BOOLEAN') THEN 'categorical'
    WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'temporal' ELSE 'continuous' END AS class
FROM information_schema.columns WHERE table_name IN ('events', 'orders', 'embeddings', 'documents')""")
def _(spark, folder):
    from bucketwise.sources.catalog import columns_of

    tables = {name: table(spark, folder, name) for name in ("events", "orders", "embeddings", "documents")}
    return columns_of(tables, spark).select("table", "column", "class")


@register("s5_catalog_of_sql_text", """
SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation WHERE n_nationkey > 3 GROUP BY 1""")
def _(spark, folder):
    home = f"elsewhere_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {home} LOCATION '{scratch_path(spark, 'database')}'")
    table(spark, folder, "nation").write.option("path", scratch_path(spark, "places")).saveAsTable(f"{home}.places")
    text = sqltext.SqlText("SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM places WHERE {{FILTERS}} GROUP BY 1",
                           where=("n_nationkey > 3",), catalog=f"spark_catalog.{home}")
    found = text.to_df(spark)
    assert spark.catalog.currentDatabase() == "default"
    return found


@register("s16_listed_tables", """
SELECT 'nation' AS name, count(*) AS total_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
def _(spark, folder):
    views(spark, folder, "nation", "region", "supplier", "part")
    names = catalog.list_tables(spark, include=["N%N", "reg%", "part"], exclude=["p%"])
    return shape.union_tagged({n: row_count(spark.table(n)) for n in names}, "name")


@register("s19_time_columns", """
SELECT 'events' AS name, 'ts' AS used, min(ts) AS first, max(ts) AS last FROM events
UNION ALL SELECT 'orders', 'o_orderdate', min(o_orderdate), max(o_orderdate) FROM orders
UNION ALL SELECT 'lineitem', 'l_shipdate', min(l_shipdate), max(l_shipdate) FROM lineitem""")
def _(spark, folder):
    found = {}
    for name in ("events", "orders", "lineitem"):
        rows = table(spark, folder, name)
        time = schema.time_column(rows)
        found[name] = rows.agg(F.lit(time).alias("used"), F.min(time).alias("first"), F.max(time).alias("last"))
    return shape.union_tagged(found, "name")


@register("u2_bound_parameters", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE event_type IN ('error', 'view') AND user_id > 40 AND value < 55.5 GROUP BY 1""")
def _(spark, folder):
    views(spark, folder, "events")
    text = sqltext.from_string_unfiltered("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
      WHERE event_type IN (:one, :other) AND user_id > :least AND value < :most GROUP BY 1""")
    params = sqltext.typed_params({"one": "error", "other": "view", "least": "40", "most": "55.5"}, {"least": "Int64", "most": "Float64"})
    return text.to_df(spark, params)


@register("u6_derived_queries", """
SELECT 'base' AS query, event_type, count(*) AS cnt FROM events GROUP BY 2
UNION ALL SELECT 'derived', event_type, count(*) FROM events WHERE value > 50 GROUP BY 2""")
def _(spark, folder):
    kind = fld.enum("event_type")
    base = from_table("events", kind, fld.count()).grouping(kind).unfiltered()
    derived = base.filtering("value > 50")  # the base stays as it is
    ctx = context(spark, folder, "events")
    return shape.union_tagged({"base": compile_query(base, ctx).df, "derived": compile_query(derived, ctx).df}, "query")

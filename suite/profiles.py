"""Table profiles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from bucketwise.functions.schema import mark_listable
from bucketwise.operators import profile as pr
from bucketwise.operators.anonymize import by_column, chain, drop_fields, replace_with, text_pattern
from bucketwise.operators.shape import union_tagged
from bucketwise.session import scratch_path
from bucketwise.sources import sinks
from suite.registry import NOW, register, table

ORDERS = pr.ProfileConfig(tie_break=("o_orderkey",), exact=True)
EVENTS = pr.ProfileConfig(tie_break=("event_id",))


def orders(spark, folder):
    return mark_listable(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


def events(spark, folder):
    return mark_listable(table(spark, folder, "events"), "event_type")


@register("pr1_column_stats", """
SELECT 'o_orderkey' AS column, CAST(NULL AS BIGINT) AS cardinality, count(DISTINCT o_orderkey) AS cardinality_approx FROM orders
UNION ALL SELECT 'o_custkey', NULL, count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), NULL FROM orders
UNION ALL SELECT 'o_totalprice', NULL, count(DISTINCT o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', NULL, count(DISTINCT o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), NULL FROM orders""")
def column_stats(spark, folder):
    return pr.profile_table(orders(spark, folder), "orders", NOW, ORDERS).column_stats.drop("type", "listed")


@register("pr3_cardinalities_probed", """
SELECT count(DISTINCT c_custkey) AS c_custkey, count(DISTINCT c_acctbal) AS c_acctbal, count(DISTINCT c_name) AS c_name, count(DISTINCT c_mktsegment) AS c_mktsegment, count(DISTINCT c_nationkey) AS c_nationkey FROM customer""")
def _(spark, folder):
    customer = table(spark, folder, "customer")
    _, probe = pr.split_columns(customer, [])
    from bucketwise.operators.topk import distinct_counts

    return distinct_counts(customer, probe, exact=True)


VALUES_SQL = """
SELECT "column", value, count, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM (
  SELECT 'p_type' AS "column", p_type AS value, count(*) AS count FROM part GROUP BY 2 UNION ALL
  SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2 UNION ALL
  SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2)) WHERE rank <= 50"""


@register("pr4_value_lists", VALUES_SQL)
def _(spark, folder):
    return pr.column_values(table(spark, folder, "part"), ["p_type", "p_brand", "p_name"], 50)


@register("pr1_long_lists", """
SELECT 'p_name' AS "column", (SELECT count(DISTINCT p_name) FROM part) AS cardinality, count(*) AS values, CAST(sum(n) AS BIGINT) AS total
FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)""")
def _(spark, folder):
    part = mark_listable(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name")
    profile = pr.profile_table(part, "part", NOW, pr.ProfileConfig(tie_break=("p_partkey",)))
    listed = profile.column_values.groupBy("column").agg(F.count("*").alias("values"), F.sum("count").alias("total"))
    return profile.column_stats.select("column", "cardinality").join(listed, "column")


@register("pr6_bucket_samples", """
WITH top AS (SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2
             ORDER BY count DESC, o_orderstatus, o_orderpriority LIMIT 200)
SELECT o_orderstatus, o_orderpriority, count, sample_no, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT o.*, top.count, CAST(row_number() OVER (PARTITION BY o.o_orderstatus, o.o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS sample_no
  FROM orders o JOIN top USING (o_orderstatus, o_orderpriority)) WHERE sample_no <= 3""")
def bucket_samples(spark, folder):
    samples = pr.profile_table(orders(spark, folder), "orders", NOW, ORDERS).bucket_samples
    return samples.select("o_orderstatus", "o_orderpriority", "count", "sample_no", "sample.o_orderkey",
                          "sample.o_orderdate", "sample.o_totalprice")


@register("pr1_profile_of_recent_rows", """
SELECT value, count(*) AS count FROM (SELECT event_type AS value FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR) GROUP BY 1""")
def _(spark, folder):
    config = pr.ProfileConfig(recent=timedelta(hours=48), ts="ts", skip=("props",), tie_break=("event_id",))
    profile = pr.profile_table(events(spark, folder), "events", NOW, config)
    return profile.column_values.where("column = 'event_type'").select("value", "count")


@register("pr8_anonymized_profile", """
SELECT event_type, count, sample_no, event_id, user_id, '<JSON>' AS props FROM (
  SELECT 'masked' AS event_type, count, sample_no, event_id, 'U' AS user_id FROM (
    SELECT e.*, t.count, CAST(row_number() OVER (PARTITION BY e.event_type ORDER BY ts DESC, event_id) AS INTEGER) AS sample_no
    FROM events e JOIN (SELECT event_type, count(*) AS count FROM events GROUP BY 1) t USING (event_type)) WHERE sample_no <= 3)""")
def _(spark, folder):
    rules = chain(by_column({"event_type": replace_with("masked"), "user_id": replace_with("U")}),
                  text_pattern(r"\{.*\}", "<JSON>"), drop_fields("value"))
    profile = pr.anonymize_profile(pr.profile_table(events(spark, folder), "events", NOW, EVENTS), rules)
    return profile.bucket_samples.select("event_type", "count", "sample_no", "sample.event_id", "sample.user_id", "sample.props")


@register("pr8_dropped_values_keep_counts", """
SELECT CAST(NULL AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY event_type""")
def _(spark, folder):
    profile = pr.profile_table(events(spark, folder), "events", NOW, EVENTS)
    masked = pr.anonymize_profile(profile, drop_fields("event_type")).column_values
    return masked.where("column = 'event_type'").select("value", "count")


@register("pr9_bucket_names", """
SELECT DISTINCT p_name, p_type, substr(concat_ws('__', 'p_name=' || trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_'),
    'p_type=' || trim(regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g'), '_')), 1, 150)
  || '__' || md5(length(p_name) || ':' || p_name || ',' || length(p_type) || ':' || p_type) AS bucket_name FROM part""")
def _(spark, folder):
    tuples = table(spark, folder, "part").select("p_name", "p_type").distinct()
    return pr.bucket_names(tuples, ["p_type", "p_name"])


@register("s21_profile_written_and_read", """
SELECT 'values' AS kind, "column" AS a, value AS b, count AS n, NULL AS row_key FROM (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
UNION ALL SELECT 'samples', o_orderstatus, o_orderpriority, count, o_orderkey FROM (
  SELECT *, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS count,
    row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def _(spark, folder):
    path = scratch_path(spark, "profile")
    written = pr.profile_table(orders(spark, folder), "orders", NOW, ORDERS)
    sinks.write_profile(written, path)
    back = sinks.read_profile(spark, path, written)
    none = F.lit(None).cast("long").alias("row_key")
    values = back.column_values.select(F.col("column").alias("a"), F.col("value").alias("b"), F.col("count").alias("n"), none)
    samples = back.bucket_samples.select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), F.col("count").alias("n"),
                                         F.col("sample.o_orderkey").alias("row_key"))
    return union_tagged({"values": values, "samples": samples}, "kind")


@register("pr2_listable_columns", """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def _(spark, folder):
    rows = orders(spark, folder)
    at_once, _ = pr.split_columns(rows, ["o_comment"])
    return pr.value_counts(rows, at_once)


@register("pr4_whole_value_lists", """
SELECT "column", value, count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM (
  SELECT 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS value, count(*) AS count FROM orders GROUP BY 2 UNION ALL
  SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)""")
def _(spark, folder):
    return pr.column_values(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"])


@register("pr5_chosen_dimensions", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, folder):
    rows = orders(spark, folder)
    at_once, others = pr.split_columns(rows, [])
    config = pr.ProfileConfig(preferred_dims=("o_orderpriority", "o_orderstatus", "missing"), max_dims=3)
    return rows.groupBy(*pr.choose_dims([*at_once, *others], at_once, config)).agg(F.count("*").alias("n"))


@register("pr7_newest_rows_first", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200")
def _(spark, folder):
    rows = table(spark, folder, "events")
    return rows.orderBy(*pr.sample_order(rows, EVENTS)).limit(200).select("event_id", "ts")

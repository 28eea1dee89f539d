"""Aggregates, windows, joins, unnesting and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bucketwise.functions import fields as fld
from bucketwise.functions import scalars as sc
from bucketwise.functions.buckets import epoch_seconds, from_epoch_seconds
from bucketwise.operators import order, shape, topk
from bucketwise.operators.profile import continuous_stats
from bucketwise.sources.tables import local_rows
from bucketwise.plans.spec import compile_query, from_table
from suite.registry import register, table
from suite.sources_and_fields import context


@register("a1_a2_a3_basic_aggregates", """
SELECT o_orderpriority, count(*) AS cnt, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 8) AS mean,
       min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1""")
def _(spark, folder):
    key = fld.enum("o_orderpriority")
    spec = from_table("orders", key, fld.count(), fld.sum_of("o_totalprice", "total"), fld.avg_of("o_totalprice", "mean"),
                      fld.min_of("o_totalprice", "low"), fld.max_of("o_totalprice", "high")).grouping(key).unfiltered()
    out = compile_query(spec, context(spark, folder, "orders")).df
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 8)})


@register("a4_latest_row_per_key", """
SELECT user_id, max(ts) AS latest_ts, arg_max(event_type, ts) AS latest_event_type,
       arg_max(v, ts) FILTER (WHERE v IS NOT NULL) AS latest_value
FROM (SELECT *, CASE WHEN value > 30 THEN value END AS v FROM events) GROUP BY 1""")
def _(spark, folder):
    rows = table(spark, folder, "events").withColumn("value", F.when(F.col("value") > 30, F.col("value")))
    return topk.latest_per_key(rows, ["user_id"], "ts", ["event_type", "value"], skip_null=["value"])


@register("a5_distinct_counts_exact", """
SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT props) AS props FROM events""")
def _(spark, folder):
    return topk.distinct_counts(table(spark, folder, "events"), ["user_id", "event_type", "props"], exact=True)


@register("a5_distinct_nested", """
SELECT count(DISTINCT embedding) AS embedding, count(DISTINCT label) AS label FROM embeddings""")
def _(spark, folder):
    return topk.distinct_counts(table(spark, folder, "embeddings"), ["embedding", "label"], exact=True)


@register("a5_distinct_counts_approx", """
SELECT true AS user_id, true AS event_type, true AS props, true AS ts, true AS value FROM events HAVING count(*) > 0""")
def _(spark, folder):
    """Whether each estimate is within a tenth of the exact count (five percent is its standard error)."""
    names = ["user_id", "event_type", "props", "ts", "value"]
    events = table(spark, folder, "events")
    exact = topk.distinct_counts(events, names, exact=True).select(F.struct("*").alias("e"))
    both = topk.distinct_counts(events, names).select(F.struct("*").alias("a")).withColumn("one", F.lit(1)).join(
        exact.withColumn("one", F.lit(1)), "one")
    return both.select(*[(F.abs(F.col(f"a.{n}") - F.col(f"e.{n}")) <= 1 + 0.1 * F.col(f"e.{n}")).alias(n) for n in names])


@register("a6_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, folder):
    key = fld.enum("event_type")
    spec = from_table("events", key, fld.distinct_of("user_id", "users", exact=True)).grouping(key).unfiltered()
    return compile_query(spec, context(spark, folder, "events")).df


@register("a7_quantiles_exact", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95,
       round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1""")
def _(spark, folder):
    out = order.exact_quantiles(table(spark, folder, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])
    return out.select("event_type", *[F.round(q, 6).alias(q) for q in ("q50", "q95", "q99")])


@register("a7_quantiles_approx", "SELECT DISTINCT event_type, true AS close FROM events")
def _(spark, folder):
    """Whether the rank of each estimate is within a hundredth of the wanted one."""
    key = fld.enum("event_type")
    spec = from_table("events", key, fld.quantile_of("value", 0.95, "q95")).grouping(key).unfiltered()
    estimates = compile_query(spec, context(spark, folder, "events")).df
    rows = table(spark, folder, "events").join(estimates, "event_type")
    below, upto = F.avg((F.col("value") < F.col("q95")).cast("double")), F.avg((F.col("value") <= F.col("q95")).cast("double"))
    return rows.groupBy("event_type").agg(((below <= 0.96) & (upto >= 0.94)).alias("close"))


@register("a8_top_values", """
SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, value LIMIT 100""")
def _(spark, folder):
    return topk.top_values(table(spark, folder, "events"), "user_id", 100)


@register("a9_top_tuples", """
SELECT p_brand, p_type, p_size, count(*) AS count FROM part GROUP BY 1, 2, 3
ORDER BY count DESC, p_brand, p_type, p_size LIMIT 50""")
def _(spark, folder):
    return topk.top_tuples(table(spark, folder, "part"), ["p_brand", "p_type", "p_size"], 50)


@register("a9_top_of_many_tuples", """
SELECT l_partkey, l_linenumber, l_returnflag, count(*) AS count FROM lineitem GROUP BY 1, 2, 3
ORDER BY count DESC, l_partkey, l_linenumber, l_returnflag LIMIT 200""")
def _(spark, folder):
    return topk.top_tuples(table(spark, folder, "lineitem"), ["l_partkey", "l_linenumber", "l_returnflag"], 200)


@register("a10_continuous_stats", """
SELECT 'value' AS column, min(value) AS min, max(value) AS max FROM events UNION ALL
SELECT 'user_id', CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events""")
def _(spark, folder):
    return continuous_stats(table(spark, folder, "events"), ["value", "user_id"]).drop("median")


# -- windows ------------------------------------------------------------------------------

@register("w2_row_numbers", """
SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS row_number FROM events""")
def row_numbers(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "ts")
    return order.numbered(rows, [F.col("ts").asc(), F.col("event_id").asc()])


@register("w4_latest_rows_per_tuple", """
SELECT event_type, lane, event_id, ts, n FROM (
  SELECT *, user_id % 5 AS lane, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts DESC, event_id) AS n
  FROM events) WHERE n <= 3""")
def _(spark, folder):
    rows = table(spark, folder, "events").select("event_type", (F.col("user_id") % 5).alias("lane"), "event_id", "ts")
    return topk.latest_k(rows, ["event_type", "lane"], [F.col("ts").desc(), F.col("event_id").asc()], 3, "n")


# -- joins, sets, unnesting -----------------------------------------------------------------

@register("j1_left_lookup", """
WITH h AS (SELECT date_trunc('hour', ts) AS time, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.event_id, coalesce(h.n, 0) AS n FROM events e LEFT JOIN h ON date_trunc('hour', e.ts) = h.time""")
def _(spark, folder):
    events = table(spark, folder, "events")
    hour = F.window("ts", "1 hour").start
    hourly = events.where("event_type = 'error'").groupBy(hour.alias("time")).agg(F.count("*").alias("n"))
    return (events.select("event_id", hour.alias("time")).join(hourly, "time", "left")
            .select("event_id", F.coalesce("n", F.lit(0)).alias("n")))


@register("j2_union_tagged", """
SELECT 'customer' AS origin, c_name AS name, c_acctbal AS balance FROM customer UNION ALL
SELECT 'supplier', s_name, s_acctbal FROM supplier""")
def _(spark, folder):
    return shape.union_tagged({
        "customer": table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        "supplier": table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    }, "origin")


@register("j3_unnest_arrays", """
SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings)""")
def _(spark, folder):
    return (table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
            .select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("x").cast("double").alias("x")))


@register("j3_two_unnests", """
SELECT o_orderkey, a.word, b.n FROM (SELECT o_orderkey, string_split(o_orderpriority, '-') AS words FROM orders) o,
  unnest(o.words) a(word), (VALUES (1), (2)) b(n)""")
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.split("o_orderpriority", "-").alias("word"), F.array(F.lit(1), F.lit(2)).alias("n"))
    return shape.unnest(rows, "word", "n")


@register("j4_literal_list", """
SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status)
LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY 1""")
def _(spark, folder):
    wanted = local_rows(spark, [(v,) for v in "FOPX"], "status string")
    counted = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return wanted.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@register("j5_wide_to_tidy", """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def _(spark, folder):
    return shape.to_tidy(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


# -- scalar functions -------------------------------------------------------------------------

@register("x1_x2_x4_x5_x7_x8_time_functions", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, date_trunc('second', ts) AS back,
       ts + INTERVAL 3 HOUR AS later, CAST(hour(ts) AS INTEGER) AS hour, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""")
def _(spark, folder):
    seconds = epoch_seconds("ts")
    return table(spark, folder, "events").select(
        "event_id", seconds.alias("seconds"), from_epoch_seconds(seconds).alias("back"),
        (F.col("ts") + F.make_dt_interval(hours=F.lit(3))).alias("later"), F.hour("ts").alias("hour"),
        F.to_date("ts").cast("string").alias("day"))


@register("x6_format_time", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"))


@register("x9_x10_x11_text_functions", """
SELECT doc_id, CASE WHEN strpos(text, 'en') > 0 THEN substr(text, 1, strpos(text, 'en') - 1) || '<1>' || substr(text, strpos(text, 'en') + 2)
       ELSE text END AS replaced, source || ':' || CAST(n_chars AS VARCHAR) AS joined,
       CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS BIGINT) AS hits FROM documents""")
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", sc.replace_first("text", "en", "<1>").alias("replaced"),
        F.concat("source", F.lit(":"), F.col("n_chars").cast("string")).alias("joined"),
        sc.count_substrings("text", "en").alias("hits"))


@register("x12_x13_conditions", """
SELECT p_partkey, CASE WHEN starts_with(p_name, 'small') THEN 'S' WHEN p_name ILIKE 'LARGE%' THEN 'L'
       WHEN p_name LIKE '%ring' THEN 'R' ELSE 'other' END AS size_class,
       CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS half FROM part""")
def _(spark, folder):
    name = F.col("p_name")
    label = (F.when(name.startswith("small"), "S").when(name.ilike("LARGE%"), "L").when(name.like("%ring"), "R")
             .otherwise("other"))
    return table(spark, folder, "part").select("p_partkey", label.alias("size_class"),
                                               F.expr("if(p_size > 25, 'big', 'small')").alias("half"))


@register("x14_x15_arrays_and_maps", """
SELECT p_partkey, parts[2] AS second, parts[9] AS ninth, CAST(len(parts) AS INTEGER) AS n,
       CAST(len(range(1, p_size)) AS INTEGER) AS up_to, p_brand AS looked_up
FROM (SELECT *, string_split(p_name, ' ') AS parts FROM part)""")
def _(spark, folder):
    parts = F.split("p_name", " ")
    lookup = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return table(spark, folder, "part").select(
        "p_partkey", sc.element_or_null(parts, 2).alias("second"), sc.element_or_null(parts, 9).alias("ninth"),
        F.size(parts).alias("n"), F.size(sc.half_open_range(1, F.col("p_size"))).alias("up_to"),
        lookup["brand"].alias("looked_up"))


@register("x16_seeded_random", """
SELECT event_id, CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw FROM events""")
def _(spark, folder):
    # A stable pseudo-random number per row, independent of partitioning.
    digest = F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return table(spark, folder, "events").select("event_id", draw.alias("draw"))


@register("x18_x19_casts_and_arithmetic", """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, CAST(trunc(value) AS BIGINT) AS whole,
       TRY_CAST(event_type AS INTEGER) AS not_a_number, user_id * 3 + 7 AS a, user_id % 11 AS b, user_id / 4 AS c FROM events""")
def _(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user_text"), F.col("value").cast("long").alias("whole"),
        F.col("event_type").try_cast("int").alias("not_a_number"), (F.col("user_id") * 3 + 7).alias("a"),
        (F.col("user_id") % 11).alias("b"), (F.col("user_id") / 4).alias("c"))


@register("w1_next_time_per_key", """
SELECT event_type, day, coalesce(lead(day) OVER (PARTITION BY event_type ORDER BY day), TIMESTAMP '2024-01-31') AS next_day
FROM (SELECT DISTINCT event_type, date_trunc('day', ts) AS day FROM events)""")
def _(spark, folder):
    # One row per type and day: groups stay small whatever the volume of events.
    days = table(spark, folder, "events").select("event_type", F.window("ts", "1 day").start.alias("day")).distinct()
    following = F.lead("day").over(Window.partitionBy("event_type").orderBy("day"))
    return days.select("event_type", "day", F.coalesce(following, F.expr("TIMESTAMP_NTZ'2024-01-31'")).alias("next_day"))

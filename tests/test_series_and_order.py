import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketwise.operators import order, series, topk
from tests.conftest import plan_of

T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, y long")


def test_gap_fill_per_series(spark):
    rows = [("a", T0, 1), ("a", T0 + timedelta(hours=3), 2), ("b", T0 + timedelta(hours=5), 3)]
    out = series.gap_fill(frame(spark, rows), "t", "1 hour", ["k"]).orderBy("k", "t").collect()
    assert [(r.k, (r.t - T0).seconds // 3600, r.y) for r in out] == [
        ("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("b", 5, 3)]


def test_gap_fill_keeps_rows_off_the_grid(spark):
    rows = [("a", T0, 1), ("a", T0 + timedelta(minutes=90), 2), ("a", T0 + timedelta(minutes=150), 3)]
    out = series.gap_fill(frame(spark, rows), "t", "toIntervalHour(1)", ["k"])
    assert {(r.t, r.y) for r in out.collect()} >= {(t, y) for _, t, y in rows}
    assert out.where("y = 0").count() == 1


def test_gap_fill_across_many_chunks(spark):
    rows = [("a", T0, 1), ("a", T0 + timedelta(seconds=3 * series.CHUNK + 5), 2)]
    out = series.gap_fill(frame(spark, rows), "t", 1, ["k"])
    assert out.count() == 3 * series.CHUNK + 6 and out.agg(F.count_distinct("t")).first()[0] == out.count()


def test_gap_fill_over_a_range(spark):
    rows = [("a", T0 + timedelta(days=2), 7)]
    out = series.gap_fill(frame(spark, rows), "t", "1 day", ["k"], bounds=(T0, T0 + timedelta(days=4))).orderBy("t")
    assert [r.y for r in out.collect()] == [0, 0, 7, 0, 0]


def plain_fill(times, step):
    """Steps from each given time up to the next one."""
    out = set(times)
    for a, b in zip(times, times[1:], strict=False):
        k = 1
        while step(a, k) < b:
            out.add(step(a, k))
            k += 1
    return sorted(out)


def months_later(t, k):
    number = t.year * 12 + t.month - 1 + k
    last = (datetime(number // 12 + (number % 12 == 11), (number + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return t.replace(year=number // 12, month=number % 12 + 1, day=min(t.day, last))


@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("step, later", [("1 hour", lambda t, k: t + timedelta(hours=k)), ("1 month", months_later),
                                         ("2 months", lambda t, k: months_later(t, 2 * k)), ("year", lambda t, k: months_later(t, 12 * k))])
def test_gap_fill_equals_a_loop_in_one_task_and_in_many(spark, split, step, later):
    rnd = random.Random(len(step))
    span = 400 if "hour" in step else 400 * 720
    rows = {(k, T0 + timedelta(hours=rnd.randrange(span))) for k in ("a", "b", None) for _ in range(40)}
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "k string, t timestamp_ntz, y long, s string").repartition(7)
    got = series.gap_fill(df, "t", step, ["k"], split=split).collect()
    for k in ("a", "b", None):
        times = sorted(t for key, t in rows if key == k)
        assert sorted(r.t for r in got if r.k == k) == plain_fill(times, later)
    assert sum(r.y for r in got) == len(rows) and {r.s for r in got} == {"x", ""}
    alone = series.gap_fill(df.where("k = 'a'").drop("k"), "t", step, split=split)
    assert sorted(r.t for r in alone.collect()) == plain_fill(sorted(t for key, t in rows if key == "a"), later)


def test_gap_fill_without_series_is_split(spark):
    df = spark.range(5000).selectExpr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, id * 7) AS t", "1L AS y")
    out = series.gap_fill(df, "t", 1)
    assert "SinglePartition" not in plan_of(out) and out.count() == 4999 * 7 + 1 and out.agg(F.sum("y")).first()[0] == 5000
    low, high = datetime(2023, 12, 31, 23, 59, 50), datetime(2024, 1, 1, 9, 43, 20)
    assert series.gap_fill(df, "t", 1, bounds=(low, high)).count() == 10 + int((high - T0).total_seconds()) + 1
    assert series.gap_fill(df.limit(0), "t", 1).count() == 0


def test_a_bucket_with_many_series_is_spread(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE 'hot' END AS x", "id AS series", "id % 5 - 1 AS y").repartition(8)
    shares = series.share(df, "y", ["x"])
    assert "Window" not in plan_of(shares)
    total = {r.x: r.t for r in df.groupBy("x").agg(F.sum("y").alias("t")).collect()}
    assert all(abs(r.share - r.y / total[r.x]) < 1e-12 for r in shares.collect())
    stacked = series.stack_positions(df, "x", "series", "y")
    ends, parts = {}, {}
    for r in sorted(stacked.withColumn("p", F.spark_partition_id()).collect(), key=lambda r: r.series):
        ends[r.x] = ends.get(r.x, 0) + r.y
        assert (r.y1, r.y2) == (ends[r.x] - r.y, ends[r.x])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the rows were too large for one partition
    try:
        rows = order.sorted_with_position(df, [F.col("x").asc_nulls_first(), F.col("series")])
        for r in rows.groupBy("x", "__part").count().collect():
            parts.setdefault(r.x, []).append(r["count"])
        assert len(parts["hot"]) > 2 and max(parts["hot"]) < 8000
        again = series.stack_positions(df, "x", "series", "y")
        assert again.exceptAll(stacked).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_sums_skip_nulls_like_a_window(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, 2), (None, 1, 3)], "k string, i int, y long")
    got = {(r.k, r.i): r.s for r in order.running_sums(df, "y", ["k"], [F.col("i")], "s").collect()}
    assert got == {("a", 1): None, ("a", 2): 5, ("a", 3): 5, ("a", 4): 7, (None, 1): 3}


def test_shares_and_stacks(spark):
    df = frame(spark, [("a", T0, 1), ("b", T0, 3), ("a", T0 + timedelta(hours=1), 5), ("c", T0 + timedelta(hours=1), 0)])
    shares = series.share(df, "y", ["t"]).groupBy("t").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares)
    stacked = {(r.k, r.t): (r.y1, r.y2) for r in series.stack_positions(df, "t", "k", "y", "sum").collect()}
    assert stacked[("b", T0)] == (0, 3) and stacked[("a", T0)] == (3, 4)
    assert stacked[("c", T0 + timedelta(hours=1))] == (0, 0)
    with pytest.raises(ValueError):
        series.stack_positions(df, "t", "k", "y", "sideways")


def test_categories_by_measure(spark):
    df = frame(spark, [("a", T0, 1), ("b", T0, 9), ("a", T0, 4), ("c", T0, 2)])
    assert [r.k for r in series.order_categories(df, "k", "y", reverse=True).collect()] == ["b", "a", "a", "c"]


def test_value_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (25.0,), (25.1,)], "v double")
    assert [int(r.y_bin) for r in series.value_bins(df, "v", 25).collect()] == [0, 25, 25, 50]


def hot_rows(spark, n=20_000):
    """One key and one time hold a third of all rows."""
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append(("hot" if hot else f"k{rnd.randrange(50)}", i, 0 if hot else rnd.randrange(1000), round(rnd.random() * 100, 2)))
    return rows, spark.createDataFrame(rows, "k string, id long, t long, v double").repartition(16)


def test_row_numbers_with_a_hot_time(spark):
    rows, df = hot_rows(spark)
    want = {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1)}
    got = {r.id: r.row_number for r in order.numbered(df, [F.col("t"), F.col("id")]).collect()}
    assert got == want
    assert "SinglePartition" not in plan_of(df.orderBy("t", "id"))


def test_exact_quantiles_with_a_hot_key(spark):
    rows, df = hot_rows(spark)
    got = {r.k: r for r in order.exact_quantiles(df, "v", [0, 0.5, 0.95, 1], ["k"]).collect()}
    for key in {r[0] for r in rows}:
        values = [r[3] for r in rows if r[0] == key]
        for p, name in ((0, "q00"), (0.5, "q50"), (0.95, "q95"), (1, "q100")):
            assert abs(getattr(got[key], name) - np.quantile(values, p)) < 1e-9


@pytest.mark.parametrize("limit", [order.BROADCAST_ROWS, 0])
def test_only_values_at_wanted_ranks_go_on(spark, monkeypatch, limit):
    monkeypatch.setattr(order, "BROADCAST_ROWS", limit)
    rows, df = hot_rows(spark)
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    probs = [0.1, 0.5, 0.95]
    picked = order.rows_at_ranks(counts, ["k"], "v", "n", probs)
    by_key = {}
    for r in picked.collect():
        by_key.setdefault(r.k, []).append(r)
    for key in {r[0] for r in rows}:
        values = sorted(r[3] for r in rows if r[0] == key)
        wanted = {f(p * (len(values) - 1)) for p in probs for f in (math.floor, math.ceil)}
        assert sorted(r.v for r in by_key[key]) == sorted({values[w] for w in wanted})
        assert all(values[r["__start"]] == r.v == values[r["__end"] - 1] and r["__total"] == len(values) for r in by_key[key])
    plan = plan_of(picked)
    assert ("BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan) if limit else "SortMergeJoin" in plan


def test_quantiles_ignore_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert order.exact_quantiles(df, "v", [0.5]).first().q50 == 2.0


def test_latest_rows_of_a_hot_key_are_limited_before_the_shuffle(spark):
    rows, df = hot_rows(spark)
    out = topk.latest_k(df, ["k"], [F.col("t").desc(), F.col("id")], 3)
    plan = plan_of(out)
    assert "WindowGroupLimit" in plan
    want = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:3] for k in {r[0] for r in rows}}
    got = {}
    for r in out.collect():
        got.setdefault(r.k, set()).add(r.id)
    assert got == {k: {r[1] for r in v} for k, v in want.items()}


def test_latest_values_skip_null_where_asked(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1, 'x', 'm'), ('a', 2, 'y', NULL) t(k, t, s, m)")
    row = topk.latest_per_key(df, ["k"], "t", ["s", "m"], skip_null=["m"]).first()
    assert (row.latest_t, row.latest_s, row.latest_m) == (2, "y", "m")


def test_top_values_and_distinct_counts(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 2), ('b', 2), ('c', NULL), (NULL, 2) t(s, n)")
    assert [tuple(r) for r in topk.top_values(df, "s", 2).collect()] == [("a", 2), ("b", 1)]
    exact = topk.distinct_counts(df, ["s", "n"], exact=True).first()
    assert (exact.s, exact.n) == (3, 2)
    with pytest.raises(ValueError):
        topk.top_values(df, "missing", 2)


def skewed_tuples(spark, n=40000):
    """A few frequent tuples (one a third of all rows, one with NULL) among many rare ones."""
    key = (F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 7 == 1, F.lit(-2) - F.col("id") % 5)
           .when(F.col("id") % 11 != 2, F.col("id")))
    return spark.range(n).select(key.alias("k"), F.concat(F.lit("v"), (F.coalesce(key, F.lit(0)) % 2).cast("string")).alias("v"), "id")


def plain_top(df, n):
    return [tuple(r) for r in df.groupBy("k", "v").count().orderBy(F.desc("count"), F.asc_nulls_last("k"), "v").limit(n).collect()]


@pytest.mark.parametrize("n", [1, 3, 7, 8, 50])
def test_frequent_tuples_equal_plain_counts(spark, n):
    df = skewed_tuples(spark)
    kept = topk.frequent_rows(df, ["k", "v"], n, slots=1024)
    assert plain_top(kept, n) == plain_top(df, n)
    assert [tuple(r) for r in topk.top_tuples(df, ["k", "v"], n).collect()] == plain_top(df, n)


def test_rare_tuples_are_not_shuffled(spark):
    df = skewed_tuples(spark)
    kept = topk.frequent_rows(df, ["k", "v"], 5, slots=4096)
    assert kept.columns == df.columns
    assert kept.select("k", "v").distinct().count() < 200 < 20000 < df.select("k", "v").distinct().count()
    plan = plan_of(kept)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("Scan ExistingRDD")[0]


def test_even_and_few_tuples_keep_all_rows(spark):
    even = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert topk.frequent_rows(even, ["k", "v"], 10, slots=1024).count() == 5000
    few = spark.range(5000).select((F.col("id") % 9).alias("k"), F.lit("x").alias("v"))
    assert topk.frequent_rows(few, ["k"], 3).count() == 5000
    assert topk.top_tuples(few.limit(0), ["k"], 3).count() == 0
    with pytest.raises(ValueError):
        topk.frequent_rows(few, ["missing"], 3)

"""Saved intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.session import scratch_path


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe when executors are lost, of known size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (u, v).

    In each round every node hooks to its smallest neighbour, paths are halved, and the edges are
    drawn between what remains. Minimums are combined before the shuffle, and joins on a popular node
    have a table on either side, so Spark can split them.
    """
    edges = saved(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "hooks")
        for _ in range(2):
            top = hook.select(F.col("u").alias("q"), F.col("p").alias("r"))
            hook = saved(hook.join(top, hook.p == top.q).select("u", F.col("r").alias("p")), "hooks")
        if first:
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            labels = saved(labels.join(hook, labels.component == hook.u, "left")
                           .select("node", F.coalesce("p", "component").alias("component")), "labels")
        first = False
        left = hook.select(F.col("u").alias("x"), F.col("p").alias("a"))
        right = hook.select(F.col("u").alias("y"), F.col("p").alias("b"))
        edges = saved(edges.join(left, edges.u == left.x).join(right, F.col("v") == right.y).where("a <> b")
                      .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    return labels

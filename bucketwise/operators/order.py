"""Order-dependent results over whole tables, without a single-task window.

A global sort splits rows into range partitions. Positions inside a partition plus
the sizes of the partitions before it give exact global positions; only those
sizes (one row per partition) are ever brought together. The sorted rows are
checkpointed once, so that both readers see the same partitions even when
executors are lost in between.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.functions.fields import quote
from bucketwise.session import checkpointed

# Layout of monotonically_increasing_id: partition index above 33 position bits.
_POSITION_BITS = 33
# Lists of (partition, group) up to this many rows are broadcast; longer ones are joined by key.
BROADCAST_ROWS = 100_000


def sorted_with_position(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows in order, checkpointed, with the number of their partition (``__part``) and their place in it (``__pos``)."""
    placed = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    return (
        checkpointed(placed)
        .withColumn("__part", F.shiftright("__id", _POSITION_BITS))
        .withColumn("__pos", F.col("__id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("__id")
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Exact global row number, from 1, in the given total order."""
    rows = sorted_with_position(df, order)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    # One row per sorted partition: bounded by the shuffle partition count.
    return (
        rows.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + F.col("__pos") + 1)
        .drop("__part", "__pos", "__before")
    )


def running_sums(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to each row, in the given order.

    Sums inside a sorted partition, plus what the group has in the partitions before (one row a partition
    and group): a group is spread over as many partitions as its rows need.
    """
    keys = [F.col(quote(b)) for b in by]
    rows = sorted_with_position(df, [*[k.asc_nulls_first() for k in keys], *order])
    groups = [f"__g{i}" for i in range(len(keys))]
    sums = rows.groupBy(F.col("__part").alias("__p"), *[k.alias(g) for k, g in zip(keys, groups, strict=True)]).agg(
        F.sum(quote(value)).alias("__sum"))
    earlier = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.sum("__sum").over(earlier)).drop("__sum")
    on = [F.col("__part") == F.col("__p")] + [k.eqNullSafe(F.col(g)) for k, g in zip(keys, groups, strict=True)]
    inside = F.sum(quote(value)).over(Window.partitionBy("__part", *keys).orderBy("__pos")
                                      .rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("__before")
    return (rows.join(sums, on).withColumn(name, F.when(before.isNull(), inside).otherwise(before + F.coalesce(inside, F.lit(0))))
            .drop("__part", "__pos", "__p", "__before", *groups))


def _with_run(df: DataFrame, value: str, order: Sequence[Column], name: str) -> DataFrame:
    """The rows in order, with the sum of ``value`` (a long) from the start of their partition on; nothing moves for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sums = pc.cumulative_sum(batch.column(value).cast(pa.int64()), start=total)
            if len(sums):
                total = sums[-1].as_py()
            yield batch.append_column(name, sums)

    return df.orderBy(*order).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def rows_at_ranks(counts: DataFrame, groups: Sequence[str], value: str, number: str, probs: Sequence[float]) -> DataFrame:
    """Of distinct values with their numbers of rows, those that hold a quantile's lower or upper rank in their group.

    Columns: the groups, ``value``, ``__start`` and ``__end`` (ranks from 0, end excluded) and the group's ``__total``.
    The sizes of the sorted partitions say which (partition, group) holds a wanted rank; the others are left out, and
    in these the rows are picked where they lie: at most two rows a group and probability go on.
    """
    order = [F.col(g).asc_nulls_last() for g in groups] + [F.col(value).asc()]
    rows = checkpointed(_with_run(counts, number, order, "__run").withColumn("__part", F.spark_partition_id()))

    def wanted(first: Column, end: Column) -> Column:
        hit = F.lit(False)
        for p in probs:
            position = F.lit(float(p)) * (F.col("__total") - 1)
            for rank in (F.floor(position), F.ceil(position)):
                hit = hit | ((first <= rank) & (rank < end))
        return hit

    edges = rows.groupBy("__part", *groups).agg(F.min(F.col("__run") - F.col(number)).alias("__first"), F.max("__run").alias("__last"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("__last") - F.col("__first")
    edges = (edges.withColumn("__before", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
             .withColumn("__total", F.sum(size).over(Window.partitionBy(*groups)))
             .where(wanted(F.col("__before"), F.col("__before") + size))
             .select(F.col("__part").alias("__p"), *[F.col(g).alias(f"{g}e") for g in groups], "__total",
                     (F.col("__before") - F.col("__first")).alias("__shift")))
    edges = checkpointed(edges)
    if edges.count() <= BROADCAST_ROWS:
        edges = F.broadcast(edges)
    on = [F.col("__part") == F.col("__p")] + [F.col(g).eqNullSafe(F.col(f"{g}e")) for g in groups]
    end = F.col("__run") + F.col("__shift")
    return (rows.join(edges, on).withColumn("__end", end).withColumn("__start", end - F.col(number))
            .where(wanted(F.col("__start"), F.col("__end"))).select(*groups, value, "__start", "__end", "__total"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles per group, exact at any group size or skew.

    Equal values are counted first; the sorted distinct values carry running counts,
    so a hot group is spread over as many partitions as its values need, and only the
    values at the wanted ranks are brought together.
    """
    keys = [quote(b) for b in by]
    v = F.col(quote(value)).cast("double")
    groups = [f"__g{i}" for i in range(len(keys))]
    counts = (
        df.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], v.alias("__v"))
        .where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*groups, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    aggs = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("__total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("__start") <= rank) & (rank < F.col("__end"))
            aggs.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}{i}"))
    picked = (rows_at_ranks(counts, groups, "__v", "__n", probs)
              .groupBy(*groups).agg(F.max("__total").alias("__total"), *aggs))
    columns = [F.col(g).alias(b) for g, b in zip(groups, by, strict=True)]
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("__total") - 1)
        part = position - F.floor(position)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        columns.append((low + (high - low) * part).alias(f"q{round(p * 100):02d}"))
    return picked.select(*columns)

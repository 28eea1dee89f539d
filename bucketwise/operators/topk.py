"""Most frequent values, and newest rows per key.

Counts and newest rows are reduced on the map side, so one hot key costs each task
a single partial result. Where there are many different tuples, a small table of
counts by hash slot tells first which of them can be among the most frequent, so
that rare tuples are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.functions.fields import quote
from bucketwise.functions.schema import require_columns
from bucketwise.session import checkpointed

# From this k on, groups are limited in parts first: Spark's own limit before the shuffle ends here.
LARGE_K, PARTS = 1000, 64
# Hash slots that tuples are counted in; a task ships at most one row a slot.
SLOTS = 1 << 16


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values of a column as text; ties go to the smaller value."""
    require_columns(df, [column])
    return top_tuples(df.select(F.col(quote(column)).cast("string").alias("value")), ["value"], k)


def top_tuples(df: DataFrame, dims: Sequence[str], n: int, name: str = "count") -> DataFrame:
    """Most frequent combinations of dimension values; ties go to the smaller tuple, NULL last."""
    return (
        frequent_rows(df, dims, n)
        .groupBy(*[F.col(quote(d)) for d in dims])
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.col(name).desc(), *[F.col(quote(d)).asc_nulls_last() for d in dims])
        .limit(n)
    )


def frequent_rows(df: DataFrame, dims: Sequence[str], n: int, slots: int = SLOTS) -> DataFrame:
    """The rows without those whose tuple is certainly not among the ``n`` most frequent.

    Rows are counted by the hash slot of their tuple; a slot's total is no less than the count of any
    tuple in it. The tuples of the heaviest slots are counted exactly, and the n-th of them is a floor
    that every wanted tuple reaches. Slots below the floor are left out; all rows of a tuple stay or go
    together, so counts over what stays are exact. Where tuples are few, or so even that no slot is below
    the floor, all rows stay. Tables of slots are broadcast: ``slots`` rows of two numbers at most.
    """
    require_columns(df, dims)
    heaviest = 4 * n
    if heaviest >= slots or any(df.schema[d].dataType.typeName() in ("map", "variant") for d in dims):
        return df
    tuples = [F.col(quote(d)) for d in dims]
    slot = F.pmod(F.xxhash64(*tuples), F.lit(slots))
    totals = checkpointed(df.groupBy(slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__total")))
    if totals.count() * 4 <= slots:  # so few tuples that counting them ships no more than the slots do
        return df
    dealt = df.withColumn("__slot", slot)
    heavy = totals.orderBy(F.col("__total").desc(), "__slot").limit(heaviest).select("__slot")
    counted = (dealt.join(F.broadcast(heavy), "__slot", "left_semi").groupBy(*tuples).agg(F.count(F.lit(1)).alias("__n"))
               .orderBy(F.col("__n").desc()).limit(n))
    floor = counted.agg(F.count(F.lit(1)).alias("found"), F.min("__n").alias("least")).first()
    if floor.found < n:
        return df
    wanted = totals.where(F.col("__total") >= floor.least).select("__slot")
    return dealt.join(F.broadcast(wanted), "__slot", "left_semi").drop("__slot")


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str],
                   skip_null: Sequence[str] = ()) -> DataFrame:
    """Newest value of each column per key, as a hash aggregate without sorting.

    Columns in ``skip_null`` take their newest non-NULL value.
    """
    aggs = [F.max(quote(ts)).alias(f"latest_{ts}")]
    for v in values:
        col = F.col(quote(v))
        at = F.when(col.isNotNull(), F.col(quote(ts))) if v in skip_null else F.col(quote(ts))
        aggs.append(F.max_by(col, at).alias(f"latest_{v}"))
    return df.groupBy(*[F.col(quote(k)) for k in keys]).agg(*aggs)


def latest_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
             name: str | None = None) -> DataFrame:
    """First ``k`` rows per key in the given order.

    Spark limits each group before the shuffle, so a task ships at most ``k`` rows of
    a key however many it holds. A large ``k`` takes the first rows of parts of each group
    before, so that no task sorts a whole hot group.
    """
    if k >= LARGE_K:
        salt = F.pmod(F.xxhash64(*[F.to_json(F.struct("*"))]), F.lit(PARTS))
        within = Window.partitionBy(*[F.col(quote(c)) for c in keys], "__part").orderBy(*order)
        df = (df.withColumn("__part", salt).withColumn("__rank", F.row_number().over(within))
              .where(F.col("__rank") <= k).drop("__part", "__rank"))
    rank = F.row_number().over(Window.partitionBy(*[F.col(quote(c)) for c in keys]).orderBy(*order))
    out = df.withColumn("__rank", rank).where(F.col("__rank") <= k)
    return out.withColumnRenamed("__rank", name) if name else out.drop("__rank")


def as_key(df: DataFrame, column: str) -> Column:
    """A text that is equal just where values of the column are equal."""
    col, dtype = F.col(quote(column)), df.schema[column].dataType
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(col.isNotNull(), F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        col = F.when(col == 0, F.lit(0).cast(dtype)).otherwise(col)  # one zero
    return col.cast("string")


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Distinct values of many columns in one scan (one output row).

    The default uses mergeable sketches. Exact counting groups (column, value) pairs
    first, which spreads any column's values over all tasks; nested values are told apart as JSON.
    """
    if not exact:
        return df.agg(*[F.approx_count_distinct(quote(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), as_key(df, c).alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.explode(pairs).alias("p")).where("p.v IS NOT NULL").groupBy("p.i", "p.v").agg(F.lit(1))
    return values.agg(*[F.count_if(F.col("i") == i).alias(c) for i, c in enumerate(columns)])

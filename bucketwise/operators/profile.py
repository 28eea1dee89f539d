"""Table profiles: cardinalities, value lists, and sampled dimension buckets.

A few passes over the table in all: cardinalities of every column at once, value
lists of every small column at once, which dimension combinations can be the most
frequent, and their newest rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as dc_field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketwise.functions.fields import quote
from bucketwise.functions.schema import is_listable, is_numeric_like, time_column
from bucketwise.operators.filters import recent
from bucketwise.sources.tables import local_rows
from bucketwise.operators.order import running_sums
from bucketwise.operators.topk import distinct_counts, frequent_rows, latest_k, top_tuples

# Characters of the readable part of a bucket's name; a digest of the whole tuple follows it.
NAME_LIMIT = 150


@dataclass(frozen=True)
class ProfileConfig:
    """What a profile looks at. ``list_values`` limits listed values where a caller wants that; all are listed else.

    ``bucket_limit`` and ``samples_per_bucket`` make the samples a report of the most frequent tuples;
    the metadata says which dimensions there were, ``bucket_totals`` how many tuples.
    """

    skip: tuple[str, ...] = ()
    avoided_dims: tuple[str, ...] = ()
    preferred_dims: tuple[str, ...] = ()
    max_dims: int = 3
    list_threshold: int = 50
    list_values: int | None = None
    samples_per_bucket: int = 3
    bucket_limit: int = 200
    where: str | None = None
    recent: timedelta | None = None
    ts: str | None = None
    tie_break: tuple[str, ...] = ()
    exact: bool = False


@dataclass(frozen=True)
class Profile:
    """A profile as frames; ``metadata`` is plain data."""

    metadata: dict
    column_stats: DataFrame
    column_values: DataFrame
    bucket_samples: DataFrame | None
    bucket_totals: DataFrame | None = None
    dims: tuple[str, ...] = dc_field(default_factory=tuple)

    @property
    def columns(self) -> list[str]:
        return self.metadata["columns"]


def split_columns(df: DataFrame, skip: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns listed at once, and columns whose cardinality is asked first."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    return [f.name for f in fields if is_listable(f)], [f.name for f in fields if not is_listable(f)]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count) of several columns, in one pass that combines pairs on the map side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quote(c)).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("count"))


def column_values(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Values of several columns by frequency: (column, value, count, rank); the first ``limit`` of each if given."""
    return _ranked(value_counts(df, columns), limit)


def _ranked(counted: DataFrame, limit: int | None) -> DataFrame:
    order = [F.col("count").desc(), F.col("value").asc_nulls_last()]
    if limit:
        return latest_k(counted, ["column"], order, limit, "rank").select("column", "value", "count", "rank")
    # The whole list of a column may be long: it is ranked over sorted partitions.
    ranked = running_sums(counted.withColumn("__one", F.lit(1)), "__one", ["column"], order, "rank")
    return ranked.select("column", "value", "count", F.col("rank").cast("int").alias("rank"))


def choose_dims(columns: Sequence[str], listable: Sequence[str], config: ProfileConfig) -> list[str]:
    """Preferred dimensions the table has, else its listable columns."""
    chosen = [d for d in config.preferred_dims if d in columns]
    if not chosen:
        chosen = [c for c in listable if c not in config.avoided_dims]
    return chosen[: config.max_dims]


def sample_order(df: DataFrame, config: ProfileConfig) -> list[Column]:
    """Newest first; equal or missing times fall back to a stable order."""
    name = time_column(df, config.ts)
    newest = [F.col(quote(name)).desc_nulls_last()] if name else []
    ties = [F.col(quote(c)).asc() for c in config.tie_break]
    return newest + (ties or [F.xxhash64(*[F.to_json(F.struct("*"))] if _hard_to_hash(df) else
                                         [F.col(quote(c)) for c in df.columns])])


def _hard_to_hash(df: DataFrame) -> bool:
    return any(f.dataType.typeName() in ("map", "variant") for f in df.schema.fields)


def bucket_samples(df: DataFrame, dims: Sequence[str], config: ProfileConfig) -> DataFrame:
    """Most frequent dimension tuples with their newest rows.

    Columns: the dims, ``count``, ``sample_no`` and ``sample`` (a struct without the
    skipped columns). Spark broadcasts the tuples if they are small enough.
    """
    names = [f"__d{i}" for i in range(len(dims))]
    ts = time_column(df, config.ts)
    if ts:
        top = _top_tuples_with_newest_days(df, dims, ts, config)
    else:
        top = top_tuples(df, dims, config.bucket_limit, "__count").withColumn("__since", F.lit(None).cast("date"))
    wanted = top.select(*[F.col(quote(d)).alias(n) for d, n in zip(dims, names)], "__count", "__since")
    kept = [c for c in df.columns if c not in config.skip]
    base = df.select(*[F.col(quote(c)) for c in dict.fromkeys([*kept, *dims, *([ts] if ts else [])])])
    on = [base[d].eqNullSafe(wanted[n]) for d, n in zip(dims, names)]
    if ts:
        on.append(wanted["__since"].isNull() | (F.to_date(base[ts]) >= wanted["__since"]))
    matched = base.join(wanted, on)
    newest = latest_k(matched, dims, sample_order(base, config), config.samples_per_bucket, "sample_no")
    return newest.select(
        *[F.col(quote(d)) for d in dims], F.col("__count").alias("count"), "sample_no",
        F.struct(*[F.col(quote(c)) for c in kept]).alias("sample"))


def _top_tuples_with_newest_days(df: DataFrame, dims: Sequence[str], ts: str, config: ProfileConfig) -> DataFrame:
    """Most frequent tuples, each with the day that its newest samples reach back to.

    Counts per tuple and day tell where the samples lie, so that the sampling pass
    sorts the rows of a few days instead of all rows. Without such a day (NULL) every
    row of the tuple is looked at. Only tuples that can be among the most frequent are counted by day.
    """
    cols = [F.col(quote(d)) for d in dims]
    narrow = df.select(*[F.col(quote(c)) for c in dict.fromkeys([*dims, ts])])
    daily = frequent_rows(narrow, dims, config.bucket_limit).groupBy(*cols, F.to_date(F.col(quote(ts))).alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    newest_first = Window.partitionBy(*cols).orderBy(F.col("__day").desc_nulls_last())
    enough = F.sum("__n").over(newest_first) >= config.samples_per_bucket
    return (
        daily.withColumn("__enough", enough).groupBy(*cols)
        .agg(F.sum("__n").alias("__count"), F.max(F.when(F.col("__enough"), F.col("__day"))).alias("__since"))
        .orderBy(F.col("__count").desc(), *[c.asc_nulls_last() for c in cols])
        .limit(config.bucket_limit)
    )


def profile_table(df: DataFrame, name: str, now: datetime, config: ProfileConfig = ProfileConfig()) -> Profile:
    """Profile a table. Only one row of cardinalities reaches the driver."""
    if config.recent or config.where:
        df = recent(df, config.recent or timedelta(0), now, config.ts, config.where)
    listable, probe = split_columns(df, config.skip)
    counted = _plain(df, probe)
    counts = distinct_counts(df, counted, config.exact).first().asDict() if counted else {}
    # Estimates only say where it is worth to count; whether a column is listed is decided on its exact count.
    likely = [c for c in counted if counts[c] < 2 * config.list_threshold and not is_numeric_like(df.schema[c].dataType)]
    spark = df.sparkSession
    if listable or likely:
        pairs = value_counts(df, [*listable, *likely])
        lengths = pairs.groupBy("column").agg(F.count("value").alias("distinct"), F.count(F.lit(1)).alias("length"))
        listed = lengths.where(F.col("column").isin(listable) | F.col("distinct").between(1, config.list_threshold - 1))
        values = _ranked(pairs.join(listed.select("column"), "column", "left_semi"), config.list_values)
    else:
        values = local_rows(spark, [], "column string, value string, count long, rank int")
        listed = local_rows(spark, [], "column string, distinct long, length long")
    facts = [(f.name, f.dataType.simpleString(), counts.get(f.name)) for f in df.schema.fields if f.name not in config.skip]
    known = local_rows(spark, facts, "column string, type string, estimate long")
    stats = known.join(listed, "column", "left").select(
        "column", "type", F.col("length").alias("cardinality"),
        F.when(F.col("length").isNull(), F.col("estimate")).alias("cardinality_approx"),
        F.least("length", F.lit(config.list_values).cast("long")).alias("listed"))

    dims = choose_dims(df.columns, listable, config)
    samples = bucket_samples(df, dims, config) if dims else None
    totals = (df.groupBy(*[F.col(quote(d)) for d in dims]).agg(F.count(F.lit(1)).alias("__rows"))
              .agg(F.count(F.lit(1)).alias("tuples"), F.sum("__rows").alias("rows"))) if dims else None
    metadata = {
        "table": name, "sampled_at": now.strftime("%Y-%m-%dT%H:%M:%SZ"), "bucket_dimensions": dims,
        "list_threshold": config.list_threshold, "samples_per_bucket": config.samples_per_bucket,
        "applied_where": config.where or "", "bucket_limit": config.bucket_limit, "columns": [f[0] for f in facts],
        "available_dimensions": choose_dims(df.columns, listable, replace(config, max_dims=len(df.columns))),
    }
    return Profile(metadata, stats, values, samples, totals, tuple(dims))


def _plain(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that can be counted: maps and schemaless values have no equality."""
    return [n for n in names if df.schema[n].dataType.typeName() not in ("map", "variant")]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def continuous_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest, largest and approximate median per numeric column, in one scan."""
    def facts(c: str) -> Column:
        col = F.col(quote(c)).cast("double")
        return F.struct(F.lit(c).alias("column"), F.min(col).alias("min"), F.max(col).alias("max"),
                        F.percentile_approx(col, 0.5, 10000).alias("median"))

    rows = df.agg(F.array(*[facts(c) for c in columns]).alias("rows"))
    return rows.select(F.inline("rows"))


def anonymize_profile(profile: Profile, chain) -> Profile:
    """Run values, dims and samples through a processor chain; counts stay.

    A processor that drops a column blanks its values, so that counts remain.
    """
    from bucketwise.operators.anonymize import anonymize, apply_by_name

    types = {f.name: f.dataType for f in profile.column_values.schema.fields}
    names = profile.columns
    masked = apply_by_name(F.col("column"), F.col("value"), names, types["value"], chain)
    values = profile.column_values.withColumn("value", masked)
    samples = profile.bucket_samples
    if samples is not None:
        samples = anonymize(samples, chain, keep=("count", "sample_no"))
    return replace(profile, column_values=values, bucket_samples=samples)


def bucket_names(df: DataFrame, dims: Sequence[str], name: str = "bucket_name") -> DataFrame:
    """A file-safe, unique name per dimension tuple: ``k=v__k=v__`` and a digest of the whole tuple."""
    parts, whole = [], []
    for d in sorted(dims):
        text = F.coalesce(F.col(quote(d)).cast("string"), F.lit("<nil>"))
        safe = F.trim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
        safe = F.when(safe == "", F.lit("empty")).otherwise(safe)
        parts.append(F.concat(F.lit(f"{d}="), safe))
        whole.append(F.coalesce(F.concat(F.length(F.col(quote(d)).cast("string")).cast("string"), F.lit(":"),
                                         F.col(quote(d)).cast("string")), F.lit("-")))
    readable = F.substring(F.concat_ws("__", *parts), 1, NAME_LIMIT) if parts else F.lit("bucket")
    return df.withColumn(name, F.concat_ws("__", readable, F.md5(F.concat_ws(",", *whole).cast("binary"))))

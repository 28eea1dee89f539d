"""Writing results: tables, export formats, JSON lines and profiles."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.functions.fields import quote
from bucketwise.operators.anonymize import Processor, anonymize
from bucketwise.operators.profile import Profile, bucket_names
from bucketwise.operators.shape import export_safe
from bucketwise.sources.tables import local_rows

EXPORT_FORMATS = ("parquet", "json", "xml", "csv", "tsv", "orc")


def load_into(df: DataFrame, target: str, mode: str = "append", partition_by: Sequence[str] = (),
              sort_by: Sequence[str] = ()) -> None:
    """Insert rows into a table (by name) or a Parquet folder (by path).

    ``sort_by`` orders rows inside each written file, so that readers skip row groups.
    Partitioned writes are balanced: few files per value, and large values split.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(quote(c)) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in target:
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def clear(df: DataFrame, path: str) -> None:
    """Leave an empty folder of the same schema behind."""
    df.limit(0).write.mode("overwrite").parquet(path)


def export(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """Write a result in an exchange format; schemaless columns become text."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"unknown export format {fmt!r}; known: {EXPORT_FORMATS}")
    safe = export_safe(df)
    if fmt in ("csv", "tsv"):  # nested values have no form of their own there
        nested = {f.name: F.to_json(F.col(quote(f.name))) for f in safe.schema.fields
                  if f.dataType.typeName() in ("array", "map", "struct")}
        safe = safe.withColumns(nested) if nested else safe
    writer = safe.write.mode(mode)
    if fmt == "tsv":
        writer.option("sep", "\t").option("header", True).csv(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "xml":
        writer.option("rowTag", "row").xml(path)
    else:
        writer.format(fmt).save(path)


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def purge_expired(spark: SparkSession, path: str, partition: str, oldest: date) -> list[str]:
    """Remove the folders of days before ``oldest`` from a date-partitioned folder; other data is not touched.

    Returns the days that were removed. Only names are listed, nothing is read or rewritten.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for entry in files.listStatus(root):
        name, _, value = entry.getPath().getName().partition("=")
        if entry.isDirectory() and name == partition and _is_day(value) and date.fromisoformat(value) < oldest:
            files.delete(entry.getPath(), True)
            gone.append(value)
    return sorted(gone)


def _is_day(text: str) -> bool:
    try:
        return bool(date.fromisoformat(text))
    except ValueError:
        return False


# -- JSON lines ---------------------------------------------------------------------------

def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines with a declared schema, or else with that of all lines; blank and broken lines are skipped."""
    return parse_json_lines(spark.read.text(path), schema)


def parse_json_lines(lines: DataFrame, schema: str | T.StructType | None = None, column: str = "value") -> DataFrame:
    """Parse a text column. A stream needs a declared schema."""
    if schema is None:
        if lines.isStreaming:
            raise ValueError("a stream of JSON lines needs a schema, or scrub_json_lines")
        schema = discovered_schema(lines, column)
    return _objects(lines, column).select(F.from_json(F.col(column), schema).alias("row")).select("row.*")


def _objects(lines: DataFrame, column: str) -> DataFrame:
    return lines.where(F.schema_of_variant(F.try_parse_json(F.trim(F.col(column)))).startswith("OBJECT"))


def discovered_schema(lines: DataFrame, column: str = "value") -> T.StructType:
    """The fields that any of the lines has, from one aggregate that is merged before the shuffle.

    Fields with values of several types, with nulls only, and empty objects are text: the JSON of the value, a text as
    it is. The result grows with the number of different names; lines in which names are data are for ``scrub_json_lines``.
    """
    parsed = _objects(lines, column).select(F.try_parse_json(F.trim(F.col(column))).alias("line"))
    found = parsed.agg(F.schema_of_variant_agg("line").alias("found")).first()["found"]
    if not found.startswith("OBJECT<") or found == "OBJECT<>":  # no line, or none with a field
        return T.StructType()
    pieces = re.split(r"(`(?:[^`]|``)*`)", found)  # quoted names stay
    for i in range(0, len(pieces), 2):
        plain = re.sub(r"OBJECT<>", "STRING", pieces[i])
        plain = re.sub(r"(: |ARRAY<)(?:VARIANT|VOID)(?=[,>])", r"\1STRING", plain)
        pieces[i] = plain.replace("OBJECT<", "STRUCT<")
    return T.StructType.fromDDL("row " + "".join(pieces)).fields[0].dataType


def scrub_json_lines(lines: DataFrame, chain: Processor, column: str = "value") -> DataFrame:
    """JSON lines through a chain of rules, in batch or on a stream; fields need not be declared.

    Each line keeps the fields it has, at any depth, but for those the chain drops. Blank lines, broken ones and those
    that are no object are skipped. The result is one text column.
    """
    rows = lines.select(F.try_parse_json(F.trim(F.col(column))).alias(column))
    kept = rows.where(F.schema_of_variant(F.col(column)).startswith("OBJECT"))
    return anonymize(kept, chain).select(F.to_json(F.col(column)).alias(column))


# -- profiles -----------------------------------------------------------------------------

def write_profile(profile: Profile, path: str) -> None:
    """Overview next to one folder per bucket; a rerun replaces what was there."""
    spark = profile.column_stats.sparkSession
    meta = local_rows(spark, [(json.dumps(profile.metadata),)], "metadata string")
    meta.write.mode("overwrite").json(f"{path}/metadata")
    profile.column_stats.write.mode("overwrite").json(f"{path}/column_stats")
    profile.column_values.write.mode("overwrite").json(f"{path}/column_values")
    if profile.bucket_samples is None:
        return
    rows = bucket_names(profile.bucket_samples, list(profile.dims))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("ignoreNullFields", False)
     .partitionBy("bucket_name").json(f"{path}/buckets"))


def read_profile(spark: SparkSession, path: str, like: Profile | None = None) -> Profile:
    """Read back what :func:`write_profile` wrote."""
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    dims = tuple(meta["bucket_dimensions"])
    samples = None
    if dims:
        reader = spark.read.option("mode", "PERMISSIVE")
        if like is not None and like.bucket_samples is not None:
            reader = reader.schema(T.StructType([*like.bucket_samples.schema.fields,
                                                 T.StructField("bucket_name", T.StringType())]))
        samples = reader.json(f"{path}/buckets")
    stats_schema = "column string, type string, cardinality long, cardinality_approx long, listed long"
    values_schema = "column string, value string, count long, rank int"
    return Profile(meta, spark.read.schema(stats_schema).json(f"{path}/column_stats"),
                   spark.read.schema(values_schema).json(f"{path}/column_values"), samples, None, dims)

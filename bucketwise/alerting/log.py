"""The alert log: which results are kept, the current status, and its history.

Groups here are one alert, or one alert and day. Their size is bounded by the
schedule (at most one result per minute), whatever the monitored data looks like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketwise.alerting.evaluate import ERROR, ID, OK, WARN
from bucketwise.functions.fields import quote
from bucketwise.functions.scalars import composite_id
from bucketwise.operators.filters import as_utc, sql_literal
from bucketwise.operators.topk import latest_per_key

EVENT_SCHEMA = ("alert_id_group string, alert_id_key string, timestamp timestamp_ntz, status string, "
                "message string, event_date date")
# How long log entries are kept, and what a failed notification says.
RETENTION_DAYS = 365
NOTIFIER_FAILED = "Error triggering notifier: %s"


def changes(results: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Results worth keeping: a new status, or the first result of a day.

    The first result of a day is always kept, so the previous result only matters
    within the same alert and day. ``current`` (see :func:`current_status`) stands for
    the last entry already stored. ``reason`` is ``change`` where the status before, on whatever
    day, was another one, and ``daily`` where it was the same or there was none.
    """
    day = F.to_date("timestamp")
    within_day = Window.partitionBy(*ID, "__day").orderBy("timestamp")
    ever = Window.partitionBy(*ID).orderBy("timestamp")
    work = (results.withColumn("__day", day).withColumn("__previous", F.lag("status").over(within_day))
            .withColumn("__before", F.lag("status").over(ever)))
    if current is not None:
        stored = current.select(*ID, F.col("latest_status").alias("__stored"),
                                F.to_date("latest_timestamp").alias("__stored_day"))
        work = work.join(stored, list(ID), "left")
        known_today = F.when(F.col("__stored_day") == F.col("__day"), F.col("__stored"))
        work = (work.withColumn("__previous", F.coalesce("__previous", known_today))
                .withColumn("__before", F.coalesce("__before", "__stored")))
    kept = work.where(F.col("__previous").isNull() | (F.col("__previous") != F.col("status")))
    reason = F.when(F.col("__before") != F.col("status"), F.lit("change")).otherwise(F.lit("daily"))
    return kept.withColumn("reason", reason).drop("__day", "__previous", "__before", "__stored", "__stored_day")


def current_status(events: DataFrame) -> DataFrame:
    """Latest time, status and message per alert."""
    return latest_per_key(events, ID, "timestamp", ["status", "message"], skip_null=["message"])


def history(events: DataFrame, now: datetime, group_pattern: str = "%") -> DataFrame:
    """Status intervals per alert; the last one stays open until ``now``."""
    following = F.lead("timestamp").over(Window.partitionBy(*ID).orderBy("timestamp"))
    open_end = F.expr(sql_literal(as_utc(now)))
    return events.where(F.col(ID[0]).ilike(group_pattern)).select(
        composite_id(*ID).alias("alert_id"), *ID, F.col("timestamp").alias("start"), "status", "message",
        F.coalesce(following, open_end).alias("end"))


def notification_state(status="status"):
    """Outgoing names of the states."""
    s = F.col(status)
    return F.when(s == OK, F.lit("NORMAL")).when(s == WARN, F.lit("WARNING")).otherwise(F.lit("ERROR"))


def notify(kept: DataFrame, send: Callable[[dict], None]) -> DataFrame:
    """Call ``send`` for every kept row, on the executors.

    A failing call turns the row into an error that carries the failure's text. A
    retried task calls ``send`` again, so receivers must accept repeats.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, row in enumerate(batch.to_dict("records")):
                try:
                    send(row)
                except Exception as failure:  # noqa: BLE001 - any failure is recorded
                    batch.iloc[i, batch.columns.get_loc("status")] = ERROR
                    batch.iloc[i, batch.columns.get_loc("message")] = NOTIFIER_FAILED % failure
            yield batch

    return kept.mapInPandas(each, kept.schema)


def within_retention(events: DataFrame, ts: str, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the retention period, as a filter the reader can prune partitions by."""
    oldest = (as_utc(now) - timedelta(days=days)).replace(hour=0, minute=0, second=0, microsecond=0)
    return events.where(F.expr(f"{quote(ts)} >= {sql_literal(oldest)}"))


class AlertLog:
    """Parquet log, partitioned by day: appended to, or rewritten by day where results can still change."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, kept: DataFrame) -> None:
        """One bulk write per run."""
        self._write(kept, "append")

    def replace(self, kept: DataFrame) -> None:
        """Clear the log and store a recomputed range."""
        self._write(kept, "overwrite")

    def rewrite_days(self, kept: DataFrame) -> None:
        """Replace the days that ``kept`` has rows of."""
        self._write(kept, "overwrite", "dynamic")

    def _write(self, kept: DataFrame, mode: str, partitions: str = "static") -> None:
        rows = kept.select(*ID, "timestamp", "status", "message", F.to_date("timestamp").alias("event_date"))
        # Few files per day, while a day with very many rows is still split.
        balanced = rows.hint("rebalance", F.col("event_date"))
        (balanced.write.mode(mode).option("partitionOverwriteMode", partitions)
         .partitionBy("event_date").parquet(self.path))

    def clear(self) -> None:
        empty = self.spark.createDataFrame([], EVENT_SCHEMA)
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("event_date").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self.path)

    def current(self) -> DataFrame:
        return current_status(self.read())

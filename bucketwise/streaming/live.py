"""The batch operators on streams: live series, live alerts, change feeds.

Each function takes and returns streaming DataFrames; :func:`run_available` drives
one to the end of its input, which is also how a bounded backlog is caught up.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bucketwise.alerting.definitions import AlertDefinition, definitions_df
from bucketwise.alerting.evaluate import ID, bucket_rows, judge
from bucketwise.alerting.log import AlertLog, changes
from bucketwise.functions.buckets import Width, epoch_seconds
from bucketwise.functions.fields import quote
from bucketwise.operators.anonymize import Processor, anonymize
from bucketwise.session import checkpointed, scratch_path
from bucketwise.sources.files import Files


def live_series(events: DataFrame, ts: str, series: Sequence[str], width: int | str, lateness: str,
                measure: str = "count(*)", name: str = "y") -> DataFrame:
    """A bucketed series over a stream; events later than ``lateness`` are left out.

    Update mode emits running buckets, append mode emits each bucket once it is final.
    """
    w = Width.parse(width)
    every = f"{w.seconds} seconds"
    window = (F.window(ts, every, every, f"{w.offset_seconds} seconds") if w.offset_seconds
              else F.window(ts, every))
    dtype = events.schema[ts].dataType
    # Watermarks need a zoned timestamp; the result goes back to the column's own type.
    return (
        events.withColumn(ts, F.col(quote(ts)).cast("timestamp")).withWatermark(ts, lateness)
        .groupBy(window.alias("__window"), *[F.col(quote(s)) for s in series])
        .agg(F.expr(measure).alias(name))
        .select(F.col("__window.start").cast(dtype).alias("time"), *[F.col(quote(s)) for s in series], name)
    )


class RunningTable:
    """The newest row of each key from a stream in update mode, as a table. This is the sink of a running series.

    Each micro-batch is a folder of its own, so a repeated batch replaces its own rows. Every ``compact_every`` batches the
    days they touch are written anew with one row a key, and a manifest names the valid files of each day and the last batch
    in them. A reader takes the newest manifest: days without later batches are read as they are, only the others
    are merged. The manifest is put in place by one rename, after everything it names has been written, so a compaction that
    fails on the way changes nothing. What a manifest replaces is kept until the next one, for readers at work.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], time: str, compact_every: int = 20, tasks_a_day: int = 4):
        self.spark, self.path, self.keys, self.time = spark, path.rstrip("/"), list(keys), time
        self.compact_every, self.tasks_a_day = compact_every, tasks_a_day
        self._files = Files(spark)

    def write(self, batch: DataFrame, number: float) -> None:
        """Usable as a ``foreachBatch`` function."""
        rows = batch.withColumn(_DAY, F.to_date(self.time)).withColumn("stored_batch", F.lit(float(number)))
        # A batch touches few days as a rule; their rows are dealt to some tasks each, which write one file a day.
        part = F.pmod(F.xxhash64(*[F.col(quote(k)) for k in self.keys]), F.lit(self.tasks_a_day))
        (rows.repartition(F.col(_DAY), part).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy(_DAY).parquet(self._batch(number)))
        if not self._files.exists(f"{self.path}/schema"):
            self._files.put(f"{self.path}/schema", rows.schema.json())
        manifest = self._manifest()
        # The batch at hand may be repeated; those before it are final.
        done = [n for n in self._batches() if manifest["through"] < n < number]
        if len(done) >= self.compact_every:
            self._compact(manifest, done)

    def exists(self) -> bool:
        return self._files.exists(f"{self.path}/schema")

    def read(self, since: date | None = None) -> DataFrame:
        """The newest rows, of days from ``since`` on."""
        manifest = self._manifest()
        later = [n for n in self._batches() if n > manifest["through"]]
        wanted = lambda day: since is None or day == _NO_DAY or day >= since.isoformat()
        touched = {day for n in later for day in self._days(self._batch(n)) if wanted(day)}
        days = {day: folder for day, folder in manifest["days"].items() if wanted(day)}
        closed = self._load([f for day, f in days.items() if day not in touched])
        opened = [f for day, f in days.items() if day in touched]
        opened += [f"{self._batch(n)}/{_DAY}={day}" for n in later for day in self._days(self._batch(n)) if day in touched]
        return self._plain(closed).unionByName(self._plain(self._newest(self._load(opened))))

    def _batch(self, number: float) -> str:
        return f"{self.path}/batches/{float(number)!r}"

    def _batches(self) -> list[float]:
        return sorted(float(n) for n in self._files.names(f"{self.path}/batches"))

    def _days(self, folder: str) -> list[str]:
        return [n.partition("=")[2] for n in self._files.names(folder) if n.startswith(f"{_DAY}=")]

    def _manifests(self) -> list[str]:
        return sorted(self._files.names(f"{self.path}/manifests"))

    def _manifest(self, back: int = 1) -> dict:
        found = self._manifests()
        return json.loads(self._files.text(f"{self.path}/manifests/{found[-back]}")) if len(found) >= back else {"through": -1.0, "days": {}}

    def _load(self, folders: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._files.text(f"{self.path}/schema")))
        stored = T.StructType([f for f in schema.fields if f.name != _DAY])
        if not folders:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*folders)

    def _newest(self, stored: DataFrame) -> DataFrame:
        rest = [c for c in stored.columns if c not in self.keys]
        newest = F.max_by(F.struct(*[F.col(quote(c)) for c in rest]), "stored_batch").alias("__newest")
        return (stored.groupBy(*[F.col(quote(k)) for k in self.keys]).agg(newest)
                .select(*[F.col(quote(k)) for k in self.keys], "__newest.*"))

    @staticmethod
    def _plain(stored: DataFrame) -> DataFrame:
        return stored.drop("stored_batch")

    def _compact(self, manifest: dict, done: Sequence[float]) -> None:
        touched = {day for n in done for day in self._days(self._batch(n))}
        folders = [manifest["days"][day] for day in touched if day in manifest["days"]]
        folders += [f"{self._batch(n)}/{_DAY}={day}" for n in done for day in self._days(self._batch(n))]
        target = f"{self.path}/days/{done[-1]!r}-{uuid.uuid4().hex}"
        rows = self._newest(self._load(folders)).withColumn(_DAY, F.to_date(self.time))
        (rows.hint("rebalance", F.col(_DAY)).write.partitionBy(_DAY).parquet(target))  # few files a day, large days split
        days = {**manifest["days"], **{day: f"{target}/{_DAY}={day}" for day in self._days(target)}}
        self._commit({"through": done[-1], "days": days})

    def _commit(self, manifest: dict) -> None:
        before = self._manifest()
        number = int(self._manifests()[-1]) + 1 if self._manifests() else 0
        self._files.put(f"{self.path}/manifests/{number:012d}", json.dumps(manifest))
        for name in self._manifests()[:-2]:
            self._files.remove(f"{self.path}/manifests/{name}")
        for n in self._batches():
            if n <= before["through"]:
                self._files.remove(self._batch(n))
        used = {*manifest["days"].values(), *before["days"].values()}
        for version in self._files.names(f"{self.path}/days"):
            folder = f"{self.path}/days/{version}"
            left = [day for day in self._days(folder) if f"{folder}/{_DAY}={day}" in used]
            for day in set(self._days(folder)) - set(left):
                self._files.remove(f"{folder}/{_DAY}={day}")
            if not left:
                self._files.remove(folder)


_DAY = "stored_day"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder for rows without a time


def with_heartbeat(events: DataFrame, beats: DataFrame, ts: str, weight: str = "weight",
                   keys: Sequence[Mapping[str, object]] = ()) -> DataFrame:
    """Add weightless rows, so that buckets without events still appear with value 0.

    ``beats`` is a stream of (ts) rows, for instance a rate source; the metric over
    the result is ``sum(weight)``. ``keys`` are the keys of the alerts that watch the metric: each
    gets a row of its own a beat.
    """
    counted = events.withColumn(weight, F.lit(1))
    types = {f.name: f.dataType for f in events.schema.fields}
    if keys:
        each = [F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in key.items()]) for key in keys]
        beats = beats.select(F.col(quote(ts)), F.inline(F.array(*each)))
    known = {ts, *(keys[0] if keys else ())}
    missing = [F.col(quote(n)) if n in known else F.lit(None).cast(t).alias(n) for n, t in types.items()]
    return counted.unionByName(beats.select(*missing, F.lit(0).alias(weight)))


def live_metric(events: DataFrame, ts: str, width: int | str, lateness: str,
                measure: str = "count(*)", keys: Sequence[str] = ()) -> DataFrame:
    """A stream of (keys, time_ts, value) for alerting."""
    series = live_series(events, ts, keys, width, lateness, measure, "value")
    return series.select(*[F.col(quote(k)) for k in keys], epoch_seconds("time").alias("time_ts"),
                         F.col("value").cast("double").alias("value"))


def judge_batch(metric: DataFrame, definitions: Sequence[AlertDefinition]) -> DataFrame:
    """Evaluate alerts on the metric rows of one micro-batch.

    A metric with alert ids is matched by id; one without is given to every alert.
    Results carry the time from which the bucket is looked at: its start, or with a
    delay the time at which it is looked up first.
    """
    alerts = definitions_df(metric.sparkSession, definitions)
    if ID[0] in metric.columns:
        joined = bucket_rows(metric).join(alerts, list(ID))
    else:
        each = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(d.row(), alerts.schema.fields)])
                for d in definitions]
        joined = bucket_rows(metric, ["time_ts"]).select("*", F.inline(F.array(*each)))
    seen = F.col("time_ts") + F.col("delay_s")
    return judge(joined).select(*ID, F.timestamp_seconds(seen).cast("timestamp_ntz").alias("timestamp"),
                                "status", "message", "value")


def alert_writer(definitions: Sequence[AlertDefinition], log: AlertLog,
                 hook: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: evaluate, and keep the log equal to the changes of all newest results.

    A running bucket may be judged again in a later batch. Results are therefore stored by alert and
    time, and the days from the first one that a batch touches on are written anew. ``hook`` gets the rows
    that were not in the log before; what it returns replaces them.
    """
    store = RunningTable(log.spark, f"{log.path.rstrip('/')}_results", [*ID, "timestamp"], "timestamp")

    def write(batch: DataFrame, number: int) -> None:
        results = judge_batch(batch, definitions).select(*ID, "timestamp", "status", "message")
        results = results.persist()
        try:
            first = results.agg(F.min(F.to_date("timestamp"))).first()[0]
            if first is None:
                return
            since = first - timedelta(days=1)
            before = checkpointed(changes(store.read(since))) if hook and store.exists() else None
            store.write(results, number)
        finally:
            results.unpersist()
        if hook:
            fresh = changes(store.read(since)).where(F.to_date("timestamp") >= F.lit(first))
            if before is not None:
                fresh = fresh.join(before, [*ID, "timestamp", "status"], "left_anti").select(*fresh.columns)
            store.write(hook(fresh).select(*ID, "timestamp", "status", "message"), number + 0.5)
        kept = changes(store.read(since)).where(F.to_date("timestamp") >= F.lit(first))
        log.rewrite_days(kept)

    return write


class _ChangeState(StatefulProcessor):
    """Remembers the kept results of one alert for a day back, and the last one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._points = handle.getListState("points", T.StructType([
            T.StructField("timestamp", T.TimestampNTZType()), T.StructField("status", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        points = sorted((pd.Timestamp(p[0]), p[1]) for p in self._points.get()) if self._points.exists() else []
        ticks = pd.concat(list(rows)).sort_values("timestamp").reset_index(drop=True)
        reasons = []
        for at, status in zip(ticks["timestamp"], ticks["status"], strict=True):
            # Each result is compared with what was known just before its own time.
            place = bisect_left(points, at, key=lambda p: p[0])
            before = points[place - 1] if place else None
            changed = before is not None and before[1] != status
            if before is None or changed or before[0].date() != at.date():
                reasons.append("change" if changed else "daily")
                points.insert(place, (at, status))
            else:
                reasons.append(None)
        ticks["reason"] = reasons
        oldest = bisect_left(points, points[-1][0] - KEPT_BACK, key=lambda p: p[0])
        self._points.put([(t.to_pydatetime(), s) for t, s in points[max(0, oldest - 1):]])
        kept = ticks[ticks["reason"].notna()]
        if len(kept):
            yield kept[[*ID, "timestamp", "status", "message", "reason"]]

    def close(self) -> None:
        pass


KEPT_BACK = pd.Timedelta(days=2)
CHANGE_SCHEMA = ("alert_id_group string, alert_id_key string, timestamp timestamp_ntz, status string, "
                 "message string, reason string")


def change_feed(results: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Keep a stream's status changes and the first result of each day, per alert.

    State is keyed by alert: the kept results of the last two days, so that a late result is
    compared with the one before its own time. Their number is bounded by the schedule (at
    most one tick a minute), whatever the monitored data looks like. Results later than ``lateness`` are left out.
    """
    rows = results.select(*ID, "timestamp", "status", "message", F.col("timestamp").cast("timestamp").alias("event_time"))
    return rows.withWatermark("event_time", lateness).groupBy(*ID).transformWithStateInPandas(
        statefulProcessor=_ChangeState(), outputStructType=CHANGE_SCHEMA, outputMode="append",
        timeMode="EventTime")


def anonymize_stream(rows: DataFrame, chain: Processor) -> DataFrame:
    """Scrub a stream; stateless, same expressions as in batch."""
    return anonymize(rows, chain)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Start streams with state on local disk (RocksDB), as custom state needs it.

    A query reads this setting when it starts; the session gets its own back.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_available(stream: DataFrame, label: str, mode: str = "append", base: str | None = None,
                  custom_state: bool = False) -> DataFrame:
    """Process everything there is, then return what was written so far.

    Output and progress go to the shared folder; a run with the same ``base``
    continues where the last one ended. ``custom_state`` is needed for change feeds.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, label)
    writer = (stream.writeStream.outputMode(mode).format("parquet")
              .option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress")
              .trigger(availableNow=True))
    with large_state(spark) if custom_state else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, label: str, write: Callable[[DataFrame, int], None], mode: str) -> None:
    """Like :func:`run_available` for ``foreachBatch`` functions (updates included)."""
    base = scratch_path(stream.sparkSession, label)
    writer = (stream.writeStream.outputMode(mode).foreachBatch(write)
              .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True))
    writer.start().awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)



"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

Features of a text are its runs of one and two words, hashed to buckets. Bucket counts of the source and of
the target give each bucket a gain, the logarithm of their smoothed ratio; the weight of a text is the mean
gain of its features. With noise from a Gumbel distribution added, the largest scores are a draw without
replacement in proportion to the weights (the noise of an id is a hash, so a draw can be repeated).

Ranking. Rows stay in the partitions they are in; each is sorted locally and is a run. Runs give samples at regular
distances, the sorted samples give splitters at regular distances, and the splitters cut every run. The sizes of
the cuts add up to how many rows stand before each segment, so segments beyond the draw are known before any
row moves, and stay. The others are exchanged, one partition a segment, where the sorted pieces are merged; a
rank is the count before the segment plus the place in it. Rows are ordered by score, id and then the place
they had when they were read, so no two are equal, and a value that a third of all rows hold is split like any other.

What the driver holds is bounded: one number a bucket, ``SAMPLES`` samples, one number a segment (``SEGMENTS``).

Defined cases: a null text has no words, and a text without features has weight 0; a null id hashes like an empty one
and comes before all others; rows that repeat an id get the same noise and are drawn each for itself; ties go to
the smaller id; an empty table gives no rows, an empty target gives gains from the smoothing alone; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.graph import saved
from bucketwise.llm.ragged import chunks, lowered, text_bytes

SAMPLES = 1 << 20
SEGMENTS = 1024
SLOW_WORD = 256   # bytes above which a checksum is taken for the one word alone
_POSITION = (1 << 33) - 1  # of a row in its partition, in monotonically_increasing_id

# Bytes that are no part of a word, after A-Z have become a-z: all of ASCII but digits and letters.
_INNER = np.ones(256, bool)
_INNER[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of every slice of bytes; ``begin`` holds checksums of what stands before each slice."""
    out = np.zeros(len(starts), np.uint32) if begin is None else begin.copy()
    size = ends - starts
    slow = np.flatnonzero(size > SLOW_WORD)
    for i in slow:
        out[i] = zlib.crc32(data[starts[i]:ends[i]], int(out[i]))
    rows = np.flatnonzero(size <= SLOW_WORD)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    state, at = ~out[rows], starts[rows]
    left = np.searchsorted(-size[rows], -np.arange(1, SLOW_WORD + 1), side="right")  # slices of so many bytes at least
    for j in range(SLOW_WORD):
        n = left[j]
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out[rows] = ~state
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every feature, and the number of words of each text."""
    data = lowered(data)
    inner = _INNER[data]
    begin, end = inner.copy(), inner.copy()
    begin[1:] &= ~inner[:-1]
    end[:-1] &= ~inner[1:]
    cuts = np.unique(offsets)
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # words end with their text
    begin[cuts] = inner[cuts]
    end[cuts - 1] = inner[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    crc = crc_slices(data, starts, ends)
    owners, found = [doc], [crc]
    blank = np.array([0x20], np.uint8)
    for n in range(1, width):
        at = np.flatnonzero(doc[n:] == doc[:-n])  # first words of runs of n + 1
        zero = np.zeros(len(at), np.int64)
        crc = crc.copy()
        crc[at] = crc_slices(data, starts[at + n], ends[at + n], crc_slices(blank, zero, zero + 1, crc[at]))
        owners.append(doc[at])
        found.append(crc[at])
    return np.concatenate(owners), np.concatenate(found).astype(np.int64) % buckets, np.diff(first)


def bucket_counts(docs: DataFrame, width: int = 2, buckets: int = 10_000, text_column: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into it (buckets without any are left out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch):
                total += np.bincount(feature_buckets(*text_bytes(part.column("text")), width, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return (docs.select(docs[text_column].alias("text")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of every bucket, from ``bucket_counts`` of both sides."""
    counts = []
    for side in (source, target):
        n = np.zeros(buckets, np.int64)
        for row in side.collect():  # a number a bucket
            n[row.bucket] = row.n
        counts.append(n)
    s, t = counts
    all_s, all_t = int(s.sum()), int(t.sum())
    ratio = ((t + 1).astype(float) * float(all_s + buckets)) / ((s + 1).astype(float) * float(all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, width: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Number of words and of features of every text, and its weight."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in chunks(batch):
                doc, bucket, n_words = feature_buckets(*text_bytes(part.column("text")), width, buckets)
                n = np.bincount(doc, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, doc, gain[bucket])
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(total // np.maximum(n, 1))], [id_column, "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, docs[text_column].alias("text")).mapInArrow(
        run, f"`{id_column}` {kind}, n_words long, n_features long, weight long")


def gumbel(identity: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel number) that follows from the id and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, score: str, identity: str, drawn: int) -> DataFrame:
    """``rank`` (1, 2, 3, ... by score downwards, then id upwards) of the first ``drawn`` rows, null for all others.

    ``rows`` is a saved table, since it is read several times.
    """
    place, names = "place_" + "_".join(rows.columns), rows.columns
    order = [F.col(score).desc(), F.col(identity).asc_nulls_first(), F.col(place)]
    runs = rows.withColumn(place, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    runs = saved(runs.select(F.struct(*names).alias("row"), F.col(score).alias("s"), F.col(identity).alias("i"), F.col(place).alias("p"),
                             F.shiftright(at, 33).alias("run"), at.bitwiseAND(F.lit(_POSITION)).alias("pos")), "runs")
    sizes = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    n_runs = sizes.count()
    if not n_runs:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    # As many samples a run as there are runs, or as the bound on all samples allows.
    each = max(1, min(max(n_runs, 16), SAMPLES // n_runs))
    regular = F.floor(F.col("pos") * each / F.col("n")) != F.floor((F.col("pos") - 1) * each / F.col("n"))
    samples = runs.join(sizes, "run").where(regular).select("s", "i", "p").collect()
    samples = sorted(_key(r.s, r.i, r.p) for r in samples)
    parts = min(max(n_runs, 2), SEGMENTS)
    splitters = [samples[len(samples) * k // parts] for k in range(1, parts)]
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The splitters cut each piece of a run by binary search."""
        for batch in batches:
            s, i, p, run = (batch.column(c).to_pylist() for c in ("s", "i", "p", "run"))
            segment = np.zeros(batch.num_rows, np.int32)
            ends = [*(np.flatnonzero(np.diff(np.array(run))) + 1).tolist(), batch.num_rows]  # a batch may hold several runs
            begin = 0
            for end in ends:
                lo = begin
                for splitter in shared.value:
                    lo = bisect_left(range(batch.num_rows), splitter, lo, end, key=lambda k: _key(s[k], i[k], p[k]))
                    if lo == end:
                        break
                    segment[lo:end] += 1
                begin = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    table = saved(runs.mapInArrow(cut, _with_segment(runs)), "segments")
    counted = {r.segment: r.n for r in table.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in range(parts):
        before.append(total)
        total += counted.get(k, 0)
    needed = sum(b < drawn for b in before)
    exchanged = (table.where(F.col("segment") < needed).repartitionById(needed, F.col("segment"))
                 .sortWithinPartitions(F.col("s").desc(), F.col("i").asc_nulls_first(), "p")
                 if needed else table.limit(0))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("segment") + 1)
    rank = offset + F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION)) + 1
    front = exchanged.select("row.*", rank.alias("rank"))
    front = front.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return front.unionByName(table.where(F.col("segment") >= needed).select("row.*", F.lit(None).cast("long").alias("rank")))


def _key(score: int, identity: object, place: int) -> tuple:
    return -score, identity is not None, identity if identity is not None else 0, place


def _with_segment(df: DataFrame) -> object:
    return df.withColumn("segment", F.lit(0)).schema


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, width: int = 2, buckets: int = 10_000, least_words: int = 20,
             seed: int = 7, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """Per document its features, weight, score and rank in the draw (null where it isn't drawn).

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn.
    """
    gains = bucket_gains(bucket_counts(docs, width, buckets, text_column), bucket_counts(target, width, buckets, target_column), buckets)
    scored = weighted(docs, gains, width, id_column, text_column)
    scored = saved(scored.withColumn("score", F.col("weight") + gumbel(F.col(id_column), seed)), "scores")
    enough = scored.where(F.col("n_words") >= least_words)
    rows = ranked(enough, "score", id_column, percent * enough.count() // 100)
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return rows.unionByName(others).drop("n_words")

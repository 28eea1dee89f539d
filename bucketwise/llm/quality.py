"""Quality rules with cross-document line frequency.

Rules on a text alone: too few words, or too many words in repeated five-word windows. Then the lines
of all texts are hashed (words in lower case, white space collapsed) and the distinct texts that hold a
line are counted per host. A line is above the limits in more than ``line_share`` of a host's texts, or
in more than ``line_many`` of them however large the host is, but not in fewer than ``line_docs``. It is
removed everywhere but in the host's first document with it, so that its content stays once. A document
with fewer than ``MIN_WORDS`` words or less than ``min_left`` of its words left is rejected.

Exact copies count as one text, so a copied document does not make its own lines frequent. Of a group of
near copies large enough for the limits, the first document keeps the lines; the others keep what is their own.

Defined cases: a null or empty text has no words and fails; a null host is the host ''; rows that repeat
an id get the same decision for the same text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.ragged import (SPACES, Words, chunks, hash_slices, hash_words, mix64, sequence_hashes, text_bytes,
                                   window_hashes, window_starts, words)
from bucketwise.session import scratch_path

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets])


def _salted(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Values that are equal only within one document."""
    return mix64(values ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def repeated_words(h: np.ndarray, first: np.ndarray, n: int = 5) -> np.ndarray:
    """Whether each word lies in a window of n words that its text holds twice or more."""
    edge = np.zeros(len(h) + 1, np.int32)
    at, counts = window_starts(first, n)
    if len(at):
        key = _salted(window_hashes(h, n)[at], np.repeat(np.arange(len(counts)), counts))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge[at[twice]] += 1
        np.subtract.at(edge, at[twice] + n, 1)
    return np.cumsum(edge[:-1]) > 0


def lines_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, first word, number of words and text of every line that has a word."""
    breaks = np.flatnonzero(w.data == 0x0A)
    starts = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(w.data)]
    ends = np.append(starts[1:], len(w.data))
    ends = ends - (w.data[ends - 1] == 0x0A) if len(ends) else ends
    first = np.searchsorted(w.starts, starts)
    count = np.searchsorted(w.starts, ends) - first
    full = count > 0
    doc = np.searchsorted(w.offsets, starts[full], side="right") - 1
    return starts[full], ends[full], first[full], count[full], doc


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            data, offsets = text_bytes(part.column("text"))
            w = words(data, offsets)
            h = hash_words(w)
            start, end, first, count, doc = lines_of(w)
            rows = part.num_rows
            lines = np.bincount(doc, minlength=rows)
            _, at = np.unique(_salted(hash_slices(data, start, end), doc), return_index=True)
            distinct = np.bincount(doc[at], minlength=rows)
            norm = sequence_hashes(hash_words(w, lower=True), first, count)
            key, at, back = np.unique(_salted(norm, doc), return_index=True, return_inverse=True)
            total = np.bincount(back, weights=count, minlength=len(key)).astype(np.int64)
            order = np.argsort(at)
            at, total = at[order], total[order]
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("host"), part.column("text_hash"), pa.array(w.counts, pa.int64()),
                 pa.array(_sums(~SPACES[data] & ((data & 0xC0) != 0x80), offsets)), pa.array(_sums(SYMBOLS[data], offsets)),
                 pa.array((lines - distinct).astype(np.int64)), pa.array(_sums(repeated_words(h, w.first), w.first)),
                 pa.ListArray.from_arrays(bounds, pa.array(norm[at].view(np.int64))),
                 pa.ListArray.from_arrays(bounds, pa.array(total))],
                ["doc", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "lines", "line_words"])


def frequent_lines(described: DataFrame, line_share: float, line_docs: int, line_many: int) -> DataFrame:
    """Lines above the limits: host, line, number of distinct texts and the first document."""
    one = described.groupBy("host", "text_hash").agg(F.min_by("lines", "doc").alias("lines"), F.min("doc").alias("doc"))
    texts = one.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    counted = (one.select("host", "doc", F.explode("lines").alias("line")).groupBy("host", "line")
               .agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first_doc"))
               .where(F.col("docs") >= line_docs))
    above = (F.col("docs") > line_share * F.col("texts")) | (F.col("docs") > line_many)
    return counted.join(texts, "host").where(above).drop("texts")


def quality_rules(docs: DataFrame, line_share: float = 0.01, line_docs: int = 10, line_many: int = 1000,
                  min_left: float = 0.3, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Per document its figures, base_failed, kept, words in removed lines and the hashes of those lines."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_column]
    path = scratch_path(spark, "lines")
    (docs.select(docs[id_column].alias("doc"), F.coalesce(docs[host_column].cast("string"), F.lit("")).alias("host"),
                 F.xxhash64(text_column).alias("text_hash"), docs[text_column].alias("text"))
     .mapInArrow(_describe, f"doc {kind}, host string, text_hash long, {STATS}, lines array<long>, line_words array<long>")
     .write.parquet(path))
    described = spark.read.parquet(path)
    listed = scratch_path(spark, "frequent-lines")
    frequent_lines(described, line_share, line_docs, line_many).write.parquet(listed)
    frequent = spark.read.parquet(listed)  # its size is known now: the session decides how to join it
    gone = (described.select("doc", "host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
            .select("doc", "host", "text_hash", F.col("l.lines").alias("line"), F.col("l.line_words").alias("n"))
            .join(frequent, ["host", "line"])
            .where(~F.col("doc").eqNullSafe(F.col("first_doc")))
            .groupBy("doc", "host", "text_hash").agg(F.collect_set(F.struct("line", "n")).alias("gone"))
            .select(F.col("doc").alias("d"), F.col("host").alias("s"), F.col("text_hash").alias("t"), "gone"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (described.drop("lines", "line_words")
            .join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("host") == F.col("s")) & (F.col("text_hash") == F.col("t")),
                  "left")
            .withColumn("removed_words", F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda n, g: n + g["n"]), F.lit(0)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words")))
            .withColumnRenamed("doc", id_column)
            .select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "removed_words", F.coalesce("gone.line", F.array().cast("array<long>")).alias("removed_lines"),
                    "host", "text_hash"))


def with_rules_applied(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
                       **limits: float) -> DataFrame:
    """The rows of kept documents, without their removed lines."""
    found = quality_rules(docs, id_column=id_column, text_column=text_column, host_column=host_column, **limits)
    kept = (found.where("kept").select(F.col(id_column).alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t"),
                                       "removed_lines").dropDuplicates(["d", "h", "t"]))
    rows = docs.select(F.col(id_column).alias("doc"), F.coalesce(docs[host_column].cast("string"), F.lit("")).alias("host"),
                       F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text"),
                       F.struct(*[c for c in docs.columns if c != text_column]).alias("row"))
    joined = rows.join(kept, F.col("doc").eqNullSafe(F.col("d")) & (F.col("host") == F.col("h")) & (F.col("hash") == F.col("t")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                if not len(part.column("removed_lines").flatten()):
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text")], ["row", "kept_text"])
                    continue
                w = words(*text_bytes(part.column("text")))
                start, end, first, count, doc = lines_of(w)
                norm = sequence_hashes(hash_words(w, lower=True), first, count).view(np.int64)
                lists = part.column("removed_lines")
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                gone = np.isin(_salted(norm.view(np.uint64), doc),
                               _salted(lists.flatten().to_numpy().view(np.uint64), owner))
                step = np.zeros(len(w.data) + 2, np.int64)
                np.add.at(step, start[gone], 1)
                np.subtract.at(step, np.minimum(end[gone] + 1, w.offsets[1:][doc[gone]]), 1)  # with its line break
                mask = np.cumsum(step[:-2]) == 0
                data, ends = w.data[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[w.offsets].tolist()
                text = pa.array([data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), text], ["row", "kept_text"])

    rowed = joined.select("row", "text", "removed_lines")
    cut = rowed.mapInArrow(strip, T.StructType([rowed.schema["row"], T.StructField("kept_text", T.StringType())]))
    return cut.select(*(F.col("kept_text").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns))

"""Removal of passages that repeat: seed and extend over winnowed anchors.

Every window of ``window`` words picks the smallest hash among the ``anchor``-word sequences inside it
(the first of equals): its anchor. Equal windows pick the same anchor at the same place, so documents
meet by joining on anchors. Neighbouring windows with one anchor form a stretch: the anchor extended
both ways as far as it stays the pick.

1. Stretches that are equal as a whole repeat each other; all but the first (smallest document, then
   smallest start) are repeats. Within one chunk of documents this is settled at once, so of a passage
   that very many documents share, one row a chunk is shuffled.
2. The first stretches of an anchor with different extensions are compared window by window.
3. The union of repeated windows is a document's maximal repeats; their words are removed. Windows are
   judged on the texts as they came.

Sequences are compared by 128 bits of hashes. Ids must be whole numbers.

Defined cases: a null text is an empty one; a null id is smaller than any id; of rows with one id, the
order is by a hash of their text, and rows that repeat id and text are one document; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.ragged import (chunks, hash_words, joined_digests, sequence_hashes, spans, text_bytes, window_hashes,
                                   window_starts, words)
from bucketwise.session import scratch_path

ROW = ["a", "b", "doc", "at", "n"]
ROW_TYPE = "a long, b long, doc long, at long, n int"
SETTLED = -1  # sign of n: a repeat that needs no further comparison


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of the ``width`` values from each position on, the first of equals."""
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        later = right < left
        best, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        have += step
    return at


def stretches(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Document, first window (word of the text), number of windows, anchor hash and extension hash of each stretch."""
    starts, counts = window_starts(first, window)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = window_hashes(h, anchor, seed=3)
    pick = first_smallest(grams, window - anchor + 1)[starts]
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    begin = starts[at]
    # A stretch is told by its words and by where its anchor stands in it.
    extension = sequence_hashes(h, begin, n + window - 1, seed=4) + (pick[at] - begin).astype(np.uint64)
    return doc[at], begin - first[doc[at]], n, grams[pick[at]], extension


def settle(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of one chunk; those with an earlier equal one in the chunk are marked as settled and spread."""
    a, b = a.view(np.int64), b.view(np.int64)
    order = np.lexsort((at, doc, b, a))
    again = np.zeros(len(a), bool)
    again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    again[order[1:]] &= (doc[order[1:]] != doc[order[:-1]]) | (at[order[1:]] != at[order[:-1]])
    # Settled rows are dealt by document and place instead of by their frequent anchor.
    a, b = np.where(again, at * 31 + doc, a), np.where(again, 0, b)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, doc, at)] + [
        pa.array(np.where(again, SETTLED * n, n).astype(np.int32))], ROW)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, doc, at): repeats, and (with positive n) the first rows of anchors that extend differently.

    Holds one batch and two rows: the last one seen, and a first row whose anchor has shown one extension so far.
    """
    last, waiting = None, None

    def out(doc, at, n):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(n, pa.int32())], ["doc", "at", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, doc, at, n = (batch.column(i).to_numpy() for i in range(5))
        done = n < 0
        yield out(doc[done], at[done], n[done])
        a, b, doc, at, n = (x[~done] for x in (a, b, doc, at, n))
        if not len(a):
            continue
        new_a, new_b, new_row = (np.ones(len(a), bool) for _ in range(3))
        new_a[1:] = a[1:] != a[:-1]
        new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
        new_row[1:] = new_b[1:] | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        if last is not None:
            new_a[0] = a[0] != last[0]
            new_b[0] = new_a[0] or b[0] != last[1]
            new_row[0] = new_b[0] or (doc[0], at[0]) != last[2:]
        # A row equal to the first row of its group in everything is the same row once more.
        repeat = ~new_b & new_row
        yield out(doc[repeat], at[repeat], -n[repeat])
        group = np.cumsum(new_a) - 1 if new_a[0] else np.cumsum(new_a)
        kinds = np.bincount(group, weights=new_b, minlength=int(group[-1]) + 1).astype(np.int64)
        if not new_a[0]:  # group 0 goes on from the batch before: one extension is known, and waits if it was the only one
            kinds[0] += 1 + (waiting is None)
        several = new_b & (kinds[group] > 1)
        if waiting is not None and not new_a[0] and kinds[0] > 1:
            yield out(*(np.array([v]) for v in waiting))
        if waiting is not None and (new_a[0] or kinds[0] > 1 or group[-1] > 0):
            waiting = None
        yield out(doc[several], at[several], n[several])
        if kinds[group[-1]] == 1 and waiting is None:
            i = int(np.flatnonzero(new_b)[-1])
            waiting = (doc[i], at[i], n[i])
        last = (a[-1], b[-1], doc[-1], at[-1])


def _sorted_rows(rows: DataFrame) -> DataFrame:
    return rows.repartition("a").sortWithinPartitions("a", "b", "doc", "at")


def with_nodes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows as: doc (a null id is the smallest number), tag (tells rows with one id apart), text, whether it is one,
    and the other columns as ``row``, so that a text travels once."""
    ids = docs.select(F.col(id_column).cast("long").alias("doc"))
    repeated = not ids.groupBy("doc").count().where("count > 1").isEmpty()
    tag = F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).bitwiseAND(0x7FFFFFFF) if repeated else F.lit(0)
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-2**63)).alias("doc"),
                       tag.cast("long").alias("tag"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
                       F.col(text_column).isNotNull().alias("given"),
                       F.struct(*[c for c in docs.columns if c != text_column]).alias("row"))


def _parts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in chunks(batch):
            w = words(*text_bytes(part.column("text")))
            yield part, w, part.column("doc").to_numpy(), part.column("tag").to_numpy() << 32


def find_repeats(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc, tag and the repeated windows of each document that has some: first window and number, in a list."""
    spark = docs.sparkSession

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, doc, tag in _parts(batches):
            own, start, n, a, b = stretches(hash_words(w), w.first, window, anchor)
            yield settle(a, b, doc[own], tag[own] + start, n)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, doc, tag in _parts(batches):
            lists = part.column("spans")
            own = np.repeat(np.arange(len(doc)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, n = (flat.field(i).to_numpy() for i in range(2))
            own, start = np.repeat(own, n), np.repeat(start, n) + spans(n)
            h = hash_words(w)
            a, b = (window_hashes(h, window, seed)[w.first[own] + start] if len(own) else np.zeros(0, np.uint64)
                    for seed in (5, 6))
            yield settle(a, b, doc[own], tag[own] + start, np.ones(len(own), np.int64))

    def listed(rows: DataFrame) -> DataFrame:
        return (rows.select("doc", F.shiftright("at", 32).alias("tag"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("start"),
                            F.abs("n").cast("long").alias("n"))
                .groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans")))

    path = scratch_path(spark, "stretches")
    (_sorted_rows(docs.mapInArrow(seeds, ROW_TYPE)).mapInArrow(_compare, "doc long, at long, n int").write.parquet(path))
    settled = spark.read.parquet(path)
    open_rows = listed(settled.where("n > 0"))
    path = scratch_path(spark, "windows")
    (_sorted_rows(docs.join(open_rows, ["doc", "tag"]).mapInArrow(windows, ROW_TYPE))
     .mapInArrow(_compare, "doc long, at long, n int").where("n < 0").write.parquet(path))
    return listed(settled.where("n < 0").unionByName(spark.read.parquet(path)))


def _cut(docs: DataFrame, window: int, anchor: int | None, text_column: str, id_column: str, texts: bool) -> DataFrame:
    anchor = anchor or max(1, window * 2 // 5)
    keyed = with_nodes(docs, id_column, text_column)
    repeats = find_repeats(keyed.select("doc", "tag", "text"), window, anchor)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, _, _ in _parts(batches):
            lists = part.column("spans")
            sizes = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))).astype(np.int64)
            flat = lists.flatten()
            own = np.repeat(np.arange(part.num_rows), sizes)
            start, n = (flat.field(i).to_numpy() for i in range(2))
            at = w.first[own] + start
            edge = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + n + window - 1, 1)
            keep = np.cumsum(edge[:-1]) == 0
            removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[w.first])
            if not texts:
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(joined_digests(w, keep), pa.string())], ["doc", "n_words", "n_removed", "kept_sha256"])
                continue
            gap = np.append(w.starts[1:], len(w.data))  # a removed word goes with the white space after it
            gap = np.minimum(gap, w.offsets[1:][w.doc])
            step = np.zeros(len(w.data) + 1, np.int64)
            np.add.at(step, w.starts[~keep], 1)
            np.subtract.at(step, gap[~keep], 1)
            mask = np.cumsum(step[:-1]) == 0
            data, ends = w.data[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[w.offsets].tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("given"),
                 pa.array([data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)], pa.string())],
                ["row", "given", "kept_text"])

    if not texts:
        return (keyed.drop("row", "given").join(repeats, ["doc", "tag"], "left")
                .mapInArrow(cut, "doc long, n_words long, n_removed long, kept_sha256 string"))
    schema = T.StructType([keyed.schema["row"], keyed.schema["given"], T.StructField("kept_text", T.StringType())])
    return keyed.join(repeats, ["doc", "tag"], "left").mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int | None = None, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """Per document: words, removed words and the digest of the kept words joined by blanks."""
    kind = dict(docs.dtypes)[id_column]
    return _cut(docs, window, anchor, text_column, id_column, False).select(
        F.when(F.col("doc") != -2**63, F.col("doc")).cast(kind).alias(id_column), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = 20, anchor: int | None = None, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated words taken out of their texts; other white space stays as it was."""
    changed = _cut(docs, window, anchor, text_column, id_column, True)
    return changed.select(*(F.when(F.col("given"), F.col("kept_text")).alias(c) if c == text_column else F.col("row")[c].alias(c)
                            for c in docs.columns))

"""Language model scores by Katz backoff over words and word pairs.

Counts are discounted by Good-Turing for counts up to ``TOP``. The model knows pairs counted ``least_pairs`` times or more;
with 1 it is whole, with 2 pairs seen once are left to the backoff. Every history's backoff weight is the mass its pairs leave over, divided by the
word mass of what it has not seen, so that the probabilities after every history sum to one. Words that
training has not seen are one class with the mass that the word counts leave over. A score is the sum of
log10 probabilities: of a pair where it is known, else the history's weight times the probability of the word.

How it runs. Documents are read once. Each block of texts becomes sorted ragged arrays: history, next word, and the
documents that hold the pair, cut by a hash of the history into buckets. This table is written
bucketed, so counting and scoring both read a bucket as it lies, without a shuffle. Pairs are never shuffled: scoring
counts those of its bucket again. What a bucket can't know are the counts of its next words; it asks the buckets where
those are histories, with one sorted list for each, and gets a list of counts. A token's log probability splits into a term of its word and
history and, for known pairs, a correction; buckets return sums per document of a block, which are added up by block.
A frequent pair costs one number for each place it stands in and one row a bucket.

Words are told apart by 64-bit hashes (equal for different words only by chance, never for those of one length up to eight
bytes).

Defined cases: a null or empty text is the end token alone; null ids are scored and not learnt from; rows that
repeat are learnt from and scored each for itself; without a training text every token is unknown; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.graph import saved
from bucketwise.llm.ragged import chunks, hash_words, mix64, text_bytes, words
from bucketwise.session import scratch_path

TOP = 5                    # counts above are taken as they are
BLOCK_TOKENS = 1_000_000   # tokens that are sorted together
BUCKETS, BUCKET_BYTES = 96, 10 << 20
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x9AE16A3B2F90404F)
TINY = 1e-9


@dataclass
class Model:
    """What every bucket needs to know: totals and discounts."""

    tokens: int            # N
    distinct: int          # V
    ends: int              # count of the end token, and of the start as a history
    words: np.ndarray      # factor for word counts 0..TOP
    pairs: np.ndarray      # factor for pair counts 0..TOP
    shrink: float          # factor for all words, where discounting leaves nothing
    unknown: float         # mass of unknown words

    def word_mass(self, count: np.ndarray) -> np.ndarray:
        seen = self.shrink * self.words[np.minimum(count, TOP + 1)] * count / max(self.tokens, 1)
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def discounts(n: dict[int, int], lowest: int) -> np.ndarray:
    """Katz's factors for counts 0..TOP + 1 from the counts of counts; 1 where those give no factor in (0, 1]."""
    out = np.ones(TOP + 2)
    if n.get(1):
        common = (TOP + 1) * n.get(TOP + 1, 0) / n[1]
        for r in range(lowest, TOP + 1):
            if n.get(r) and n.get(r + 1) and common < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                out[r] = d if 0 < d <= 1 else 1.0
    return out


def make_model(word_counts: dict[int, int], pair_counts: dict[int, int], tokens: int, distinct: int, ends: int,
               least_pairs: int = 1) -> Model:
    words_d, pairs_d = discounts(word_counts, 1), discounts(pair_counts, least_pairs)
    lost = sum((1 - words_d[r]) * r * word_counts.get(r, 0) for r in range(1, TOP + 1))
    unknown = lost / tokens if tokens else 1.0
    shrink = 1.0
    if unknown < TINY:
        shrink, unknown = tokens / (tokens + 1), 1 / (tokens + 1)
    return Model(tokens, distinct, ends, words_d, pairs_d, shrink, unknown)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False)


GRAMS = ("block long, bucket int, docs int, ids array<long>, held array<boolean>, tokens array<int>, hs array<long>, hn array<int>, "
         "ws array<long>, wn array<int>, tn array<int>, doc array<int>")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _grams(buckets: int):
    def block_rows(number: int, ids: list, held: np.ndarray, learnt: np.ndarray, tokens: np.ndarray, hist: np.ndarray,
                   word: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.argsort((hist & np.uint64(0xFFFFFFFF00000000)) | (word >> np.uint64(32)))
        hist, word, doc = hist[order], word[order], doc[order]
        del order
        new = np.ones(len(hist), bool)
        new[1:] = (hist[1:] != hist[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        wn = np.diff(np.append(at, len(hist)))
        tn = np.add.reduceat(learnt[doc].astype(np.int32), at)
        h, ws = hist[at], word[at]
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        h_at = np.flatnonzero(new_h)
        hs, hn = h[h_at], np.diff(np.append(h_at, len(h)))
        bucket = _bucket(hs, buckets)
        some = np.unique(bucket)
        h_ends = np.searchsorted(bucket, some, side="right")
        w_ends = np.cumsum(hn)[h_ends - 1]
        d_ends = np.cumsum(wn)[w_ends - 1]
        nothing = np.zeros(len(some) + 1, np.int64)
        # The last row has the documents of the block; the others have a bucket each.
        add = lambda ends: np.append(ends, ends[-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some) + 1, number)), pa.array(np.append(some, number % buckets), pa.int32()),
             pa.array(np.full(len(some) + 1, len(ids)), pa.int32()),
             pa.ListArray.from_arrays(pa.array(np.append(nothing, len(ids)), pa.int32()), pa.array(ids, pa.int64())),
             _lists(held, np.append(nothing[:-1], len(held)), pa.bool_()),
             _lists(tokens, np.append(nothing[:-1], len(tokens)), pa.int32()),
             _lists(hs.view(np.int64), add(h_ends), pa.int64()), _lists(hn, add(h_ends), pa.int32()),
             _lists(ws.view(np.int64), add(w_ends), pa.int64()), _lists(wn, add(w_ends), pa.int32()),
             _lists(tn, add(w_ends), pa.int32()), _lists(doc, add(d_ends), pa.int32())],
            ["block", "bucket", "docs", "ids", "held", "tokens", "hs", "hn", "ws", "wn", "tn", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        parts, size, docs = [], 0, 0
        for batch in batches:
            for part in chunks(batch):
                w = words(*text_bytes(part.column("text")))
                h, n = hash_words(w, lower=True), w.counts + 1
                ends = np.cumsum(n)
                hist, word = (np.empty(len(h) + len(n), np.uint64) for _ in range(2))
                inner = np.ones(len(hist), bool)
                inner[ends - n] = False
                hist[inner], hist[ends - n] = h, START
                inner[ends - n], inner[ends - 1] = True, False
                word[inner], word[ends - 1] = h, END
                parts.append((part.column("id").to_pylist(), part.column("held").to_numpy(zero_copy_only=False),
                              part.column("learnt").to_numpy(zero_copy_only=False), n, hist, word,
                              np.repeat(np.arange(len(n), dtype=np.int32) + np.int32(docs), n)))
                size += len(hist)
                docs += len(n)
                if size >= BLOCK_TOKENS:
                    ids, *columns = zip(*parts, strict=True)
                    parts.clear()
                    yield block_rows(number, [i for p in ids for i in p], *(np.concatenate(c) for c in columns))
                    size, docs, number = 0, 0, number + 1
                    del ids, columns
                    pa.default_memory_pool().release_unused()
        if parts:
            ids, *columns = zip(*parts, strict=True)
            yield block_rows(number, [i for p in ids for i in p], *(np.concatenate(c) for c in columns))

    return run


def _pairs(table: pa.Table, least: int) -> tuple[np.ndarray, ...]:
    """Of one bucket: histories and their training counts; history, word and count of the model's pairs; how many pairs have count r."""
    n = _flat(table.column("tn"))
    seen = n > 0
    hist = np.repeat(_flat(table.column("hs")), _flat(table.column("hn")))[seen].view(np.uint64)
    word, n = _flat(table.column("ws"))[seen].view(np.uint64), n[seen]
    order = np.lexsort((word, hist))
    hist, word, n = hist[order], word[order], n[order]
    del order, seen
    new = np.ones(len(hist), bool)
    new[1:] = (hist[1:] != hist[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    hist, word = hist[at], word[at]
    n = np.add.reduceat(n, at, dtype=np.int64) if len(at) else n.astype(np.int64)
    new_h = np.ones(len(hist), bool)
    new_h[1:] = hist[1:] != hist[:-1]
    h_at = np.flatnonzero(new_h)
    total = np.add.reduceat(n, h_at) if len(h_at) else n
    r = np.bincount(np.minimum(n, TOP + 2), minlength=TOP + 3)[1:TOP + 2]
    hs = hist[h_at]
    if least > 1:
        known = n >= least
        hist, word, n = hist[known], word[known], n[known]
    return hs, total, hist, word, n, r


COUNTS = "bucket int, part int, ws array<long>, cs array<long>, stats array<long>"


def _count(buckets: int, least: int):
    """Of one bucket: in part -1 its histories, their counts, and figures of all; in other parts the words whose counts it needs."""
    def run(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the bucket before
        hs, total, _, word, _, r = _pairs(table, least)
        asked, start = np.unique(word), hs == START
        part = _bucket(asked, buckets)
        some = np.unique(part)
        ends = np.searchsorted(part, some, side="right")
        of_words = np.bincount(np.minimum(total[~start], TOP + 2), minlength=TOP + 3)[1:TOP + 2]
        stats = np.array([*r, *of_words, total.sum(), len(hs), total[start].sum()], np.int64)
        last = lambda n: np.append(np.zeros(len(some), np.int64), n)
        return pa.table({"bucket": pa.array(np.full(len(some) + 1, table.column("bucket")[0].as_py()), pa.int32()),
                         "part": pa.array(np.append(some, -1), pa.int32()),
                         "ws": _lists(np.concatenate([asked, hs]).view(np.int64), np.append(ends, len(asked) + len(hs)), pa.int64()),
                         "cs": _lists(total, last(len(total)), pa.int64()), "stats": _lists(stats, last(len(stats)), pa.int64())})

    return run


def _answer(asked: pa.Table, own: pa.Table) -> pa.Table:
    """Counts of the words that buckets ask for, in their order; 0 for the end token, which is no history."""
    if not asked.num_rows:  # a side without rows has no columns either
        return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "cs": pa.array([], pa.list_(pa.int64()))})
    wanted = _flat(asked.column("ws")).view(np.uint64)
    counts = np.zeros(len(wanted), np.int64)
    if own.num_rows:
        at, known = _found(_flat(own.column("hs")).view(np.uint64), wanted)
        counts[known] = _flat(own.column("hc"))[at[known]]
    ends = np.cumsum([len(x) for x in asked.column("ws")], dtype=np.int64)
    return pa.table({"bucket": asked.column("bucket"), "part": asked.column("part"), "cs": _lists(counts, ends, pa.int64())})


def _pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))))


def _found(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values


def word_and_pair_terms(model: Model, hist, count, th, tw, tc, tcw):
    """Of the model of a bucket: histories with count and weight (log10), pairs with key and correction."""
    at, _ = _found(hist, th)
    mass = model.pairs[np.minimum(tc, TOP + 1)] * tc / count[at] if len(th) else np.zeros(0)
    word = model.word_mass(tcw)
    used = np.bincount(at, weights=mass, minlength=len(hist)) if len(th) else np.zeros(len(hist))
    covered = np.bincount(at, weights=word, minlength=len(hist)) if len(th) else np.zeros(len(hist))
    # Where discounting leaves nothing for the unseen, one more count is set aside for it.
    shrink = np.where(1 - used < TINY, count / (count + 1), 1.0)
    weight = np.log10((1 - shrink * used) / (1 - covered))
    correction = np.log10(shrink[at] * mass) - weight[at] - np.log10(word) if len(th) else np.zeros(0)
    key = _pair_key(th, tw)
    order = np.argsort(key)
    return hist, count, weight, key[order], th[order], tw[order], correction[order]


def _score(model: Model, least: int):
    def run(grams: pa.Table, answers: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the bucket before
        hs, total, th, tw, tc, _ = _pairs(grams, least)
        asked, back = np.unique(tw, return_inverse=True)
        cw = np.zeros(0, np.int64)
        if answers.num_rows:  # a side without rows has no columns either
            cw = _flat(answers.take(np.argsort(answers.column("part").to_numpy())).column("cs")).copy()
        cw[asked == END] = model.ends
        hist, count, weight, key, th, tw, correction = word_and_pair_terms(model, hs, total, th, tw, tc, cw[back])
        del hs, total, tc, asked, back, cw
        out = []
        for i in range(grams.num_rows):  # blocks
            hs, hn, ws, wn, doc = (grams.column(x)[i].values.to_numpy() for x in ("hs", "hn", "ws", "wn", "doc"))
            hs, ws = hs.view(np.uint64), ws.view(np.uint64)
            at, known = _found(hist, hs)
            c = np.where(known, count[at], 0) if len(hist) else np.zeros(len(hs), np.int64)
            term = np.log10(model.word_mass(c)) + (np.where(known, weight[at], 0.0) if len(hist) else 0.0)
            base, known = model.base(c), c > 0
            begin = hs == START  # a history only, no token
            if begin.any():
                term[begin] -= np.log10(model.word_mass(c[begin]))
                base[begin], known[begin] = 0.0, False
            full = np.repeat(hs, hn)
            at, hit = _found(key, _pair_key(full, ws))
            value = np.repeat(term, hn)
            if len(key):
                hit &= (th[at] == full) & (tw[at] == ws)
                value[hit] += correction[at[hit]]
            n = grams.column("docs")[i].as_py()
            out.append([np.bincount(doc, weights=np.repeat(v, wn), minlength=n)
                        for v in (value, np.repeat(base, hn), np.repeat(known, hn))])
        ends = np.cumsum([len(o[0]) for o in out], dtype=np.int64)
        score, base, known = (np.concatenate(x) if out else np.zeros(0) for x in (list(zip(*out, strict=True)) or [[]] * 3))
        # Partial sums of a bucket are small, so four bytes keep them to far more digits than the sum needs.
        return pa.table({"block": grams.column("block"), "score": _lists(score, ends, pa.float32()),
                         "base": _lists(base, ends, pa.float64()), "known": _lists(known.astype(np.int64), ends, pa.int32())})

    return run


def _add_up(model: Model):
    def run(docs: pa.Table, parts: pa.Table) -> pa.Table:
        ids = docs.column("ids").combine_chunks().flatten()
        n = len(ids)
        score, base, known = (_flat(parts.column(x)).reshape(-1, n).sum(0, dtype=np.float64) for x in ("score", "base", "known"))
        end = np.array([model.ends])
        score += np.log10(model.word_mass(end))
        base += model.base(end)
        known += model.ends > 0
        return pa.table({"id": ids, "held_out": docs.column("held").combine_chunks().flatten(),
                         "n_tokens": pa.array(_flat(docs.column("tokens")), pa.int64()),
                         "n_known": pa.array(known.astype(np.int64)), "train_tokens": np.full(n, model.tokens),
                         "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, id_column: str = "doc_id",
                text_column: str = "text", least_pairs: int = 1) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(id as text) modulo ``folds`` is not the held-out one.

    ``least_pairs`` is the count from which the model knows a pair; all are known unless a caller asks for less.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_column]
    size = docs.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    buckets = max(BUCKETS, -(-int(size) // BUCKET_BYTES))
    fold = F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds)) == held_out_fold
    name = f"word_pairs_{uuid.uuid4().hex}"
    (docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(fold, F.lit(False)).alias("held"),
                 F.coalesce(~fold, F.lit(False)).alias("learnt"), F.col(text_column).alias("text"))
     .mapInArrow(_grams(buckets), GRAMS)
     .write.option("compression", "zstd").bucketBy(buckets, "bucket").option("path", scratch_path(spark, "word-pairs")).saveAsTable(name))
    grams = spark.table(name)
    listed = grams.where(F.size("ids") == 0)
    counts = saved(listed.select("bucket", "hs", "hn", "ws", "tn").groupBy("bucket")
                   .applyInArrow(_count(buckets, least_pairs), COUNTS), "counts")
    own = counts.where("part = -1")
    figures = dict.fromkeys(range(2 * TOP + 5), 0)
    figures |= {r[0]: r[1] for r in own.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.sum("v")).collect()}
    of_pairs, of_words = ({r: figures[first + r - 1] for r in range(1, TOP + 2)} for first in (0, TOP + 1))
    total, distinct, ends = (figures[2 * TOP + k] for k in (2, 3, 4))  # the start is the history of as many tokens as there are ends
    if 0 < ends <= TOP + 1:
        of_words[ends] += 1
    model = make_model(of_words, of_pairs, total, distinct, ends, least_pairs)
    answers = (counts.where("part >= 0").select("bucket", "part", "ws").groupBy("part")
               .cogroup(own.select(F.col("bucket").alias("of"), F.col("ws").alias("hs"), F.col("cs").alias("hc")).groupBy("of"))
               .applyInArrow(_answer, "bucket int, part int, cs array<long>"))
    parts = (listed.select("bucket", "block", "docs", "hs", "hn", "ws", "wn", "tn", "doc").groupBy("bucket")
             .cogroup(answers.groupBy("bucket"))
             .applyInArrow(_score(model, least_pairs), "block long, score array<float>, base array<double>, known array<int>"))
    blocks = grams.where(F.size("ids") > 0).select("block", "ids", "held", "tokens")
    scored = blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(
        _add_up(model), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = saved(scored, "scores")
    spark.sql(f"DROP TABLE {name}")
    return out.select(F.col("id").cast(kind).alias(id_column), "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                      "score")

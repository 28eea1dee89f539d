"""Toxicity by non-negative positive-unlabelled learning.

The training set is confirmed toxic texts and unlabelled text; the only other thing taken from labels is the share of
toxic rows (the class prior). A text is the set of its words in lower case and of their beginnings (4, 5 and 6 bytes), hashed.
Features are kept that occur in toxic texts markedly more often than in unlabelled ones. Linear
classifiers over them minimise the risk  prior * R(toxic as toxic) + max(0, R(unlabelled as clean) -
prior * R(toxic as clean)): the toxic part of the unlabelled text is taken out of its risk, and when that
difference turns negative, the step goes the other way, so that the model can't gain by overfitting it.
Several classifiers, each on its own order of the batches, are averaged. The limit between
clean and toxic is where the same corrected risk, counted in wrong decisions, is least; the score there is
``PASS_SCORE``.

Training uses a bounded sample of rows (``MAX_TOXIC`` and ``MAX_UNLABELLED`` whole texts, chosen by a hash of
their id); every text is scored whole.

Defined cases: a null or empty text has no feature and gets the score of the intercept; without a toxic
row to learn from, the score is the prior everywhere; null ids are scored and never learnt from; rows that repeat are scored
each for itself; labels with null are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.ragged import Words, chunks, hash_slices, lowered, text_bytes, words

MAX_TOXIC, MAX_UNLABELLED = 3000, 9000
MAX_FEATURES = 4096
BEGINNINGS = (4, 5, 6)
LIFT = 5.0
MIN_TEXTS, MIN_SHARE = 3, 0.012  # toxic texts that a feature must be in: number, and share of them
PASS_SCORE = 0.7     # the score at the decision limit
CLASSIFIERS = 3
HELD_OUT = 1  # crc32 of the id as text, modulo 3


def features(w: Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings."""
    data = lowered(w.data)
    return [hash_slices(data, w.starts, w.ends, 20)] + [
        hash_slices(data, w.starts, np.minimum(w.ends, w.starts + n), 20 + n) for n in BEGINNINGS]


def feature_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of every text one after the other, and their number."""
    doc = np.tile(w.doc, 1 + len(BEGINNINGS))
    value = np.concatenate(features(w))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(w.first) - 1)


def select_features(toxic: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Sorted features whose share in toxic texts is at least LIFT times that in unlabelled ones."""
    if not toxic:
        return np.zeros(0, np.uint64)
    kinds, inside = np.unique(np.concatenate(toxic), return_counts=True)
    often = inside >= max(MIN_TEXTS, MIN_SHARE * len(toxic))
    kinds, inside = kinds[often], inside[often]
    outside = np.zeros(len(kinds))
    for features_of in unlabelled:
        if len(kinds):
            at = np.minimum(np.searchsorted(kinds, features_of), len(kinds) - 1)
            outside[at[kinds[at] == features_of]] += 1
    lift = ((inside + 0.5) / (len(toxic) + 1)) / ((outside + 0.5) / (len(unlabelled) + 1))
    good = np.flatnonzero(lift >= LIFT)
    if len(good) > MAX_FEATURES:
        gain = inside[good] * np.log(lift[good])
        good = np.sort(good[np.argsort(-gain, kind="stable")[:MAX_FEATURES]])
    return kinds[good]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def decision_limit(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Middle of the values at which the same corrected risk, of wrong decisions, is as small as it gets."""
    at = np.linspace(min(toxic.min(), unlabelled.min()), max(toxic.max(), unlabelled.max()), 1001)
    missed = np.searchsorted(np.sort(toxic), at) / len(toxic)
    accused = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    risk = prior * missed + np.maximum(0, accused - prior * (1 - missed))
    best = at[risk <= risk.min() + 0.005 * prior]
    return float(best.mean())


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, batch: int = 1024,
          rate: float = 0.1, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept features, the weights and the intercept of each classifier."""
    kept = select_features(toxic, unlabelled)
    prior = min(max(prior, 1e-3), 0.999)
    start = np.log(prior / (1 - prior))
    if not len(kept) or not unlabelled:
        return kept, np.zeros((1, len(kept))), np.array([start])

    def known(rows: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for row in rows:
            at = np.minimum(np.searchsorted(kept, row), len(kept) - 1)
            out.append(at[kept[at] == row])
        return out

    toxic, unlabelled = known(toxic), known(unlabelled)
    weights, intercepts = np.zeros((CLASSIFIERS, len(kept))), np.zeros(CLASSIFIERS)
    for c in range(CLASSIFIERS):
        random = np.random.default_rng(c)
        theta = np.append(np.zeros(len(kept)), start)
        first, second = np.zeros_like(theta), np.zeros_like(theta)

        def slope(rows: list[np.ndarray], sign: float) -> tuple[float, np.ndarray]:
            """Mean of log(1 + exp(-sign * f)) over the rows, and its slope."""
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(rows)), size)
            f = np.bincount(owner, weights=theta[flat], minlength=len(rows)) + theta[-1]  # noqa: B023
            d = -sign * _sigmoid(-sign * f) / len(rows)
            out = np.bincount(flat, weights=d[owner], minlength=len(theta))  # noqa: B023
            out[-1] = d.sum()
            return float(np.logaddexp(0, -sign * f).mean()), out

        for step in range(1, steps + 1):
            p = [toxic[i] for i in random.integers(len(toxic), size=min(batch, 2 * len(toxic)))]
            u = [unlabelled[i] for i in random.integers(len(unlabelled), size=min(batch, 2 * len(unlabelled)))]
            _, as_toxic = slope(p, 1.0)
            risk_p, as_clean = slope(p, -1.0)
            risk_u, all_clean = slope(u, -1.0)
            rest = all_clean - prior * as_clean
            grad = prior * as_toxic + rest if risk_u >= prior * risk_p else -rest
            grad[:-1] += shrink * theta[:-1]
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            np.maximum(theta[:-1], 0, out=theta[:-1])  # kept features speak for toxic text, none against it
        weights[c], intercepts[c] = theta[:-1], theta[-1]

    def mean_value(rows: list[np.ndarray]) -> np.ndarray:
        return np.array([weights[:, row].sum(1) + intercepts for row in rows]).mean(1)

    limit = decision_limit(mean_value(toxic), mean_value(unlabelled), prior)
    shift = np.log(PASS_SCORE / (1 - PASS_SCORE))
    return kept, 2 * weights, 2 * (intercepts - limit) + shift


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model, from rows outside the held-out fold."""
    def learnt(frame: DataFrame) -> DataFrame:
        return frame.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != HELD_OUT)

    def sets(frame: DataFrame) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    value, count = feature_sets(words(*text_bytes(part.column("text"))))
                    ends = np.concatenate([[0], np.cumsum(count)]).tolist()
                    raw = value.astype("<u8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([raw[8 * a:8 * b] for a, b in zip(ends, ends[1:], strict=False)],
                                                               pa.binary())], ["features"])

        rows = frame.select("text").mapInArrow(run, "features binary").toLocalIterator(prefetchPartitions=True)
        return [np.frombuffer(r[0], "<u8") for r in rows]

    order = F.xxhash64("doc_id"), F.col("doc_id")
    marked = learnt(labels.select("doc_id", F.col("toxic").cast("double").alias("toxic"))).where("toxic is not null")
    prior = marked.agg(F.avg("toxic")).first()[0]
    chosen = marked.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(MAX_TOXIC)
    texts = docs.select("doc_id", "text")
    toxic = sets(texts.join(F.broadcast(chosen), "doc_id", "left_semi"))  # at most MAX_TOXIC ids
    some = learnt(texts.select("doc_id")).orderBy(*order).limit(MAX_UNLABELLED)
    unlabelled = sets(texts.join(F.broadcast(some), "doc_id", "left_semi"))  # at most MAX_UNLABELLED ids
    return train(toxic, unlabelled, prior if prior is not None else 0.0)


def with_scores(docs: DataFrame, labels: DataFrame, score_column: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) with one more column, the score."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weights, intercepts = model.value
        maybe = np.zeros(1 << 16, bool)
        maybe[kept >> np.uint64(48)] = True
        for batch in batches:
            for part in chunks(batch):
                w = words(*text_bytes(part.column("text")))
                own, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                doc = w.doc
                for value in features(w) if len(kept) else []:
                    hit = np.flatnonzero(maybe[value >> np.uint64(48)])
                    place = np.minimum(np.searchsorted(kept, value[hit]), len(kept) - 1)
                    good = kept[place] == value[hit]
                    own.append(doc[hit[good]])
                    at.append(place[good])
                pair = np.unique(np.concatenate(own) * (len(kept) + 1) + np.concatenate(at))
                own, at = np.divmod(pair, len(kept) + 1)
                value = np.bincount(own, weights=weights.mean(0)[at], minlength=part.num_rows) + intercepts.mean()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_sigmoid(value))], [*part.schema.names, score_column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = PASS_SCORE, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    scored = with_scores(rows, labels, "score")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == HELD_OUT
    return scored.select(F.col("doc_id").alias(id_column), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

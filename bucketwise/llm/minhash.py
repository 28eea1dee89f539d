"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its word shingles. The sketch has one coordinate a bin: in round i every
shingle is thrown into a random bin with a value of i and a random fraction, and a bin keeps its smallest
value; when bins are still empty after as many rounds as there are bins, round i puts every shingle
into bin i. So every coordinate of a set with a shingle is filled, and the share of equal coordinates of two
sketches is concentrated around the similarity of the sets.

Bands of coordinates are bucket keys. Documents with one set are one class, of which the smallest takes
part. In each bucket the members are compared with its smallest on their full sets, which joins most groups at a
cost in proportion to their size. Buckets that still hold several components, joined where they share members,
are compared in blocks: a task gets the sets of two parts and counts all intersections at once as a product
of incidence matrices. It returns a spanning forest of what is linked, never pairs.

The number of coordinates in a band follows from the threshold: as many as leave a pair at the threshold a
chance of less than ``MISS`` to share no band.

Defined cases: a null or empty text has an empty set and links with nothing; rows with one id and
different texts are documents of their own (ordered by a hash of the text), rows that repeat both are
one; a null id comes before all others; ids are whole numbers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.embeddings import forest
from bucketwise.llm.graph import components, saved
from bucketwise.llm.groups import whole_groups
from bucketwise.llm.passages import with_nodes
from bucketwise.llm.ragged import (chunks, hash_words, mix64, odd_constants, sequence_hashes, spans, text_bytes, window_hashes,
                                   window_starts, words)

BINS = 128
MISS = 1e-6
GROUP_ROWS = 256         # members that are compared with one copy of their first
PART_SETS, PART_SHINGLES = 512, 300_000  # of one part of a block
SLAB = 4096              # columns of an incidence matrix


def band_size(threshold: float) -> int:
    return max(r for r in range(1, BINS + 1) if r == 1 or (1 - threshold ** r) ** (BINS // r) <= MISS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text one after the other, and the number of each text."""
    w = words(data, offsets)
    h = hash_words(w, lower=True)
    at, n = window_starts(w.first, width)
    few = (w.counts > 0) & (w.counts < width)
    doc = np.concatenate([np.repeat(np.arange(len(n)), n), np.flatnonzero(few)])
    shingle = np.concatenate([window_hashes(h, width, seed=11)[at] if len(at) else np.zeros(0, np.uint64),
                              sequence_hashes(h, w.first[:-1][few], w.counts[few], seed=12)])
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.bincount(doc[new], minlength=len(n))


def sketches(shingles: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values for every set; rows of empty sets hold the largest value."""
    empty = np.uint64(2**64 - 1)
    out = np.full(len(counts) * bins, empty, np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    constants = odd_constants(0, 2 * bins, seed=13)
    for i in range(2 * bins):
        if not len(doc):
            break
        h = mix64(shingles ^ constants[i])
        target = doc * bins + ((h & np.uint64(bins - 1)).astype(np.int64) if i < bins else i - bins)
        free = out[target] == empty
        # Values of earlier rounds are smaller, so a round fills empty bins only.
        np.minimum.at(out, target[free], (np.uint64(i) << np.uint64(54)) | (h[free] >> np.uint64(10)))
        open_docs = (out.reshape(-1, bins) == empty).any(1)
        stay = open_docs[doc]
        if not stay.all():
            doc, shingles = doc[stay], shingles[stay]
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    bands = sketch.shape[1] // rows
    folded = sketch[:, :bands * rows].reshape(len(sketch), bands, rows)
    total = (mix64(folded) * odd_constants(0, rows, seed=14)).sum(2, dtype=np.uint64)
    return mix64(total + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, p) of nodes whose sets have 100 * intersection >= percent * union.

    ``most`` is the size of the largest bucket that a pair met in. It says over how many parts, each with a copy of
    p, the pairs of p from buckets of that size are dealt (a power of two, so that there are few such sizes); no
    row has to meet a count of all pairs of p.
    """
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("most") / GROUP_ROWS, F.lit(1.0))))).cast("int")
    dealt = pairs.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    members = (dealt.join(texts.withColumnRenamed("node", "x"), "x")
               .select("p", "parts", "part", F.lit(1).alias("role"), "x", "text"))
    pivots = (dealt.select("p", "parts", "part").distinct()
              .join(texts.withColumnRenamed("node", "p"), "p")
              .select("p", "parts", "part", F.lit(0).alias("role"), F.col("p").alias("x"), "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            for part in chunks(batch):
                shingles, counts = shingle_sets(*text_bytes(part.column("text")), width)
                ends = np.cumsum(counts)
                linked = np.zeros(part.num_rows, bool)
                for i, role in enumerate(part.column("role").to_pylist()):
                    own = shingles[ends[i] - counts[i]:ends[i]]
                    if role == 0:
                        pivot = own
                        continue
                    at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                    both = int((pivot[at] == own).sum())
                    linked[i] = 100 * both >= percent * (len(own) + len(pivot) - both)
                yield part.select(["x", "p"]).filter(pa.array(linked))

    keys = ["p", "parts", "part"]
    rows = members.unionByName(pivots).repartition(*keys).sortWithinPartitions(*keys, "role")
    kind = pairs.select("x", "p").schema
    return rows.mapInArrow(compare, kind)


def linked_sets(shingles: np.ndarray, counts: np.ndarray, half: np.ndarray, percent: int) -> np.ndarray:
    """Smallest row that each row reaches over links between the halves (all rows in one half: between all)."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    _, back, often = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = often[back] > 1  # what one set has alone is in no intersection
    column = (np.cumsum(often > 1) - 1)[back[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    low, high = np.flatnonzero(~half), np.flatnonzero(half)
    if not len(high):
        high = low
    both = np.zeros((len(low), len(high)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        a, b = np.searchsorted(column, [begin, begin + SLAB])
        matrix = np.zeros((n, min(SLAB, int(column[b - 1]) + 1 - begin)), np.float32)
        matrix[owner[a:b], column[a:b] - begin] = 1
        both += matrix[low] @ matrix[high].T
    near = 100 * both >= percent * (counts[low][:, None] + counts[high][None, :] - both)
    near &= (counts[low] > 0)[:, None]
    u, v = np.nonzero(near)
    return forest(low[u], high[v], n)


def _linked_in_blocks(left: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) that join all linked members of the groups in ``left`` (node, its number of shingles, a group's first node)."""
    groups = components(left.select(F.col("node").alias("u"), F.col("first").alias("v")))
    sized = saved(groups.join(left.select("node", "n").distinct(), "node")
                  .select("node", "n", F.xxhash64("component").alias("cluster")), "clusters")
    parts = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART_SETS),
                                                    F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    blocks = (sized.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("node", "cluster", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
              .join(texts, "node").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ("cluster", "lo", "hi")):
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = table.slice(a, b - a).combine_chunks()
                shingles, counts = shingle_sets(*text_bytes(rows.column("text").chunk(0)), width)
                half = rows.column("part").to_numpy() != rows.column("lo").to_numpy()
                root = linked_sets(shingles, counts, half, percent)
                some = pa.array(np.flatnonzero(root != np.arange(len(root))))
                node = rows.column("node").chunk(0)
                yield pa.RecordBatch.from_arrays([node.take(some), node.take(pa.array(root[some.to_numpy()]))], ["u", "v"])

    return saved(blocks.mapInArrow(compare, "u struct<doc:long,tag:long>, v struct<doc:long,tag:long>"), "block-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """node (doc, tag), n_shingles and component (a node) of every document; see ``with_nodes``."""
    rows = band_size(percent / 100)
    keyed = with_nodes(docs, id_column, text_column).select("doc", "tag", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                shingles, counts = shingle_sets(*text_bytes(part.column("text")), width)
                ends = np.concatenate([[0], np.cumsum(counts)])
                prints = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(shingles ^ c), dtype=np.uint64)])[ends]
                          for c in odd_constants(0, 2, seed=15)]
                keys = band_keys(sketches(shingles, counts), rows)
                bounds = pa.array(np.where(counts > 0, keys.shape[1], 0).cumsum(), pa.int32())
                bounds = pa.concat_arrays([pa.array([0], pa.int32()), bounds])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("tag"), pa.array(counts, pa.int64()),
                     *(pa.array((p[1:] - p[:-1]).view(np.int64)) for p in prints),
                     pa.ListArray.from_arrays(bounds, pa.array(keys[counts > 0].reshape(-1).view(np.int64)))],
                    ["doc", "tag", "n", "f", "g", "keys"])

    sketched = saved(keyed.mapInArrow(sketch, "doc long, tag long, n long, f long, g long, keys array<long>")
                     .select(F.struct("doc", "tag").alias("node"), "n", "f", "g", "keys"), "sketches")
    full = sketched.where("n > 0")
    classes = saved(full.groupBy("f", "g").agg(F.min(F.struct("node", "n", "keys")).alias("c"), F.count(F.lit(1)).alias("size"))
                    .select("f", "g", "c.*", "size"), "classes")
    # Bucket members; keys with one member drop out before any text moves.
    entries = classes.select("node", "n", F.explode("keys").alias("key"))
    busy = saved(entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("p"),
                                            F.min_by("n", "node").alias("pn")).where("members > 1"), "buckets")
    members = saved(entries.join(busy, "key"), "members")
    close = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    texts = saved(keyed.select(F.struct("doc", "tag").alias("node"), "text")
                  .join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "texts")
    pairs = saved(members.where((F.col("node") != F.col("p")) & close).groupBy(F.col("node").alias("x"), "p")
                  .agg(F.max("members").alias("most")), "pairs")
    edges = saved(_verified(pairs, texts, width, percent), "links")
    linked = components(edges.select(F.col("x").alias("u"), F.col("p").alias("v")))
    placed = (members.select("key", "node", "n").join(linked, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"),
                                      F.min("node").alias("first")).where("a <> b")
    left = saved(placed.join(mixed.select("key", "first"), "key").select("node", "n", "first"), "mixed")
    if not left.isEmpty():
        more = _linked_in_blocks(left, texts, width, percent)
        linked = components(edges.select(F.col("x").alias("u"), F.col("p").alias("v")).unionByName(more))
    by_set = classes.join(linked, "node", "left").select("f", "g", F.coalesce("component", "node").alias("component"))
    several = saved(by_set.join(classes.where("size > 1").select("f", "g"), ["f", "g"]), "copies")
    alone = saved(linked, "linked")
    return (sketched.join(several, ["f", "g"], "left").join(alone.withColumnRenamed("component", "c"), "node", "left")
            .select("node", F.col("n").alias("n_shingles"), F.coalesce("component", "c", "node").alias("component")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """Per document its set size, the smallest id of its component, and whether it is that document."""
    kind = dict(docs.dtypes)[id_column]
    found = near_duplicates(docs, width, percent, id_column, text_column)

    def number(column: str):
        return F.when(F.col(column) != -2**63, F.col(column)).cast(kind)

    return found.select(number("node.doc").alias(id_column), "n_shingles", number("component.doc").alias("component_id"),
                        (F.col("node") == F.col("component")).alias("kept"))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, each once."""
    found = near_duplicates(docs, width, percent, id_column, text_column)
    kept = found.where(F.col("node") == F.col("component")).select("node.doc", "node.tag").distinct()
    rows = with_nodes(docs, id_column, text_column).select("doc", "tag", "row", "given", "text")
    stay = rows.join(kept, ["doc", "tag"], "left_semi")
    if _repeats(rows):
        stay = stay.groupBy("doc", "tag").agg(F.first(F.struct("row", "given", "text")).alias("r")).select("r.*")
    return stay.select(*(F.when(F.col("given"), F.col("text")).alias(c) if c == text_column else F.col("row")[c].alias(c)
                         for c in docs.columns))


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc", "tag").count().where("count > 1").isEmpty()

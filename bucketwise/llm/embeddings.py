"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

On a bounded sample the vectors are centred, turned to their principal axes, and rotations are learnt that
bring the coordinates close to their signs, so the bits are balanced and vectors of small angle share most of
them. A rotation gives up to 64 bits; these are cut into blocks, and each block is one Hamming table. The
width of a block follows from the number of vectors in a label (a chance meeting is then rare), the number
of tables from the wanted recall, given how many bits pairs at the threshold share: that is measured on the sample, since
vectors that share a direction lie at wider angles once they are centred. Every vector is in every table. Vectors that meet in a
table are reranked by the cosine of the original vectors in double precision, within their label only.

What is sent around per table is an id and a key; vectors travel only for buckets with several members.
A bucket with many members is cut into parts, and pairs of parts are compared in tasks of their own. A pair
counts in the first table where it meets. Tasks return sums and a spanning forest, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without
a label, link with nothing; vectors of different length never link; equal vectors of a label are one class
that is compared once; rows that repeat an id count as vectors of their own; a null id comes before all
others; ids are whole numbers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.graph import components, saved
from bucketwise.llm.groups import whole_groups
from bucketwise.llm.ragged import spans

SAMPLE = 8192        # vectors the rotations are learnt on
RECALL = 0.9999      # chance that a pair at the threshold meets in some table
PART_ROWS = 512      # members of a bucket part
PAIRS_AT_ONCE = 1 << 16


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and for each rotation a matrix from centred vectors to (at most 64) signed coordinates."""
    mean = sample.mean(0)
    centred = sample - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, np.argsort(-values)[:64]]
    projected = centred @ axes
    random, out = np.random.default_rng(seed), []
    for _ in range(count):
        turn = np.linalg.qr(random.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(projected.T @ np.sign(projected @ turn))
            turn = left @ right
        out.append(axes @ turn)
    return mean, np.stack(out)


def codes_of(x: np.ndarray, mean: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """One code of up to 64 bits a rotation, for each unit vector."""
    power = np.uint64(1) << np.arange(turns.shape[2], dtype=np.uint64)
    centred = x - mean
    return np.stack([((centred @ turn > 0) * power).sum(1, dtype=np.uint64) for turn in turns], 1)


def shared_bits(sample: np.ndarray, threshold: float, pairs: int = 2000, rotations: int = 4) -> np.ndarray:
    """Share of equal bits of pairs at the threshold, one value a pair.

    The partner of a sample vector lies at the threshold's angle from it; half of them in any direction, half in
    a direction in which the sample's own vectors differ.
    """
    mean, turns = learn_rotations(sample, rotations)
    random = np.random.default_rng(1)
    x = sample[random.integers(len(sample), size=pairs)]
    away = random.normal(size=x.shape)
    half = pairs // 2
    away[:half] = sample[random.integers(len(sample), size=half)] - sample[random.integers(len(sample), size=half)]
    away[np.abs(away).max(1) == 0] = 1.0
    away -= (away * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * away / np.maximum(size, 1e-12)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    differ = np.bitwise_count(codes_of(x, mean, turns) ^ codes_of(y, mean, turns)).sum(1)
    return 1 - differ / (len(turns) * turns.shape[2])


def plan_tables(vectors: int, bits: int, shared: np.ndarray) -> tuple[int, int]:
    """Bits of a block and number of tables: as many as leave pairs with these shares of equal bits a chance of
    ``1 - RECALL`` to meet nowhere, on average."""
    width = max(1, min(bits, 1 + math.ceil(math.log2(max(2, vectors)))))
    meet = np.clip(shared, 1 / bits, 1.0) ** width

    def missed(tables: int) -> float:
        return float(((1 - meet) ** tables).mean())

    low, high = 0, 1
    while missed(high) > 1 - RECALL:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(middle) > 1 - RECALL else (low, middle)
    return width, high


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root[root]]
        if (root == before).all():
            return root


def _pairs(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of rows, some at a time."""
    row = np.repeat(first, size) + spans(size)
    more = np.repeat(first + size, size) - row - 1
    ends = np.cumsum(more)
    at = 0
    while at < len(row):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        n = more[at:to]
        yield np.repeat(row[at:to], n), np.repeat(row[at:to], n) + 1 + spans(n)
        at = to


def linked_vectors(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding",
                   label_column: str = "label") -> DataFrame:
    """Per vector: id, direct links, smallest id of its component, and whether it is that one."""
    kind = dict(vectors.dtypes)[id_column]
    vector = F.col(vector_column).cast("array<double>")
    rows = saved(vectors.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(-2**63)).alias("id"), F.col(label_column).alias("label"),
        F.xxhash64(vector).alias("f"), F.xxhash64(F.lit(1), F.reverse(vector)).alias("g"), vector.alias("vector")), "vectors")
    fine = (rows.where("label is not null and vector is not null")
            .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .where(F.exists("vector", lambda x: x != 0)))
    classes = saved(fine.groupBy("label", "f", "g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"),
                                                       F.min("vector").alias("vector"))
                    .withColumn("node", F.struct("id", "f")).drop("id"), "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    if most is None:
        links, reached = None, None
    else:
        links, reached = _compare_classes(classes, int(most), threshold)
    out = rows.select("id", "label", "f", "g")
    if links is not None:
        by_class = classes.select("label", "f", "g", "node", "weight").join(links, "node", "left").join(reached, "node", "left")
        busy = saved(by_class.where("weight > 1 or component is not null")
                     .select("label", "f", "g", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                             F.coalesce("component.id", "node.id").alias("component")), "linked-classes")
        valid = fine.select("id", "label", "f", "g").join(busy, ["label", "f", "g"], "left")
        other = rows.join(classes.select("label", "f", "g"), ["label", "f", "g"], "left_anti").select("id")
        out = (valid.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
               .unionByName(other.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))))
    else:
        out = out.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))

    def number(column: str):
        return F.when(F.col(column) != -2**63, F.col(column)).cast(kind)

    return out.select(number("id").alias(id_column), "n_links", number("component").alias("component_id"),
                      (F.col("id") == F.col("component")).alias("kept"))


def _compare_classes(classes: DataFrame, most: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    sample = [r[0] for r in classes.orderBy(F.xxhash64("f"), "f", "g").limit(SAMPLE).select("vector").collect()]
    longest = max(map(len, sample))  # shorter ones are padded; they meet their own length only
    matrix = np.zeros((len(sample), longest))
    for i, v in enumerate(sample):
        matrix[i, :len(v)] = v
    matrix /= np.linalg.norm(matrix / np.abs(matrix).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(matrix).max(1, keepdims=True)
    bits = min(64, longest)
    width, tables = plan_tables(most, bits, shared_bits(matrix, threshold))
    blocks = bits // width
    model = spark.sparkContext.broadcast(learn_rotations(matrix, -(-tables // blocks)))

    def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors padded to the length the rotations know, and their own lengths."""
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        out = np.zeros((len(size), max(longest, int(size.max(initial=0)))))
        out[np.repeat(np.arange(len(size)), size), spans(size)] = flat
        out /= np.abs(out).max(1, keepdims=True)
        return out / np.linalg.norm(out, axis=1, keepdims=True), size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turns = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size = unit(batch.column("vector"))
            codes = codes_of(x[:, :longest], mean, turns)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(turns), pa.int32()),
                                             pa.array(codes.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), lists],
                                             [*batch.schema.names, "size", "codes"])

    label = classes.schema["label"].dataType.simpleString()
    narrow = classes.select("node", "label", "weight", "vector")
    coded = saved(narrow.mapInArrow(encode, f"node struct<id:long,f:long>, label {label}, weight long, vector array<double>, "
                                            "size int, codes array<long>"), "codes")
    mask = (1 << width) - 1
    number = F.expr(f"transform(sequence(0, {tables - 1}), t -> shiftrightunsigned(codes[cast(t div {blocks} as int)], "
                    f"cast((t % {blocks}) * {width} as int)) & {mask}L)")
    entries = coded.select("node", "label", "size", F.posexplode(number).alias("t", "key"))
    bucket = ["label", "size", "t", "key"]
    busy = saved(entries.groupBy(bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "vector-buckets")
    parts = F.ceil(F.col("m") / PART_ROWS).cast("int")
    placed = (entries.join(busy, bucket).withColumn("parts", parts)
              .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("node", "t", "part", F.xxhash64(*bucket).alias("bucket"), F.least("part", "other").alias("lo"),
                      F.greatest("part", "other").alias("hi")))
    # The bucket is told by its hash; a chance meeting of two buckets only adds pairs that are checked anyway.
    joined = placed.join(coded.select("node", F.xxhash64("label", "size").alias("side"), "weight", "vector", "codes"), "node")
    task = joined.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ("bucket", "lo", "hi")):
            yield linked(table, cuts)

    def linked(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        x, _ = unit(table.column("vector").chunk(0))
        codes = table.column("codes").chunk(0)
        codes = codes.flatten().to_numpy().reshape(table.num_rows, -1).view(np.uint64)
        t, part, lo, hi, side, weight = (table.column(c).to_numpy() for c in ("t", "part", "lo", "hi", "side", "weight"))
        found = []
        for u, v in _pairs(cuts[:-1], np.diff(cuts)):
            use = ((lo[u] == hi[u]) | (part[u] != part[v])) & (side[u] == side[v]) & (t[u] == t[v])
            u, v = u[use], v[use]
            near = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
            found.append((u[near], v[near]))
        u, v = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        seen = np.zeros(len(u), bool)
        for earlier in range(tables):
            word, shift = earlier // blocks, np.uint64(earlier % blocks * width)
            same = ((codes[u, word] ^ codes[v, word]) >> shift) & np.uint64(mask) == 0
            seen |= same & (earlier < t[u])
        u, v = u[~seen], v[~seen]
        total = np.bincount(u, weights=weight[v], minlength=len(x)) + np.bincount(v, weights=weight[u], minlength=len(x))
        root = forest(u, v, len(x))
        some = np.flatnonzero(total)
        node = table.column("node").chunk(0)
        return pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.array(total[some].astype(np.int64)),
                                           node.take(pa.array(root[some]))], ["node", "links", "root"])

    pairs = saved(task.mapInArrow(rerank, "node struct<id:long,f:long>, links long, root struct<id:long,f:long>"), "vector-links")
    return (pairs.groupBy("node").agg(F.sum("links").alias("links")),
            components(pairs.select(F.col("node").alias("u"), F.col("root").alias("v"))))

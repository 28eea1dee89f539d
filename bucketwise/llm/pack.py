"""Packing documents into windows of a fixed number of tokens: best-fit decreasing.

A document is its token ids and a closing id. Documents longer than a window are first cut into full
windows; the rests are placed from the longest to the shortest, each into the open window with the
least room that still takes it. A segment tree over the remaining capacities finds that window.
Rests are dealt into shards by a hash of their document, each packed by itself; a shard holds so many
rests that the open windows left at its end do not count.

Defined cases: a null text is an empty one, a document of the closing id alone; repeated rows are packed
each for itself; equal lengths go by document id; an empty table gives no pieces; other columns of the
input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.pretokens import TokenCache, gather, pretokens
from bucketwise.llm.ragged import chunks, spans, text_bytes

RESTS_PER_SHARD = 20_000


class LibraryEncoder:
    """Ids as the tokenizers library gives them; each distinct pre-token is encoded once by a worker."""

    def __init__(self, spec: str):
        self.spec = spec

    def __getstate__(self) -> dict:
        return {"spec": self.spec}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if "cache" not in self.__dict__:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.spec)
            added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            if len(added) > 1:
                raise ValueError("one added token at most is handled")
            self.special = next(iter(added), "").encode()
            self.cache = TokenCache(lambda pieces: [e.ids for e in tokenizer.encode_batch_fast(
                [p.decode("utf-8") for p in pieces], add_special_tokens=False)])
        starts, ends, _ = pretokens(data, offsets, self.special)
        begin, size = self.cache(data, starts, ends)
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return gather(self.cache.ids, begin, size).astype(np.uint32), at[np.searchsorted(starts, offsets)]


class BestFit:
    """Open windows by remaining capacity; ``place`` puts a piece into the tightest one."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)  # number of open windows below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.windows = 0

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += n
            node >>= 1

    def _tightest(self, length: int) -> int:
        """Smallest remaining capacity of at least ``length``, or 0."""
        tree, node = self.tree, self.leaves + length
        if tree[node]:
            return length
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset of the next piece."""
        capacity = self._tightest(length)
        if capacity:
            number = self.open[capacity].pop()
            self._add(capacity, -1)
        else:
            number, capacity = self.windows, self.window
            self.windows += 1
        if capacity > length:
            self.open[capacity - length].append(number)
            self._add(capacity - length, 1)
        return number, self.window - capacity


def pack_documents(docs: DataFrame, window: int = 1024, closing_id: int = 0, path: str | None = None,
                   keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents: where each begins in its document and in its window, and its checksum."""
    spark = docs.sparkSession
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(LibraryEncoder(file.read()))
    kind = dict(docs.dtypes)[id_column]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for part in chunks(batch):
                ids, at = encoder.encode(*text_bytes(part.column("text")))
                counts = np.diff(at) + 1
                closed = np.full(len(ids) + len(counts), closing_id, np.uint32)
                ends = np.cumsum(counts)
                inner = np.ones(len(closed), bool)
                inner[ends - 1] = False
                closed[inner] = ids
                pieces = -(-counts // window)
                start = np.repeat(ends - counts, pieces) + window * spans(pieces)
                stop = np.minimum(start + window, np.repeat(ends, pieces))
                raw = memoryview(closed.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                bounds = pa.array(np.concatenate([[0], np.cumsum(pieces)]), pa.int32())
                columns = [part.column("doc"), pa.array(counts, pa.int64()),
                           pa.ListArray.from_arrays(bounds, pa.array(crc, pa.int64()))]
                names = ["doc", "doc_tokens", "crc"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                                            pa.array(closed.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    def pack(table: pa.Table) -> pa.Table:
        """One shard: lengths alone decide, so what is held is a few numbers a document."""
        tokens = table.column("doc_tokens").to_numpy()
        pieces = -(-tokens // window)
        row = np.repeat(np.arange(len(tokens)), pieces)
        start = window * spans(pieces)
        length = np.minimum(tokens[row] - start, window)
        doc = table.column("doc").combine_chunks()
        order = np.lexsort((np.arange(len(row)), doc.take(pa.array(row)).to_numpy(zero_copy_only=False), -length))
        fit, number, offset = BestFit(window), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for i, n in zip(order.tolist(), length[order].tolist(), strict=True):
            number[i], offset[i] = fit.place(n)
        columns = {"doc": doc.take(pa.array(row)), "start": start, "length": length,
                   "ids_crc32": table.column("crc").combine_chunks().flatten(), "doc_tokens": tokens[row],
                   "sequence_id": (np.repeat(table.column("shard").to_numpy()[:1], len(row)) << 32) + number, "offset": offset}
        if keep_ids:
            ids = table.column("ids").combine_chunks()
            base = ids.offsets.to_numpy()[:-1][row] + start
            bounds = np.concatenate([[0], np.cumsum(length)])
            flat = ids.values.to_numpy()[np.repeat(base, length) + spans(length)]
            columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
        return pa.table(columns)

    shards = -(-docs.count() // RESTS_PER_SHARD) or 1
    extra = ", ids array<int>" if keep_ids else ""
    encoded = docs.select(docs[id_column].alias("doc"), docs[text_column].alias("text")).mapInArrow(
        encode, f"doc {kind}, doc_tokens long, crc array<long>{extra}")
    sharded = encoded.withColumn("shard", F.pmod(F.xxhash64("doc", "crc"), F.lit(shards)))
    packed = sharded.groupBy("shard").applyInArrow(
        pack, f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{extra}")
    return packed.withColumnRenamed("doc", id_column)

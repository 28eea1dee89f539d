"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves every pre-token that is a token as a
whole. Second tier: a miss is merged byte by byte; a heap holds the ranked neighbours of a linked list,
so the lowest rank is always merged next. Each worker merges a distinct miss once (a bounded cache).

Defined cases: a null text encodes like an empty one, to no ids; the digest of nothing is that of the
empty string; repeated rows are encoded each for itself; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from bucketwise.llm.pretokens import TokenCache, gather, pretokens
from bucketwise.llm.ragged import chunks, hash_slices, text_bytes
from bucketwise.llm.vocabulary import PerfectHash, read_ranks, token_hash


class Codec:
    """Encoder and decoder of one rank file; picklable, sent to the workers as a broadcast."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lookup = PerfectHash(token_hash(tokens))
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def from_file(cls, path: str) -> Codec:
        return cls(read_ranks(path))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "cache")}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself: merge the neighbours of lowest rank, leftmost first."""
        ranks = self.ranks
        n = len(piece)
        parts = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes]] = []
        for i in range(n - 1):
            pair = piece[i:i + 2]
            rank = ranks.get(pair)
            if rank is not None:
                heappush(heap, (rank, i, pair))
        while heap:
            _, i, pair = heappop(heap)
            left = parts[i]
            j = after[i]
            if left is None or j >= n or left + parts[j] != pair:
                continue  # one of the two has been merged since
            parts[i], parts[j] = pair, None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                longer = pair + parts[j]
                rank = ranks.get(longer)
                if rank is not None:
                    heappush(heap, (rank, i, longer))
            k = before[i]
            if k >= 0:
                longer = parts[k] + pair
                rank = ranks.get(longer)
                if rank is not None:
                    heappush(heap, (rank, k, longer))
        return [ranks[p] for p in parts if p is not None]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offset of each text in them."""
        if "cache" not in self.__dict__:
            self.ranks = {token: i for i, token in enumerate(self.tokens)}
            self.cache = TokenCache(lambda pieces: [self.merge(p) for p in pieces])
        starts, ends, _ = pretokens(data, offsets)
        whole = self.lookup(hash_slices(data, starts, ends, seed=5))
        known = whole >= 0
        known &= self.size[whole] == ends - starts
        counts = np.ones(len(starts), np.int64)
        begin, size = self.cache(data, starts[~known], ends[~known])
        counts[~known] = size
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(at[-1], np.uint32)
        ids[at[:-1][known]] = whole[known]
        inner = np.repeat(~known, counts)
        ids[inner] = gather(self.cache.ids, begin, size)
        return ids, at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.begin[ids], self.size[ids])


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """Per document: token count, digest of the ids and of the bytes decoded from them; the ids too if asked."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec.from_file(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for part in chunks(batch):
                ids, at = codec.encode(*text_bytes(part.column("text")))
                decoded = codec.decode(ids)
                ends = np.concatenate([[0], np.cumsum(codec.size[ids])])[at]
                raw, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(decoded.tobytes())
                rows = range(part.num_rows)
                columns = [part.column(id_column), pa.array(np.diff(at), pa.int64()),
                           pa.array([hashlib.sha256(raw[4 * at[i]:4 * at[i + 1]]).hexdigest() for i in rows], pa.string()),
                           pa.array([hashlib.sha256(plain[ends[i]:ends[i + 1]]).hexdigest() for i in rows], pa.string())]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_column, docs[text_column].alias("text")).mapInArrow(run, schema)

"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a chunk are one ragged array of symbol ids. In each round every sequence
merges all places of its own lowest-ranked pair at the same time (from the left where they overlap);
a sequence leaves when it has no ranked pair. The symbols that survive are the tokens; only their
number is kept.

Defined cases: a null text counts as an empty one, with no tokens; strings that are tokens of their own
count one wherever they stand in a text; repeated rows are counted each for itself; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.pretokens import TokenCache, pretokens
from bucketwise.llm.ragged import chunks, mix64, spans, text_bytes
from bucketwise.llm.vocabulary import PerfectHash, read_merges

NONE = np.int32(2**31 - 1)


class Merger:
    """Merge table of one tokenizer file; picklable."""

    def __init__(self, path: str):
        self.of_byte, table, added = read_merges(path)
        if len(added) > 1:
            raise ValueError("one added token at most is handled")
        self.special = next(iter(added), "").encode()
        self.new = np.append(table[:, 2], 0).astype(np.int32)
        self.lookup = PerfectHash(self._keys(table[:, 0], table[:, 1]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix64((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.lookup(self._keys(left, right))
        return np.where(rank < 0, NONE, rank).astype(np.int32)

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each byte string (none is empty)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)  # stays sorted
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair that begins at each symbol
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(first, len(symbols)))
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == NONE
            if done.any():
                out[owner[first[done]]] = count[done]
                stay = np.repeat(~done, count)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                lowest, count = lowest[~done], count[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, count)
            # Equal pairs can overlap only in runs of one symbol; every second place of a run merges.
            at = np.flatnonzero(hit)
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            begins = np.flatnonzero(run)
            turn = spans(np.diff(np.append(begins, len(at))))
            at = at[turn % 2 == 0]
            symbols[at] = self.new[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay)[at] - 1
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[touched] = NONE
            pair = touched[touched + 1 < len(symbols)]
            pair = pair[owner[pair] == owner[pair + 1]]
            rank[pair] = self._ranks(symbols[pair], symbols[pair + 1])
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        if "cache" not in self.__dict__:
            self.cache = TokenCache(lambda pieces: [(n,) for n in self.survivors(pieces).tolist()])
        starts, ends, special = pretokens(data, offsets, self.special)
        begin, _ = self.cache(data, starts, ends)
        each = np.where(special, 1, self.cache.ids[begin]) if len(begin) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        return np.diff(total[np.searchsorted(starts, offsets)])


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Per document: bytes, tokens, and whether there are more than ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(Merger(path or public_tokenizers.path("byte_bpe_50k.json")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = shared.value
        for batch in batches:
            for part in chunks(batch):
                data, offsets = text_bytes(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), pa.array(np.diff(offsets), pa.int64()),
                     pa.array(merger.counts(data, offsets), pa.int64())], [id_column, "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_column]
    counted = docs.select(id_column, docs[text_column].alias("text")).mapInArrow(
        run, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

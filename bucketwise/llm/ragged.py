"""Ragged numpy arrays over Arrow text: words, hashes and windows without a Python object per word.

All functions work on one chunk of documents. A chunk is a slice of an Arrow batch whose texts stay
below ``CHUNK_BYTES`` together (a longer text is a chunk of its own), so temporary arrays stay small
whatever the batch size of the session is. A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 3 << 20

# White space of the word rule [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def odd_constants(start: int, n: int, seed: int = 0) -> np.ndarray:
    """Odd pseudo-random multipliers number ``start`` to ``start + n`` of a seed."""
    i = np.arange(start + 1, start + n + 1, dtype=np.uint64)
    return mix64(i * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xA24BAED4963EE407) % 2**64)) | np.uint64(1)


_tables: dict[int, np.ndarray] = {}


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    table = _tables.get(seed)
    if table is None or len(table) < n:
        table = odd_constants(0, max(n, 4096) * 2, seed)
        if len(table) <= 1 << 20:
            _tables[seed] = table
    return table[:n]


def spans(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, one after the other."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    out -= np.repeat(ends - counts, counts)
    return out


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one longer text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at, base = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        base, at = int(ends[to - 1]), to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each text (one more than rows)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


@dataclass
class Words:
    data: np.ndarray     # bytes of all texts
    offsets: np.ndarray  # of each text in data
    starts: np.ndarray   # of each word in data
    ends: np.ndarray
    first: np.ndarray    # number of the first word of each text, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inner = ~SPACES[data]
    begin, end = inner.copy(), inner.copy()
    begin[1:] &= ~inner[:-1]
    end[:-1] &= ~inner[1:]
    cuts = np.unique(offsets)
    cuts = cuts[(cuts > 0) & (cuts < n)]  # words end with their text
    begin[cuts] = inner[cuts]
    end[cuts - 1] = inner[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other letters stay."""
    return _LOWER[data]


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every slice of bytes: a sum of its 8-byte blocks times odd constants, scrambled.

    Slices of up to eight bytes with one length never collide.
    """
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(data) + 1,), (1,))
    c = multipliers(1, seed)[0]
    total = (blocks[starts] & _MASK[np.minimum(size, 8)]) * c
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        j = spans(more) + 1
        at = np.repeat(starts[long], more) + 8 * j
        left = np.repeat(size[long], more) - 8 * j
        part = mix64(blocks[at] & _MASK[np.minimum(left, 8)]) * multipliers(int(more.max()) + 1, seed)[j]
        total[long] += np.add.reduceat(part, np.cumsum(more) - more)
    return mix64(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hash_words(w: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    return hash_slices(lowered(w.data) if lower else w.data, w.starts, w.ends, seed)


def window_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of the n values from each position on (shorter by n - 1 than h); windows may span texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m, c = len(h) - n + 1, multipliers(n, seed)
    total = h[:m] * c[0]
    for j in range(1, n):
        total += h[j:m + j] * c[j]
    return mix64(total)


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of n words inside one text, and the number of windows of each text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    return np.repeat(first[:-1], counts) + spans(counts), counts


def sequence_hashes(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, seed: int = 2) -> np.ndarray:
    """Hash of each run of ``counts`` values from ``starts`` on; runs may overlap."""
    out = counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    full = np.flatnonzero(counts > 0)
    if len(full):
        c, j = counts[full], spans(counts[full])
        part = h[np.repeat(starts[full], c) + j] * multipliers(int(c.max()), seed)[j]
        out[full] += np.add.reduceat(part, np.cumsum(c) - c)
    return mix64(out)


def joined_digests(w: Words, keep: np.ndarray | None = None) -> list[str]:
    """SHA-256 (hex) of each text's kept words joined by one space."""
    n = len(w.first) - 1
    data = w.data.copy()
    data[SPACES[data]] = 0x20
    if keep is None:
        mask, kept_starts, kept_ends = ~SPACES[w.data], w.starts, w.ends
        first = w.first
    else:
        edge = np.zeros(len(data) + 1, np.int8)
        kept_starts, kept_ends = w.starts[keep], w.ends[keep]
        edge[kept_starts] += 1
        np.subtract.at(edge, kept_ends, 1)
        mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        first = np.concatenate([[0], np.cumsum(keep)])[w.first]
    inner = np.ones(len(kept_ends), bool)  # a blank after every kept word but the last of a text
    inner[first[1:][np.diff(first) > 0] - 1] = False
    mask[kept_ends[inner]] = True
    data[kept_ends[inner]] = 0x20
    out = memoryview(np.ascontiguousarray(data[mask]))
    size = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
    return [hashlib.sha256(out[size[i]:size[i + 1]]).hexdigest() for i in range(n)]

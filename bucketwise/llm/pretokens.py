"""Splitting texts into pre-tokens with array operations, and encoding each distinct pre-token once.

The split is that of the byte-level vocabularies: contractions, letters, numbers and other signs with
one blank before them, and white space. Texts become arrays of character classes; where a pre-token
starts follows from the classes of a character and its neighbours.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from bucketwise.llm.ragged import hash_slices, spans

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# The Unicode property White_Space, which \s stands for.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that form a pre-token with the apostrophe before them.
ENDINGS = "s t m d re ve ll".split()

_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def pretokens(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes) of every pre-token, and whether it is the special string.

    Pre-tokens tile the texts. An occurrence of ``special`` is one pre-token, and the text on either
    side of it is split as a text of its own.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
    n = len(points)
    marks, cuts = [], offsets
    if special and special in raw:
        bounds = set(offsets.tolist())
        found = raw.find(special)
        while found >= 0:
            if not any(found < b < found + len(special) for b in bounds):  # not across two texts
                marks.append(found)
            found = raw.find(special, found + (len(special) if marks and marks[-1] == found else 1))
        cuts = np.concatenate([offsets, marks, np.array(marks, np.int64) + len(special)])
    cuts = np.searchsorted(at, np.unique(cuts))
    cuts = cuts[cuts < n]
    kind = character_classes()[points]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[cuts] = True
    cut = np.zeros(n + 3, bool)
    cut[cuts] = True
    cut[n:] = True
    # The last blank before other characters belongs to them; other white space there stands alone.
    after = np.flatnonzero(start & (kind != SPACE) & ~cut[:n])
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        ahead = np.concatenate([points, np.zeros(3, np.uint32)])
        for ending in ENDINGS:
            fits = np.ones(len(quote), bool)
            for k, letter in enumerate(ending, 1):
                fits &= (ahead[quote + k] == ord(letter)) & ~cut[quote + k]
            hit = quote[fits]
            start[hit + 1] = False
            rest = hit + len(ending) + 1
            start[rest[rest < n]] = True
    if marks:
        lo, hi = np.searchsorted(at, marks), np.searchsorted(at, np.array(marks) + len(special))
        for a, b in zip(lo, hi, strict=True):
            start[a + 1:b] = False
    starts = at[start]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.isin(starts, np.array(marks, np.int64)) if marks else np.zeros(len(starts), bool)


class TokenCache:
    """Ids of the distinct pre-tokens a worker has met; what does not fit is encoded again.

    ``encode`` takes a list of byte strings and returns a list of id lists, or of counts where only
    those are wanted. Entries are found by a 64-bit hash; two places are tried for each.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], bits: int = 21):
        self.encode, self.bits = encode, bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.begin, self.size = np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.used = 0

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return (h >> shift).astype(np.int64), ((h << np.uint64(self.bits)) >> shift).astype(np.int64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``self.ids`` the ids of each pre-token begin, and how many there are."""
        if self.used > (1 << self.bits) * 3 // 4:
            self.clear()
        h = hash_slices(data, starts, ends, seed=5)
        a, b = self._places(h)
        found = np.where(self.keys[a] == h, self.entry[a], np.where(self.keys[b] == h, self.entry[b], 0))
        missed = np.flatnonzero(found == 0)
        if len(missed):
            new, one, back = np.unique(h[missed], return_index=True, return_inverse=True)
            raw = data.tobytes()
            one = missed[one]
            lists = self.encode([raw[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            size = np.fromiter(map(len, lists), np.int32, len(lists))
            flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(size.sum()))
            number = np.arange(len(new), dtype=np.int32) + len(self.begin)
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, flat)
            found[missed] = number[back]
            left = np.arange(len(new))
            for place in self._places(new):
                left = left[self.keys[place[left]] == 0]
                self.keys[place[left]] = new[left]  # of several for one place, the last stays
                self.entry[place[left]] = number[left]
                left = left[self.keys[place[left]] != new[left]]
            self.used = len(self.begin)
        return self.begin[found], self.size[found]


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``values[begin:begin + size]`` one after the other."""
    return values[np.repeat(begin, size) + spans(size)]

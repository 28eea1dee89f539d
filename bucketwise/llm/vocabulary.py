"""Vocabulary files of byte-level tokenizers. Read on the driver; workers get them by broadcast."""

from __future__ import annotations

import base64
import json

import numpy as np

from bucketwise.llm.ragged import hash_slices, mix64


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    pairs = [line.split() for line in open(path, "rb")]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a tokenizer file, and its byte.

    Printable bytes stand for themselves; the others take the characters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_merges(path: str) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Of a byte-level tokenizer file: the id of each byte, (left id, right id, new id) of each merge by rank, and
    the strings that are tokens of their own."""
    spec = json.load(open(path, encoding="utf-8"))
    ids, alphabet = spec["model"]["vocab"], byte_alphabet()
    of_byte = np.zeros(256, np.int32)
    for char, byte in alphabet.items():
        of_byte[byte] = ids[char]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    table = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
    return of_byte, table, {t["content"]: t["id"] for t in spec["added_tokens"]}


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: hash and displace.

    Keys fall into small groups; groups are placed from the largest to the smallest, each with the
    first displacement that puts all of its keys on free places. There are as many places as keys.
    """

    GROUP = 4

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.groups = max(n, 1), max(1, n // self.GROUP)
        self.shift = np.zeros(self.groups, np.uint64)
        self.order = np.full(self.n, -1, np.int64)  # the key at each place
        group = self._group(keys)
        by_group = np.argsort(group, kind="stable")
        counts = np.bincount(group, minlength=self.groups)
        first = np.cumsum(counts) - counts
        free = np.ones(self.n, bool)
        shifts = np.arange(256, dtype=np.uint64)
        for g in np.argsort(-counts, kind="stable"):
            if not counts[g]:
                break
            own = by_group[first[g]:first[g] + counts[g]]
            base = 0
            while True:
                places = self._place(keys[own][None, :], (shifts + np.uint64(base))[:, None])
                good = free[places].all(1)
                if counts[g] > 1:
                    sorted_places = np.sort(places, 1)
                    good &= (sorted_places[:, 1:] != sorted_places[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[g] = base + k
                    self.order[places[k]] = own
                    free[places[k]] = False
                    break
                base += 256
        self.keys = keys[self.order] if n else np.zeros(1, np.uint64)

    def _group(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) % np.uint64(self.groups)).astype(np.int64)

    def _place(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix64(keys + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for strangers."""
        place = self._place(keys, self.shift[self._group(keys)])
        return np.where(self.keys[place] == keys, self.order[place], -1)


def token_hash(tokens: list[bytes], seed: int = 5) -> np.ndarray:
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size)
    return hash_slices(np.frombuffer(b"".join(tokens), np.uint8), ends - size, ends, seed)

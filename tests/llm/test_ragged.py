import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from bucketwise.llm import ragged
from bucketwise.llm.passages import first_smallest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0bé　x", max_size=60)), min_size=1, max_size=12)


def split(texts):
    data, offsets = ragged.text_bytes(pa.array(texts, pa.string()))
    return ragged.words(data, offsets)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_digests(texts):
    w = split(texts)
    random.seed(len(texts))
    keep = np.array([random.random() < 0.5 for _ in range(len(w.starts))], bool)
    whole, part = ragged.joined_digests(w), ragged.joined_digests(w, keep)
    for i, text in enumerate(texts):
        want = WORD.findall(text or "")
        own = slice(w.first[i], w.first[i + 1])
        assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[own], w.ends[own], strict=True)] == want
        assert whole[i] == hashlib.sha256(" ".join(want).encode()).hexdigest()
        assert part[i] == hashlib.sha256(" ".join(x for x, k in zip(want, keep[own], strict=True) if k).encode()).hexdigest()


def test_hashes_tell_words_apart():
    random.seed(4)
    texts = ["".join(random.choice("abc") for _ in range(random.randrange(1, 40))) for _ in range(3000)]
    h = ragged.hash_words(split(texts))
    assert len(set(h.tolist())) == len(set(texts))
    upper = ragged.hash_words(split([t.upper() for t in texts]), lower=True)
    assert (upper == h).all()


def test_chunks_keep_rows_and_bounds():
    texts = ["x" * n for n in (5, 0, 100, 3, 3, 3)] + [None]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    parts = list(ragged.chunks(batch, limit=8))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 8 for p in parts)
    assert list(ragged.chunks(batch.slice(0, 0))) == []


def test_first_smallest():
    v = np.array([3, 1, 1, 2, 0, 5, 5], np.uint64)
    for width in range(1, 8):
        got = first_smallest(v, width)
        assert got.tolist() == [i + int(np.argmin(v[i:i + width])) for i in range(len(v) - width + 1)]

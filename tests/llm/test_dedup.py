import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from bucketwise.llm.embeddings import codes_of, forest, learn_rotations, linked_vectors, plan_tables, shared_bits
from bucketwise.llm.graph import components
from bucketwise.llm import minhash
from bucketwise.llm.minhash import BINS, band_size, keep_one, sketches, without_near_copies
from bucketwise.llm.passages import remove_repeats, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self[b] = a


def removed_words(docs, n):
    """Brute force: words covered by a window whose words also start earlier."""
    first, out = {}, {}
    for d, t in sorted(docs.items()):
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i:i + n]), (d, i))
    for d, t in docs.items():
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i:i + n])] != (d, i) for j in range(i, i + n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [3, 20])
def test_repeats_against_brute_force(spark, window):
    random.seed(window)
    docs = {i: " ".join(random.choice("abc") for _ in range(random.choice([0, 1, 5, 20, 60, 150]))) for i in range(200)}
    docs[7] = None
    got = remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), window=window).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == removed_words(docs, window)


def test_repeats_edge_cases(spark, edge_docs, no_docs, edge_texts):
    got = remove_repeats(edge_docs).collect()
    assert len(got) == len(edge_texts)
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].n_removed == 0 and by_id[7].n_removed == 70
    assert by_id[1].n_words == by_id[0].n_words == 0 and by_id[11].n_removed == 59
    assert remove_repeats(no_docs).count() == 0
    texts = without_repeats(edge_docs)
    assert texts.columns == edge_docs.columns
    kept = {r.doc_id: r.text for r in texts.collect()}
    assert kept[7] == "seven begins seven ends" and kept[1] is None and kept[6] == edge_texts[7][1]


def brute_components(docs, width, percent):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    groups, ids = Groups(), sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {d: (len(sets[d]), groups.top(d), groups.top(d) == d) for d in docs}


@pytest.mark.parametrize("group_rows", [minhash.GROUP_ROWS, 3])
def test_near_copies_against_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(minhash, "GROUP_ROWS", group_rows)
    random.seed(5)
    base = [[random.choice("abcdefghijklmnop") + random.choice("xyzuv") for _ in range(40)] for _ in range(15)]
    docs = {3: None}
    for i in range(150):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2])):
            w[random.randrange(40)] = random.choice(["Qq", "rr", "ss"])
        docs[i] = " ".join(w[:random.choice([40, 40, 38, 2, 1, 0])])
    got = keep_one(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_components(docs, 3, 85)


def test_near_copies_edge_cases(edge_docs, no_docs, edge_texts):
    got = keep_one(edge_docs).collect()
    assert len(got) == len(edge_texts)
    of = {r.doc_id: r for r in got if r.doc_id != 10}
    assert of[0].n_shingles == 0 and of[0].kept and of[1].kept and of[2].kept
    assert of[9].component_id == 8 and not of[9].kept and of[None].component_id is None
    assert keep_one(no_docs).count() == 0
    left = without_near_copies(edge_docs)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == edge_docs.columns and 9 not in ids and 8 in ids and ids.count(10) == 2


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 60, 700)]
    sets.append(np.concatenate([sets[3][:630], rng.integers(0, 2**63, 70, dtype=np.uint64)]))
    out = sketches(np.concatenate(sets), np.array([len(s) for s in sets] + [0]))
    assert (out[:5] != 2**64 - 1).all() and (out[5] == 2**64 - 1).all()
    assert abs((out[3] == out[4]).mean() - 630 / 770) < 4 * math.sqrt(0.15 / BINS)
    assert (1 - 0.85 ** band_size(0.85)) ** (BINS // band_size(0.85)) < 1e-6


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: groups.top(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest():
    assert forest(np.array([0, 1, 4]), np.array([2, 2, 3]), 6).tolist() == [0, 0, 0, 3, 3, 5]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        centre = rng.normal(size=16) if i % 3 == 0 or i < 3 else np.array(rows[rng.integers(len(rows))][2])
        rows.append((i, int(rng.integers(2)), (centre + rng.normal(size=16) * rng.choice([0, .05, .2, .3])).tolist()))
    rows += [(400, None, [1.0] * 16), (401, 0, None), (402, 0, [0.0] * 16), (403, 0, [math.nan] + [1.0] * 15), (404, 0, [1.0] * 8),
             (405, 0, [2.0] * 8), (406, 0, []), (407, 0, [None] * 16), (408, 0, [math.inf] * 16), (None, 0, [2.0] * 8)]
    links, groups, valid = collections.Counter(), Groups(), {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            valid[-1 if i is None else i] = (label, np.array(v) / np.linalg.norm(v))
    ids = sorted(valid)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (la, va), (lb, vb) = valid[a], valid[b]
            if la == lb and len(va) == len(vb) and va @ vb >= 0.93:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, node string")
    got = {-1 if r.vec_id is None else r.vec_id: (r.n_links, -1 if r.component_id is None else r.component_id, r.kept)
           for r in linked_vectors(df).collect()}
    want = {k: (links[k], groups.top(k), groups.top(k) == k) for k in (-1 if r[0] is None else r[0] for r in rows)}
    assert got == want
    assert linked_vectors(df.limit(0)).count() == 0


def directed(rng, n, dims, mean):
    """Unit vectors around a common direction of the given length, and near copies of some at a cosine of 0.935."""
    common = np.zeros(dims)
    common[0] = mean
    x = rng.normal(size=(n, dims))
    x[:, 0] = 0
    x = common + math.sqrt(1 - mean * mean) * x / np.linalg.norm(x, axis=1, keepdims=True)
    base = x[rng.integers(n, size=n // 4)]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    y = 0.935 * base + math.sqrt(1 - 0.935 ** 2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    return x, base, y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize("dims", [64, 384])
@pytest.mark.parametrize("mean", [0.0, 0.8, 0.9])
def test_tables_reach_the_recall_also_around_a_common_direction(dims, mean):
    x, base, near = directed(np.random.default_rng(3), 8000, dims, mean)
    sample = np.concatenate([x[:4000], near[:500]])
    width, tables = plan_tables(8000, min(64, dims), shared_bits(sample, 0.93))
    blocks = 64 // width
    middle, turns = learn_rotations(sample, -(-tables // blocks))
    differ = codes_of(base, middle, turns) ^ codes_of(near, middle, turns)
    met = np.zeros(len(base), bool)
    for t in range(tables):
        met |= (differ[:, t // blocks] >> np.uint64(t % blocks * width)) & np.uint64((1 << width) - 1) == 0
    assert met.mean() >= 0.998, (width, tables)


def test_vectors_around_a_common_direction_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x, base, near = directed(rng, 240, 64, 0.8)
    all_rows = np.concatenate([x, base, near])
    rows = [(i % 290, int(i % 7 == 0), v.tolist()) for i, v in enumerate(all_rows)]  # some ids twice
    labels, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    links = (all_rows @ all_rows.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(len(rows), dtype=bool)
    got = collections.Counter((r.vec_id, r.n_links) for r in linked_vectors(
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert got == collections.Counter(zip(ids.tolist(), links.sum(1).tolist(), strict=True)) and links.sum() > 100

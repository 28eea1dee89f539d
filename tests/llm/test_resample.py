import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from bucketwise.llm import resample as module
from bucketwise.llm.graph import saved
from bucketwise.llm.resample import crc_slices, feature_buckets, ranked, resample
from tests.conftest import SMALL, plan_of


def features(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i:i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def brute(docs, targets, percent=25, size=10_000, width=2, least=20, seed=7):
    s, t, found = [0] * size, [0] * size, []
    for i, text in docs:
        words, own = features(text, width)
        own = [zlib.crc32(f.encode()) % size for f in own]
        found.append((i, len(words), own))
        for b in own:
            s[b] += 1
    for text in targets:
        for f in features(text, width)[1]:
            t[zlib.crc32(f.encode()) % size] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + size) / ((s[b] + 1) * (sum(t) + size)))) for b in range(size)]
    rows = []
    for i, words, own in found:
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, row in enumerate(order[:percent * len(order) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_features_equal_a_plain_loop(width):
    random.seed(2)
    texts = ["", "A b C", "x" * 1000 + " y" + "z" * 300, "é_ß 12ab-Ç!", *(" ".join(random.choice(["Ab", "c", "é", "!", "12"]) for _ in range(9)) for _ in range(50))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    doc, bucket, words = feature_buckets(data, offsets, width, 1000)
    for i, text in enumerate(texts):
        own, want = features(text, width)
        assert words[i] == len(own)
        assert sorted(bucket[doc == i].tolist()) == sorted(zlib.crc32(f.encode()) % 1000 for f in want)


def test_checksums_of_slices():
    data = np.frombuffer(bytes(range(256)) * 4, np.uint8)
    starts, ends = np.array([0, 5, 9, 100, 7]), np.array([0, 6, 20, 1000, 263])
    got = crc_slices(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]


def test_edge_texts_equal_brute_force(spark, edge_docs, no_docs, edge_texts):
    target = spark.createDataFrame([("p1 p2 p3 p4 p5",), (None,), ("same text for several rows",)], "text string")
    plain = [(i, t) for i, t, _ in edge_texts]
    for percent, least in ((25, 20), (100, 0), (0, 5)):
        got = resample(edge_docs, target, percent=percent, least_words=least)
        assert sorted(map(tuple, got.collect()), key=str) == brute(plain, [r.text for r in target.collect()], percent, least=least)
    got = resample(edge_docs, target.limit(0), width=3, buckets=50)
    assert sorted(map(tuple, got.collect()), key=str) == brute(plain, [], size=50, width=3)
    assert resample(no_docs, target).count() == 0


def test_given_documents_equal_brute_force_in_any_partitions(spark):
    docs, target = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    for parts in (1, 13):
        assert sorted(map(tuple, resample(docs.repartition(parts), target).collect()), key=str) == want


def test_ranks_are_exact_where_a_score_holds_a_third_of_all_rows(spark, monkeypatch):
    random.seed(12)
    scores = [random.randrange(-500, 500) for _ in range(4000)] + [77] * 2000
    rows = [(k % 3000 if k % 11 else None, s, "x") for k, s in enumerate(scores)]
    monkeypatch.setattr(module, "SAMPLES", 200)
    table = saved(spark.createDataFrame(rows, "doc_id long, score long, segment string").repartition(20), "test-scores")
    for drawn in (0, 1, 1500, 5999, 6000):
        found = ranked(table, "score", "doc_id", drawn)
        got = sorted((r for r in found.collect() if r.rank is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, drawn + 1)) and found.count() == 6000
        order = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
        assert [(r.doc_id, r.score) for r in got] == [(i, s) for i, s, _ in order[:drawn]]
    largest = ranked(table, "score", "doc_id", 6000).where("rank IS NOT NULL").selectExpr("spark_partition_id() p").groupBy("p").count().agg({"count": "max"}).first()[0]
    assert largest <= 2 * 6000 / 10  # ten runs; the 2,000 equal scores are split
    assert "SinglePartition" not in plan_of(ranked(table, "score", "doc_id", 1500))

import collections
import math
import re
import zlib

import numpy as np
import pytest

from bucketwise.llm import katz, toxicity
from bucketwise.llm.quality import quality_rules, with_rules_applied
from bucketwise.llm.ragged import hash_slices
from bucketwise.llm.registry import QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import COLUMNS, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_figures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
            len(w) < 10 or 100 * len(again) > 20 * len(w))


def test_base_rules(edge_docs, no_docs, edge_texts):
    got = [tuple(r) for r in quality_rules(edge_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                             "n_repeat_words", "base_failed").collect()]
    assert sorted(got, key=str) == sorted(((i, *base_figures(t)) for i, t, _ in edge_texts), key=str)
    assert quality_rules(no_docs).count() == 0 and with_rules_applied(no_docs).count() == 0
    assert with_rules_applied(edge_docs).columns == edge_docs.columns


def test_frequent_lines(spark):
    """Brute force of the rule for lines on a host with boilerplate, and one without."""
    boiler = "Subscribe to our newsletter for more"
    texts = [(i, f"{boiler}\n" + " ".join(f"w{i}x{k}" for k in range(30)), "shop") for i in range(20)]
    texts += [(50 + i, f"{boiler.upper()}\nSubscribe  to our newsletter for more\nonly {i} more words than that", "shop") for i in range(5)]
    texts += [(100 + i, "The same long text is copied by everybody\nhere and it stays as it is for all of us", "blog") for i in range(30)]
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(got[i].kept for i in range(20)) and got[0].removed_words == 0 and got[1].removed_words == 6
    assert all(not got[i].kept and not got[i].base_failed for i in range(50, 55))
    assert all(got[i].kept for i in range(100, 130))  # exact copies are one text
    kept = {r.doc_id: r.text for r in with_rules_applied(df).collect()}
    assert kept[0] == texts[0][1] and kept[3] == texts[3][1].split("\n")[1] and 50 not in kept and len(kept) == 50


def test_lines_above_the_limits_on_a_large_host(spark):
    """A line in 7 % of a host goes, as does one above the absolute limit; near copies leave their lines to the first."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    some, few = "Follow us for more of this", "this line is not frequent"
    texts = [(i, (f"{some}\n" if i % 14 == 3 else f"{few}\n" if i % 22 == 4 else "") + own(i), "news") for i in range(200)]
    near = "\n".join(" ".join(f"r{k}c{j}" for j in range(9)) for k in range(5))
    texts += [(300 + i, f"{near}\nlast row of copy {i}", "news") for i in range(15)]
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    holders = [i for i in range(200) if i % 14 == 3]
    assert len(holders) == 15 and sum(i % 22 == 4 and i % 14 != 3 for i in range(200)) == 9
    assert {i for i in range(200) if got[i].removed_words} == set(holders[1:]) and {got[i].removed_words for i in holders[1:]} == {6}
    assert all(got[i].kept for i in range(200)) and got[300].kept and got[300].removed_words == 0
    assert all(not got[i].kept and not got[i].base_failed and got[i].removed_words == 45 for i in range(301, 315))
    left = {r.doc_id: r.text for r in with_rules_applied(df).collect()}
    assert all(left[i] == own(i) for i in holders[1:]) and left[3] == texts[3][1] and left[300] == texts[200][1]
    loose = {r.doc_id: r.removed_words for r in quality_rules(df, line_share=0.5, line_many=14).collect()}
    assert {i for i in range(200) if loose[i]} == set(holders[1:])
    assert not any(r.removed_words for r in quality_rules(df, line_share=0.5, line_many=15).collect())


def brute_model(docs, least):
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), "</s> "] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    one, two, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in tokens.items():
        if not held[d]:
            before = ["<s> ", *t[:-1]]
            one.update(t)
            two.update(zip(before, t, strict=True))
            hist.update(before)
    n1, n2 = collections.Counter(one.values()), collections.Counter(two.values())
    n, v = sum(one.values()), len(one)
    model = katz.make_model({r: n1[r] for r in range(1, 7)}, {r: n2[r] for r in range(1, 7)}, n, v, one["</s> "], least)
    seen = collections.defaultdict(dict)
    for (h, w), c in two.items():
        if c >= least:
            seen[h][w] = c

    def word(w):
        return float(model.word_mass(np.array(one[w])))

    def pair(w, h):
        own = seen.get(h, {})
        used = sum(model.pairs[min(c, 6)] * c for c in own.values()) / hist[h] if own else 0
        shrink = hist[h] / (hist[h] + 1) if own and 1 - used < katz.TINY else 1
        if w in own:
            return shrink * model.pairs[min(own[w], 6)] * own[w] / hist[h]
        return (1 - shrink * used) / (1 - sum(map(word, own))) * word(w)

    for h in ["<s> ", *list(seen)[:3]]:
        assert math.isclose(sum(pair(w, h) for w in one) + pair("never seen ", h), 1, rel_tol=1e-9)
    return {d: (held[d], len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + .5) / (n + .5 * (v + 1))) for w in t),
                sum(math.log10(pair(w, h)) for h, w in zip(["<s> ", *t[:-1]], t, strict=True))) for d, t in tokens.items()}


@pytest.mark.parametrize("least", [1, 2])
def test_katz_against_recursion(spark, least):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    want = brute_model({r.doc_id: r.text for r in docs.collect()}, least)
    got = (katz.score_texts(docs) if least == 1 else katz.score_texts(docs, least_pairs=least)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert np.isclose(r.base_score, want[r.doc_id][4], rtol=1e-12) and np.isclose(r.score, want[r.doc_id][5], rtol=1e-6)


def test_registered_scores_know_pairs_seen_once(spark, tmp_path):
    """Plain Katz with every pair of the training texts: a held-out copy of one training text gets credit for its pairs."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").collect()}
    copy, source = next(i for i in range(1000, 1100) if fold(i)), next(i for i in docs if not fold(i) and docs[i])
    docs[copy] = docs[source]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows_of([(i, t, "s") for i, t in docs.items()]), COLUMNS).write.parquet(f"{folder}/documents.parquet")
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), "</s> "] for d, t in docs.items()}
    pairs = {d: list(zip(["<s> ", *t[:-1]], t, strict=True)) for d, t in tokens.items()}
    one = collections.Counter(w for d, t in tokens.items() if not fold(d) for w in t)
    two = collections.Counter(p for d, t in pairs.items() if not fold(d) for p in t)
    hist, after = collections.Counter(), collections.defaultdict(dict)
    for (h, w), c in two.items():
        hist[h] += c
        after[h][w] = c
    n = sum(one.values())

    def factors(counts):
        k = collections.Counter(counts)
        common = 6 * k[6] / k[1]
        d = {r: ((r + 1) * k[r + 1] / (r * k[r]) - common) / (1 - common) for r in range(1, 6)}
        return {r: x if 0 < x <= 1 else 1.0 for r, x in d.items()}

    d1, d2 = factors(one.values()), factors(two.values())
    assert d2[1] < 1 and any(two[p] == 1 for p in pairs[copy])
    unknown = 1 - sum(d1.get(c, 1.0) * c for c in one.values()) / n
    word = lambda w: d1.get(one[w], 1.0) * one[w] / n if one[w] else unknown

    def pair(h, w):
        own = after.get(h, {})
        used = sum(d2.get(c, 1.0) * c for c in own.values()) / hist[h] if own else 0
        shrink = hist[h] / (hist[h] + 1) if own and 1 - used < 1e-9 else 1
        return shrink * d2.get(own[w], 1.0) * own[w] / hist[h] if w in own else (1 - shrink * used) / (1 - sum(map(word, own))) * word(w)

    got = {r.doc_id: r.score for r in QUERIES["op9_katz_scores"](spark, folder).collect()}
    assert got.keys() == docs.keys() and math.isclose(got[copy], got[source], rel_tol=1e-6)
    for d, t in pairs.items():
        assert math.isclose(got[d], sum(math.log10(pair(h, w)) for h, w in t), rel_tol=1e-6)


def test_katz_edge_cases(edge_docs, no_docs, edge_texts):
    got = katz.score_texts(edge_docs).collect()
    assert len(got) == len(edge_texts) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert next(r for r in got if r.doc_id == 1).n_tokens == 1
    assert katz.score_texts(no_docs).count() == 0
    only_held = edge_docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in katz.score_texts(only_held).collect())


def test_good_turing_factors():
    assert katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}, 1)[1] < 1
    assert (katz.discounts({}, 1) == 1).all() and (katz.discounts({1: 3, 5: 2}, 2) == 1).all()


def test_toxicity_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, y = scored.score.rank(), scored.toxic == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.85 and ((scored.score >= 0.7) == (scored.predicted == 1)).all() and scored.score.between(0, 1).all()


def test_toxicity_edge_cases(spark, edge_docs, no_docs, edge_texts):
    labels = spark.createDataFrame([(i, 1, i % 2 if i % 7 else None, "x") for i in range(40)] + [(None, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    got = toxicity.score_documents(edge_docs, labels).collect()
    assert len(got) == len(edge_texts) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(no_docs, labels).count() == 0
    none = toxicity.score_documents(edge_docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_risk_is_corrected(seed):
    """Unlabelled rows hold a third of toxic ones; the decision still separates them."""
    rng = np.random.default_rng(seed)
    noise = lambda: rng.integers(1000, 5000, 20, dtype=np.uint64)
    toxic = [np.unique(np.append(noise(), rng.choice(8, 3, replace=False).astype(np.uint64))) for _ in range(200)]
    hidden = [np.unique(np.append(noise(), rng.choice(8, 3, replace=False).astype(np.uint64))) for _ in range(100)]
    clean = [np.unique(noise()) for _ in range(900)]
    kept, weights, intercepts = toxicity.train(toxic, hidden[:50] + clean[:450], 0.1, steps=200)

    def score(row):
        return toxicity._sigmoid(weights.mean(0)[np.searchsorted(kept, row[np.isin(row, kept)])].sum() + intercepts.mean())

    assert np.mean([score(r) >= 0.7 for r in hidden[50:]]) > 0.9 and np.mean([score(r) < 0.7 for r in clean[450:]]) > 0.97


def plain_training(toxic, unlabelled, prior, steps, rate=0.1, shrink=1e-4):
    """The non-negative risk and its gradient with plain loops; the same draws of rows."""
    inside, outside = collections.Counter(), collections.Counter()
    for row in toxic:
        inside.update(row.tolist())
    for row in unlabelled:
        outside.update(row.tolist())
    kept = sorted(f for f, c in inside.items() if c >= max(toxicity.MIN_TEXTS, toxicity.MIN_SHARE * len(toxic))
                  and (c + .5) / (len(toxic) + 1) / ((outside[f] + .5) / (len(unlabelled) + 1)) >= toxicity.LIFT)
    place = {f: i for i, f in enumerate(kept)}
    toxic, unlabelled = ([[place[f] for f in row.tolist() if f in place] for row in rows] for rows in (toxic, unlabelled))
    models, risks = [], []
    for c in range(toxicity.CLASSIFIERS):
        random = np.random.default_rng(c)
        theta = [0.0] * len(kept) + [math.log(prior / (1 - prior))]
        first, second = [0.0] * len(theta), [0.0] * len(theta)
        value = lambda row: sum(theta[f] for f in row) + theta[-1]  # noqa: E731, B023

        def mean_loss(rows, sign):
            loss, slope = 0.0, [0.0] * len(theta)  # noqa: B023
            for row in rows:
                f = value(row)  # noqa: B023
                loss += math.log1p(math.exp(-sign * f)) / len(rows)
                d = -sign / (1 + math.exp(sign * f)) / len(rows)
                for k in [*row, len(theta) - 1]:  # noqa: B023
                    slope[k] += d
            return loss, slope

        for step in range(1, steps + 1):
            p = [toxic[i] for i in random.integers(len(toxic), size=min(1024, 2 * len(toxic)))]
            u = [unlabelled[i] for i in random.integers(len(unlabelled), size=min(1024, 2 * len(unlabelled)))]
            (_, up), (risk_p, down), (risk_u, all_down) = mean_loss(p, 1), mean_loss(p, -1), mean_loss(u, -1)
            positive = risk_u >= prior * risk_p
            risks.append(positive)
            grad = [prior * a + (b - prior * d) if positive else prior * d - b for a, b, d in zip(up, all_down, down, strict=True)]
            for k in range(len(theta)):
                g = grad[k] + (shrink * theta[k] if k < len(kept) else 0)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                theta[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (math.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                if k < len(kept):
                    theta[k] = max(theta[k], 0.0)
        models.append(theta)
    mean = lambda row: sum(sum(t[f] for f in row) + t[-1] for t in models) / len(models)
    yes, no = [mean(r) for r in toxic], [mean(r) for r in unlabelled]
    low, high = min(yes + no), max(yes + no)
    tried = []
    for k in range(1001):
        at = low + (high - low) * k / 1000
        missed, accused = sum(v < at for v in yes) / len(yes), sum(v >= at for v in no) / len(no)
        tried.append((prior * missed + max(0.0, accused - prior * (1 - missed)), at))
    best = [at for risk, at in tried if risk <= min(tried)[0] + 0.005 * prior]
    limit = sum(best) / len(best)
    score = lambda row: 2 * (mean([place[f] for f in row.tolist() if f in place]) - limit) + math.log(0.7 / 0.3)
    return kept, score, risks


def test_training_equals_plain_loops():
    rng = np.random.default_rng(5)
    noise = lambda: rng.integers(1000, 3000, 8, dtype=np.uint64)
    toxic = [np.unique(np.append(noise(), rng.choice(6, 3, replace=False).astype(np.uint64))) for _ in range(40)]
    others = [np.unique(np.append(noise(), rng.choice(6, int(rng.random() < 0.15), replace=False).astype(np.uint64))) for _ in range(80)]
    for steps, prior in ((1, 0.2), (6, 0.1), (25, 0.6)):
        want_kept, want, risks = plain_training(toxic, others, prior, steps)
        kept, weights, intercepts = toxicity.train(toxic, others, prior, steps=steps)
        assert kept.tolist() == want_kept
        got = lambda row: weights.mean(0)[np.searchsorted(kept, row[np.isin(row, kept)])].sum() + intercepts.mean()  # noqa: E731, B023
        for row in [*toxic[:10], *others[:10]]:
            assert math.isclose(got(row), want(row), rel_tol=1e-6, abs_tol=1e-6)
    assert not all(risks)  # the corrected risk was negative in some steps


def test_scores_of_texts_equal_a_plain_sum(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept, weights, intercepts = toxicity.learn(docs, labels)
    weight = dict(zip(kept.tolist(), weights.mean(0).tolist(), strict=True))
    assert kept.size
    for r in toxicity.score_documents(docs, labels).join(docs, "doc_id").collect():
        data = np.frombuffer((r.text or "").translate(LOWER).encode(), np.uint8)
        found = set()
        for word in re.finditer(rb"[^\x20\x09-\x0D]+", data.tobytes()):
            a, b = np.array([word.start()]), np.array([word.end()])
            found.add(int(hash_slices(data, a, b, 20)[0]))
            found.update(int(hash_slices(data, a, np.minimum(b, a + n), 20 + n)[0]) for n in toxicity.BEGINNINGS)
        value = sum(weight.get(f, 0.0) for f in found) + intercepts.mean()
        assert math.isclose(r.score, 1 / (1 + math.exp(-value)), rel_tol=1e-9, abs_tol=1e-12)
        assert r.predicted == (r.score >= 0.7)

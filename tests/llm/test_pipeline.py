import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bucketwise.llm.graph import saved
from tests.conftest import SMALL
from tests.llm.test_dedup import brute_components, removed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INSULTS = "pathetic clown worthless scum moron idiot disgusting trash loser stupid".split()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The given documents with near copies, a shared passage, a frequent line and toxic texts among them."""
    random.seed(31)
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in given.collect()]
    plain = [r for r in rows if r[1] and len(WORD.findall(r[1])) > 60]
    vocabulary = sorted({w for r in plain for w in WORD.findall(r[1])})
    fresh = lambda n: [random.choice(vocabulary) for _ in range(n)]
    made, labels = {}, [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    for k in range(15):  # near copies
        words = WORD.findall(random.choice(plain)[1])[:120]
        words[len(words) // 2] = f"changed{k}"
        made[5000 + k] = " ".join(words)
    passage = fresh(60)
    for k in range(8):
        made[5100 + k] = " ".join(fresh(40) + passage + fresh(40))
    for k in range(30):  # in a source of its own
        made[5200 + k] = " ".join(fresh(30)) + "\nAll rights  reserved by nobody\n" + " ".join(fresh(30))
    for k in range(30):
        words = fresh(50)
        for _ in range(9):
            words[random.randrange(50)] = random.choice(INSULTS)
        made[5300 + k] = " ".join(words)
        if k < 24:
            labels.append((5300 + k, 1, 1))
    for k in range(250):
        made[5600 + k] = " ".join(fresh(50))
        labels.append((5600 + k, 1, 0))
    made[5400], made[5401], made[5402] = None, "", "too short"
    rows += [(i, t, "en", "lined" if 5200 <= i < 5300 else "web") for i, t in made.items()]
    folder = tmp_path_factory.mktemp("planted")
    table = [(i, t, g, s, None if t is None else len(t), "x", "y") for i, t, g, s in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, row string, given string")
    docs.repartition(5).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def words_of(text):
    return WORD.findall(text or "")


def plain_quality(docs):
    """doc_id -> text of what the rules keep; docs: doc_id -> (text, source)."""
    def failed(words):
        windows = collections.defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i:i + 5])].append(i)
        repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        return len(words) < 10 or 100 * len(repeated) > 20 * len(words)

    texts, holders = collections.defaultdict(set), collections.defaultdict(dict)
    key = lambda line: tuple(words_of(line.translate(LOWER)))
    for i, (text, source) in sorted(docs.items()):
        texts[source].add(text)
        for line in (text or "").split("\n"):
            if key(line):
                holders[source, key(line)].setdefault(text, i)
    gone = {k: min(v.values()) for k, v in holders.items()
            if len(v) >= 10 and (len(v) > 0.01 * len(texts[k[0]]) or len(v) > 1000)}
    out = {}
    for i, (text, source) in docs.items():
        kept = [line for line in re.findall(r"[^\n]*\n|[^\n]+", text or "") if gone.get((source, key(line)), i) == i]
        left, words = len(words_of("".join(kept))), words_of(text)
        lost = len(words) - left
        once = sum(len(key(line)) for line in {key(x): x for x in (text or "").split("\n") if key(x)}.values()
                   if gone.get((source, key(line)), i) != i)
        assert lost >= once
        if not failed(words) and left >= 10 and left >= 0.3 * len(words):
            out[i] = "".join(kept)
    return out


def test_every_stage_against_plain_python(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, tokens = docs.columns, Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before, stages = rows(docs), dict(corpus_pipeline.STAGES)

    docs = saved(stages["quality_rules"](spark, docs, planted), "q")
    after = rows(docs)
    assert docs.columns == columns
    want = plain_quality({i: (r.text, r.source) for i, r in before.items()})
    assert {i: r.text for i, r in after.items()} == want and 5400 not in after and 5402 not in after
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert [i for i, t in want.items() if "All rights" in t and i >= 5200] == [5200]
    others = [c for c in columns if c not in ("text", "n_chars")]
    assert all([r[c] for c in others] == [before[i][c] for c in others] for i, r in after.items())

    before = after
    docs = saved(stages["toxicity"](spark, docs, planted), "t")
    after = rows(docs)
    assert docs.columns == columns and all(after[i] == before[i] for i in after)
    toxic = [i for i in before if 5300 <= i < 5330]
    clean = [i for i, r in before.items() if not set(words_of(r.text.lower())) & set(INSULTS)]
    assert sum(i in after for i in toxic) <= 0.1 * len(toxic) and sum(i in after for i in clean) >= 0.97 * len(clean)
    assert sum(i in after for i in range(5324, 5330)) <= 1  # without a label

    before = after
    docs = saved(stages["minhash_near_dedup"](spark, docs, planted), "n")
    after = rows(docs)
    groups = brute_components({i: r.text for i, r in before.items()}, 5, 80)
    assert docs.columns == columns and after == {i: r for i, r in before.items() if groups[i][2]}
    assert len(before) - len(after) >= 10

    before = after
    docs = saved(stages["substring_dedup"](spark, docs, planted), "s")
    after = rows(docs)
    want = removed_words({i: r.text for i, r in before.items()}, 50)
    assert docs.columns == columns and after.keys() == before.keys()
    for i, r in after.items():
        kept = words_of(r.text)
        assert (len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) == (want[i][0] - want[i][1], want[i][2])
        assert r.n_chars == len(r.text) and (want[i][1] or r.text == before[i].text)
    assert sum(want[i][1] >= 60 for i in range(5100, 5108)) == 7

    pieces = stages["packing"](spark, docs, planted).collect()
    whole, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        whole[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length))
    for i, r in after.items():
        n = len(tokens.encode(r.text, add_special_tokens=False).ids) + 1
        ends = np.cumsum([0, *(length for _, length in sorted(whole[i]))])
        assert ends[-1] == n and [s for s, _ in sorted(whole[i])] == ends[:-1].tolist()
    assert whole.keys() == after.keys() and all(sum(n for _, n in w) <= 1024 for w in windows.values())


def test_stages_keep_columns_and_only_predecessors(spark, edge_docs, tmp_path):
    """Nulls in any column, repeated ids and rows, empty and long texts, clashing names, and empty tables."""
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert after.columns == docs.columns, name
            assert after.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty(), name
        docs = after
    assert docs.count() > 0
    empty = edge_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_names_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "minhash_near_dedup", "substring_dedup", "packing"]


def test_run_over_a_given_table(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packed.collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in documents.select("doc_id").collect()}
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in rows)

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as public
from tokenizers import Tokenizer

from bucketwise.llm import ragged, transduce
from bucketwise.llm.transduce import TextDecoder, TextEncoder, Transducer, block_digests, decoded_blocks, document_digests, is_valid, token_blocks

JSON = public.path("byte_bpe_50k.json")
BITS = [*"abs'tredlvm  \n\t12é¼Ⅷ好!?.,-_", "'s", "'re", "'ll", " '", "<|endoftext|>", "<|endof", "\xa0", "\x1c", "́", "aaaa", "  \n", "the ", "ing"]


@pytest.fixture(scope="module")
def rules():
    return Transducer(JSON)


def long_texts():
    random.seed(6)
    made = ["".join(random.choice(BITS) * random.randrange(1, 60) for _ in range(40)) for _ in range(60)]
    return ["a" * 5000 + "b " * 10, "'" * 3000 + "s x", " " * 2000 + "x", "\n" * 900 + "'re", "好" * 700 + "é" * 300, "ab" * 800,
            "!" * 700 + "'ll" + "<|endoftext|>" * 3 + "?" * 800 + "<|endof" + "z" * 900, "1" * 1500 + " " + "the" * 900, *made]


def test_whole_texts_equal_the_library(rules):
    random.seed(5)
    library = Tokenizer.from_file(JSON)
    texts = ["", "a" * 3000, "<|endoftext|><|endoftext|>x", *("".join(random.choice(BITS) for _ in range(random.randrange(60))) for _ in range(2500)),
             *long_texts()]
    ids, at = rules.encode(*ragged.text_bytes(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("size", [7, 61, 700])
def test_any_portions_give_the_same_tokens_in_constant_memory(rules, size, monkeypatch):
    monkeypatch.setattr(transduce, "LONG", 64)
    library = Tokenizer.from_file(JSON)
    for text in long_texts():
        encoder, raw, got, at = TextEncoder(rules), text.encode(), [], 0
        while at < len(raw):
            to = min(at + size, len(raw))
            while to < len(raw) and raw[to] & 0xC0 == 0x80:
                to += 1
            got += encoder.feed(raw[at:to], to == len(raw)).tolist()
            at = to
            assert len(encoder.tail) <= size + 200 and (not encoder.open or len(encoder.open.window) <= rules.lookahead + 128)
        assert got == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_tokens_a_lookahead_before_the_end_are_final(rules):
    """Whatever follows a text, its tokens that end a sufficient lookahead before its end stay."""
    random.seed(8)
    letters = ["a", "b", "th", "e", "ing", "é", "好", "tion", "qu"]
    for _ in range(150):
        text = "".join(random.choice(letters) for _ in range(150))
        raw = text.encode()
        alone, _ = rules.encode(*ragged.text_bytes(pa.array([text])))
        ends = np.cumsum(rules.size[alone])
        stable = alone[ends <= len(raw) - rules.lookahead].tolist()
        for _ in range(3):
            more, _ = rules.encode(*ragged.text_bytes(pa.array([text + "".join(random.choice(letters) for _ in range(20))])))
            assert more[:len(stable)].tolist() == stable


def test_decoder_replaces_broken_sequences_like_lossy_decoders():
    random.seed(3)
    odd = [0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE5, 0xA5, 0xBD]
    for _ in range(4000):
        raw = bytes(random.choice(odd) for _ in range(random.randrange(12)))
        decoder, out, at = TextDecoder(), b"", 0
        while at < len(raw):
            to = at + random.randrange(1, 4)
            out += decoder.feed(raw[at:to], False)
            at = to
        out += decoder.feed(b"", True)
        assert out.decode() == raw.decode("utf-8", "replace")
        assert is_valid(np.frombuffer(raw, np.uint8)) == (raw.decode("utf-8", "replace").encode() == raw)


def test_documents_and_blocks(spark, edge_docs, no_docs, edge_texts, monkeypatch):
    monkeypatch.setattr(transduce, "CHUNK_BYTES", 1000)  # long texts come in several blocks
    library = Tokenizer.from_file(JSON)
    want = []
    for i, text, _ in edge_texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    blocks = token_blocks(edge_docs)
    assert blocks.where("NOT first").count() > 10
    assert sorted(map(tuple, block_digests(blocks).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, document_digests(edge_docs).collect()), key=str) == sorted(want, key=str)
    texts = {}
    for r in decoded_blocks(blocks).collect():
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.text
    assert {i: t for i, t in texts.items() if i != 10} == {i: t or "" for i, t, _ in edge_texts if i != 10}
    assert block_digests(token_blocks(no_docs)).count() == 0


def test_merge_lists_that_are_no_tree_of_tokens_are_refused(tmp_path):
    import json
    spec = json.load(open(JSON, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][:50][::-1]
    path = tmp_path / "bad.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Transducer(str(path))

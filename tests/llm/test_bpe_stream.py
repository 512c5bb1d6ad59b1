"""Streaming byte-pair encoding against the tokenizer library and plain merging."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from starloom.llm import bpe_stream as S  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aab '’sStmdrevlÉß€…İΣſ\n\t   \u0085\x1c\x0012٣½é漢字🎉#!_-ǅ​́<|endoftext|>"


def texts():
    r = random.Random(13)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(500)]
    long = ["".join(r.choice("etaoinshr") for _ in range(9000)), "a" * 20000, "é" * 7000, "!?" * 4000, "漢" * 3000, "ab c" * 4000]
    return out + long + ["a<|endoftext|><|startoftext|> b", "<|endoftext|", " ", "", "Don'T 'RE we'll", "é x́"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_equal_to_the_library(path):
    vocab, tok = S.Vocabulary(path), Tokenizer.from_file(path)
    decoder, some = S.Decoder(vocab), texts()
    ids, at = vocab.ids(pa.array(some))
    for i, want in enumerate(tok.encode_batch(some, add_special_tokens=False)):
        got = ids[at[i]:at[i + 1]]
        assert got.tolist() == want.ids, some[i][:60]
        assert "".join(decoder.parts(got)) == tok.decode(want.ids, skip_special_tokens=False)
    cut = np.random.default_rng(1).integers(0, 50257, 3000)  # broken sequences of bytes
    assert "".join(decoder.parts(cut)) == tok.decode(cut.tolist(), skip_special_tokens=False)


def plain_merge(rules, word):
    rank = {(a, b): (i, p) for i, (a, b, p) in enumerate(rules)}
    word = [(x, 1) for x in word]
    while True:
        best = min(((rank[(a[0], b[0])], i) for i, (a, b) in enumerate(zip(word, word[1:])) if (a[0], b[0]) in rank), default=None)
        if best is None:
            return word
        (_, product), i = best
        word[i:i + 2] = [(product, word[i][1] + word[i + 1][1])]


@st.composite
def rule_lists(draw):
    """Proper merge lists over three letters: products are made once, before use."""
    tokens, rules, spelt = [0, 1, 2], [], {0: "a", 1: "b", 2: "c"}
    for _ in range(draw(st.integers(1, 14))):
        a, b = draw(st.sampled_from(tokens)), draw(st.sampled_from(tokens))
        if spelt[a] + spelt[b] not in spelt.values():
            new = len(tokens)
            tokens.append(new)
            spelt[new] = spelt[a] + spelt[b]
            rules.append((a, b, new))
    return rules, {t: len(x) for t, x in spelt.items()}


@settings(max_examples=300, deadline=None)
@given(rule_lists(), st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=12))
def test_lookahead_is_sufficient(made, word, more):
    rules, length = made
    ahead = S.Lookahead(rules, length).size
    short, whole = plain_merge(rules, word), plain_merge(rules, word + more)
    done = 0
    for k, (token, size) in enumerate(short):
        done += size
        if done > len(word) - ahead:
            break
        assert whole[k] == (token, size)
    merges = S.Merges(rules)
    assert merges.merge(word + more) == whole
    row = np.array([word + more + [-1]])
    assert merges.lock_step(row)[0].tolist()[:len(whole)] == [t for t, _ in whole]


def test_improper_lists_have_no_lookahead():
    assert S.Lookahead([(3, 0, 4), (0, 1, 3)], {0: 1, 1: 1, 3: 2, 4: 3}).size is None   # used before it is made
    assert S.Lookahead([(0, 1, 3), (1, 0, 4), (3, 0, 5), (0, 4, 5)], {0: 1, 1: 1, 3: 2, 4: 2, 5: 3}).size is None  # made twice


def test_constant_memory_and_any_portions():
    vocab = S.Vocabulary(WORD)
    r = random.Random(3)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(40_000)).encode()
    want = [t.id for t in vocab.tok.model.tokenize(word.decode())]
    for step in (1, 777, 10 ** 6):
        coder, got, most = S.Encoder(vocab), [], 0
        for k in range(0, len(word), step):
            got += coder.feed(word[k:k + step])
            most = max(most, len(coder.held))
        assert most <= 4 * vocab.lookahead + S.WIDE
        assert got + list(coder.end()) == want


def test_utf8_machine_in_any_portions():
    r = random.Random(4)
    for _ in range(300):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x8E, 0x89, 0xED, 0xA0, 0xC0, 0xF5, 0xE0, 0x80]) for _ in range(r.randint(0, 12)))
        machine, out = S.Utf8(), ""
        k = 0
        while k < len(data):
            n = r.randint(1, 3)
            out += machine.feed(data[k:k + n])
            k += n
        assert out + machine.end() == data.decode(errors="replace")


def test_operator_and_query_digests(spark):
    some = texts()[:80] + [None, "", "x" * 5000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(some)] + [(None, "no id", "c", 2), (3, "twice", "c", 3), (3, "twice", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = S.decode(S.encode(docs, WORD), WORD).collect()
    tok = Tokenizer.from_file(WORD)
    want = sorted((str(r[0]), ids := tok.encode(r[1] or "", add_special_tokens=False).ids, tok.decode(ids, skip_special_tokens=False)) for r in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == want
    assert S.encode(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        S.encode(docs, WORD, keep=("doc_id", "ids"))


def test_query_equals_the_library(spark):
    from starloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(WORD)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_bpe_round_trip"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))

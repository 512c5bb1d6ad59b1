"""Token counts and packing against the tokenizer library and plain versions."""
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from starloom.llm import packing, token_counts  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aab '’sStmdrevlÉß€…İΣſ\n\t   \u0085\x1c\x0012٣½é漢字🎉#!_-ǅ\u200b<|endoftext|>"


def odd_texts(n=600):
    r = random.Random(5)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return out + ["x'll we've 'S's''s DON'T", "<|endoftext|>", "a<|endoftext|> b", " <|endoftext|>\n\n", "a" * 3000, "é" * 500,
                  " " * 300 + "a", "the" * 400, "\n\n\n", "ab " * 50, "", "a<|startoftext|> b", "ſ ı ŉ ĳ"]


def docs_frame(spark, texts):
    rows = [(i, t, "clash", 1.0, 0) for i, t in enumerate(texts)] + [(None, "no id", "x", 0.0, 0), (7, None, "x", 0.0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length double, sequence_id int")


def test_counts_equal_the_library(spark):
    texts = odd_texts()
    want = Counter((i, len(t.encode()), len(x.ids)) for i, (t, x) in enumerate(zip(texts, Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False))))
    want += Counter({(None, 5, len(Tokenizer.from_file(BYTE).encode("no id").ids)): 1, (7, 0, 0): 1})
    got = token_counts.count_tokens(docs_frame(spark, texts), BYTE, limit=10).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)


def test_chunk_maps_equal_one_pass():
    r = np.random.default_rng(0)
    sym = r.integers(0, 9, 5000).astype(np.uint8)
    state, want = 0, []
    for c in sym:
        want.append(bool(token_counts.EMIT[c, state]))
        state = token_counts.GO[c, state]
    assert token_counts.starts(sym).tolist() == want


def test_machine_restarts_keep_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    texts = odd_texts(100)
    c = token_counts.TokenCounter(BYTE)
    want = [len(x.ids) for x in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [int(c.count([t])[0]) for t in texts] == want


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(docs_frame(spark, []).limit(0), BYTE).count() == 0


def test_ids_equal_the_library():
    tok, texts = packing.tokenizer(WORD), odd_texts() + ["Hello wörld, it's 12 o'clock!"]
    want = [x.ids for x in tok.tok.encode_batch(texts, add_special_tokens=False)]
    ids, at = tok.ids(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == want


def test_pieces_and_sequences(spark):
    texts = ["word " * 11, "", "one two three", "a b c d e f g"] * 5
    cap = packing.Capacity(tokens=8, documents=3, attention=40)
    pieces = packing.token_pieces(docs_frame(spark, texts), WORD, max_tokens=6)
    out = packing.best_fit(pieces, cap).toPandas()
    lib = Tokenizer.from_file(WORD)
    for d, rows in out.dropna(subset=["doc_id"]).groupby("doc_id"):
        if d == 7:
            continue  # two rows share this id
        ids = lib.encode(texts[int(d)], add_special_tokens=False).ids + [1]
        for r in rows.itertuples():
            part = ids[r.start:r.start + r.length]
            assert len(part) == r.length and r.start == 6 * r.piece
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert rows.length.sum() == len(ids)
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.length.cumsum() - rows.length).tolist() == rows.offset.tolist()
        assert rows.length.sum() <= 8 and len(rows) <= 3 and (rows.length ** 2).sum() <= 40
    assert len(out) == pieces.count()


def plain_best_fit(sizes, cap):
    """One list of items, one list of bins."""
    full, w = cap.vector(), np.array(cap.weights)
    bins = []
    for s in sorted(sizes, reverse=True):
        need = np.array([s, 1, s * s])
        fit = [b for b in bins if (b >= need).all()]
        if cap.rule == "dot":
            best = max(fit, key=lambda b: float(((b / full) * (need / full) * w).sum()), default=None)
        else:
            best = min(fit, key=lambda b: float((w * ((b - need) / full) ** 2).sum()), default=None)
        if best is None:
            bins.append(best := full.copy())
        best -= need
    return len(bins)


@pytest.mark.parametrize("cap", [packing.Capacity(tokens=50, documents=50, attention=2500), packing.Capacity(tokens=50, documents=4, attention=900),
                                 packing.Capacity(tokens=50, documents=6, attention=2500, rule="dot", weights=(1, 1, 1))])
def test_plan_is_as_tight_as_item_by_item(cap):
    r = random.Random(3)
    for _ in range(20):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 200))]
        plan = packing.make_plan(dict(Counter(sizes)), cap)
        s = np.array(sorted(sizes))
        rank = np.concatenate([np.arange(n) for _, n in sorted(Counter(sizes).items())])
        seq, off = plan.place(s, rank)
        assert len(set(seq.tolist())) == plan.bins
        for b in set(seq.tolist()):
            m = seq == b
            o = np.argsort(off[m])
            assert (np.cumsum(s[m][o]) - s[m][o] == off[m][o]).all()
            assert s[m].sum() <= cap.tokens and m.sum() <= cap.documents and (s[m] ** 2).sum() <= cap.attention
        assert plan.bins <= plain_best_fit(sizes, cap) + 2


def test_packing_an_empty_table(spark):
    assert packing.best_fit(packing.token_pieces(docs_frame(spark, []).limit(0), WORD)).count() == 0


def test_numbering_spans_partitions(spark):
    items = spark.range(0, 500, 1, 7).select("id", (F.col("id") % 5 + 1).alias("length"))
    out = packing.best_fit(items, packing.Capacity(tokens=10, documents=10, attention=100)).toPandas()
    assert len(out) == 500 and out.groupby("sequence_id").length.sum().max() <= 10
    assert out.sequence_id.nunique() == 150  # 1500 tokens, no slack


def test_a_file_with_other_steps_is_left_to_the_library(tmp_path):
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[a-m]+|[^a-m\s]+"
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    tok, texts = packing.WordTokenizer(str(tmp_path / "other.json")), odd_texts(50) + ["lemon lime, banana"]
    ids, at = tok.ids(pa.array(texts))
    assert not tok.by_chunk and [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [x.ids for x in tok.tok.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_refuses_clashing_columns_and_null_sizes(spark):
    with pytest.raises(ValueError):
        packing.best_fit(spark.createDataFrame([(1, 2)], "length long, sequence_id long"))
    with pytest.raises(Exception, match="holds nulls"):
        packing.best_fit(spark.createDataFrame([(1,), (None,)], "length long")).collect()


def test_ids_equal_the_library_on_all_given_texts(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tok = packing.tokenizer(WORD)
    ids, at = tok.ids(pa.array(texts))
    assert all(ids[a:z].tolist() == x.ids for a, z, x in zip(at, at[1:], tok.tok.encode_batch(texts, add_special_tokens=False)))

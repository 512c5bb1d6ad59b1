"""The batched networks against plain forward passes, labelled spans, and rows without an id."""
import random

import numpy as np
from pyspark.sql import functions as F

from starloom.llm import language_id as L
from starloom.llm import quality_cnn as Q
from starloom.llm.common import fold_of

ODD = [b"", b"a", b"ab cd", "né à ß 漢".encode(), bytes(range(256)) * 5, b"x" * 1500, b"word " * 700]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_positions(net, window):
    """Class probabilities of each position of one window, step by step."""
    w, steps = net.w, [window[i:i + L.PATCH].ljust(L.PATCH, b"\0") for i in range(0, len(window), L.PATCH)]
    states = {}
    for d, order in (("f", range(len(steps))), ("b", range(len(steps) - 1, -1, -1))):
        h = np.zeros(L.HIDDEN)
        for t in order:
            a = w["b" + d] + sum(w["E" + d][k][steps[t][k]] for k in range(L.PATCH))
            gates = sigmoid(a[:2 * L.HIDDEN] + h @ w["U" + d])
            z, r = gates[:L.HIDDEN], gates[L.HIDDEN:]
            h = (1 - z) * h + z * np.tanh(a[2 * L.HIDDEN:] + (r * h) @ w["W" + d])
            states[d, t] = h
    out = []
    for t in range(len(steps)):
        s = np.concatenate([states["f", t], states["b", t]]) @ w["V"] + w["c"]
        out.append(np.exp(s - s.max()) / np.exp(s - s.max()).sum())
    return out


def test_language_network_equals_a_plain_pass():
    net = L.Network(["aa", "bb", "cc"], seed=3)
    labels = []
    got = L.classify(net, ODD, labels)
    for text, p, label in zip(ODD, got, labels):
        at = [q for k in range(0, len(text), L.WINDOW) for q in plain_positions(net, text[k:k + L.WINDOW])]
        assert len(label) == len(at) == -(-len(text) // L.PATCH)
        if at:
            assert np.allclose(p, np.mean(at, 0), atol=1e-4)
            clear = [i for i, q in enumerate(at) if np.sort(q)[-1] - np.sort(q)[-2] > 1e-4]
            assert all(label[i] == at[i].argmax() for i in clear)


def plain_logit(net, text):
    """The quality network on one text, position by position."""
    w, maxima = net.w, []
    for k in range(max(1, -(-len(text) // Q.STEP))):
        chunk = text[k * Q.STEP:k * Q.STEP + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        best = np.full(Q.FILTERS, -np.inf)
        for p in range(Q.POSITIONS):
            if p and k * Q.STEP + p * Q.STRIDE >= len(text):
                break
            a = sum(np.concatenate([w["E"][chunk[(p + s) * Q.STRIDE + j]] for j in range(Q.STRIDE)]) @ w["W"][s] for s in range(Q.SPAN))
            best = np.maximum(best, a)
        maxima.append(np.maximum(best + w["b"], 0))
    f = np.concatenate([np.max(maxima, 0), np.mean(maxima, 0)])
    return np.tanh(f @ w["H"] + w["h"]) @ w["o"] + w["c"][0]


def test_quality_network_equals_a_plain_pass():
    net = Q.Network(seed=5)
    assert np.allclose(net.logits(ODD), [plain_logit(net, t) for t in ODD], atol=1e-3)


def test_spans_of_a_text_in_two_languages(spark):
    r = random.Random(3)
    say = {"aa": "kala mana tavu rilo", "bb": "schtrom pflug ngrik bzst"}
    talk = lambda c, n: " ".join(r.choice(say[c].split()) for _ in range(n))
    df = spark.createDataFrame([(i, talk(c, 60), c) for i in range(120) for c in [r.choice(list(say))]], "doc_id long, text string, lang string")
    net = L.fit(df, L.Settings(steps=120))
    first, second = talk("aa", 150), " " + talk("bb", 150)
    odd = spark.createDataFrame([(1, first + second), (2, None), (3, "12 !"), (4, first)], "doc_id long, text string")
    got = {x.doc_id: x for x in L.predict(odd, net, with_spans=True).collect()}
    cover = got[1].spans
    assert cover[0].first == 0 and cover[-1].last == len(first + second) and all(a.last == b.first for a, b in zip(cover, cover[1:]))
    share = lambda lang, lo, hi: sum(max(0, min(s.last, hi) - max(s.first, lo)) for s in cover if s.lang == lang) / (hi - lo)
    assert share("aa", 0, len(first)) > .9 and share("bb", len(first), len(first + second)) > .9
    assert got[2].spans == got[3].spans == [] and max(got[4].spans, key=lambda s: s.last - s.first).lang == "aa"
    assert "spans" not in L.predict(odd, net).columns


def test_rows_without_an_id_are_in_no_fold(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in df.orderBy("doc_id").select((fold_of(F.col("doc_id"), 5) == 0)).collect()][0] is None

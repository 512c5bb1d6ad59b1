"""Source divergence against plain counting with Python integers."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows, min_docs=10, top=10):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    docs, times = Counter(), defaultdict(Counter)
    for t, lang, source in rows:
        words = terms_of(t)
        docs.update((lang, w) for w in set(words))
        times[lang, source].update(words)
    kept = defaultdict(set)
    for (lang, w), n in docs.items():
        if n >= min_docs:
            kept[lang].add(w)

    def shares(count, words):
        total = sum(count[w] for w in words)
        return {w: 1 + 10 ** 9 * (count[w] + 2) // (total + 2 * len(words)) for w in words}

    out = []
    for lang in {k[0] for k in times}:
        group = {s: shares(c, kept[lang]) for (g, s), c in times.items() if g == lang}
        whole = sum((c for (g, _), c in times.items() if g == lang), Counter())
        all_ = shares(whole, kept[lang])
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in group.items():
            pair = [(-sum(gap(p[w], q[w]) for w in kept[lang]), o.encode(), o) for o, q in group.items() if o != s]
            term = [(-gap(p[w], all_[w]), w.encode(), w) for w in kept[lang] if times[lang, s][w] and p[w] > all_[w]]
            for part, some in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(some, 1)]
    return sorted(out)


def odd_rows(n=260):
    r = random.Random(11)
    words = ["a", "Be", "the", "Straße", "mixedCase", "abcdefgh", "abcdefghi", "sixteenletters__", "ABCDEFGHIJKLMNOP", "seventeenletters",
             "q" * 17, "q" * 24, "z" * 25, "w" * 33, "é" * 40, "漢字" * 30, "v" * 129, "Ж" * 100, "ﬀ", " x", "ÀÉ", "İ"]
    rows = [("".join(r.choice(words) + r.choice([" ", "_", "1", "\n", "-", "\x00", "@", "[", "`", "{"]) for _ in range(r.randint(0, 60))),
             r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "s10", None])) for _ in range(n)]
    return rows + [(None, "en", "silent"), ("", "xx", "only"), ("x y", "yy", "a"), ("z", "yy", "b"), ("long " * 30_000 + "q" * 9000, "en", "s1")] + rows[:3] * 4


def test_task_counts_equal_plain_counts(monkeypatch):
    rows = [(t or "", a or "", b or "") for t, a, b in odd_rows()]
    want, held = Counter(), Counter()
    for t, a, b in rows:
        words = terms_of(t)
        want.update((a, b, w) for w in words)
        held.update((a, b, w) for w in set(words))
    for limit in (10 ** 6, 200):  # handed on once, and over and over
        monkeypatch.setattr(D, "HELD_RUNS", limit)
        counts, times, docs = D.TermCounts(), Counter(), Counter()
        out = []
        for k in range(0, len(rows), 37):
            some = rows[k:k + 37]
            counts.add(pa.array([x[0] for x in some], pa.string()), [x[1] for x in some], [x[2] for x in some])
            if counts.full():
                out += list(counts.out())
        for b in out + list(counts.out()):
            for r in b.to_pylist():
                times[r["lang"], r["source"], r["term"]] += r["times"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
        assert times == want and docs == held


def test_a_slice_of_a_batch_counts_its_own_texts():
    counts = D.TermCounts()
    counts.add(pa.array(["skipped", "ab", "cd ab", "no"], pa.string()).slice(1, 2), ["x", "x"], ["y", "y"])
    (batch,) = counts.out()
    assert {r["term"]: (r["times"], r["docs"]) for r in batch.to_pylist()} == {"ab": (2, 2), "cd": (1, 1)}


def test_radix_order_is_a_stable_sort():
    r = np.random.default_rng(0)
    for kind in (np.uint32, np.uint64):
        a, b = r.integers(0, 50, 3000).astype(kind) << kind(20), r.integers(0, 1 << 31, 3000).astype(kind)
        assert (D.radix_order([a, b]) == np.lexsort((b, a))).all()
        assert (D.radix_order([a]) == np.argsort(a, kind="stable")).all()


@pytest.mark.parametrize("block", [256, 2])
def test_equal_to_brute_force(spark, block):  # sources in one block, and in several
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, rank int, item string")
    got = sorted(tuple(r) for r in D.source_divergence(docs.repartition(3), block=block, dense=40).collect())
    assert got == brute(rows)
    assert sorted(tuple(r) for r in D.source_divergence(docs, min_docs=10 ** 6).collect()) == brute(rows, 10 ** 6)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert D.source_divergence(docs).count() == 0


def test_shares_are_exact_beyond_double_precision(spark):
    big = [(2 ** 52 + 1, 2 ** 53 + 7, 3), (0, 2 ** 53, 10 ** 6), (10 ** 12, 10 ** 12, 1), (7, 7, 1)]
    df = spark.createDataFrame(big, "times long, total long, terms long")
    got = [r[0] for r in df.select(D._share("times", "total", "terms")).collect()]
    assert got == [1 + 10 ** 9 * (t + 2) // (n + 2 * v) for t, n, v in big]

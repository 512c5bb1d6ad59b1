"""Exact search: what reaches the driver, and the grid of query groups and bucket spans."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import mips


def _plain(rows, asked, k):
    out = []
    for q, v in rows:
        if asked(q):
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def _rows(n=400):
    r = random.Random(3)
    rows = [(i, [r.randint(-9, 9) * (1 + 30 * (i % 7 == 0)) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, list(rows[i][1])) for i in range(0, 100, 5)]                   # ties
    rows += [(n + 200 + i, [3, -2, 1, 0, 2, 5]) for i in range(60)]                 # one common vector
    return rows + [(2000 + 5 * i, [r.randint(-9, 9) for _ in range(3)]) for i in range(9)] + [(3000, [0] * 6), (3005, [0] * 6)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(6)


def _nodes(plan):
    yield plan
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from _nodes(plan.initialPlan())
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def _carries_blocks(df, kind: str) -> bool:
    return any(n.nodeName() == kind and any(n.output().apply(i).dataType().simpleString() == "binary" for i in range(n.output().size()))
               for n in _nodes(df._jdf.queryExecution().executedPlan()))


def test_no_blocks_but_one_reach_the_driver(spark, monkeypatch):
    """A block for each file was sent to find the first; and blocks of
    queries, repeated for each bucket, were broadcast where their table
    before the repetition was small."""
    df, kind, sent = _frame(spark, _rows()), type(spark.range(0)), []
    collect = kind.collect

    def seen(self):
        got = collect(self)
        sent.append((_carries_blocks(self, "TakeOrderedAndProject"), sum(isinstance(x, bytearray | bytes) for r in got for x in r)))
        return got

    monkeypatch.setattr(kind, "collect", seen)
    out = mips.top_k(df, df.filter(F.col("vec_id") % 5 == 0), 3, factor=1.0, bucket_rows=16, query_rows=8)
    assert sent and not any(ordered for ordered, _ in sent) and sum(n for _, n in sent) == 2      # ids and rows of one block
    assert not _carries_blocks(out, "BroadcastExchange")


def test_grid_of_groups_and_spans(spark, monkeypatch):
    monkeypatch.setattr(mips, "RANGES", 3)
    monkeypatch.setattr(mips, "SPAN", 4)
    monkeypatch.setattr(mips, "SPANS_A_CORE", 1)
    monkeypatch.setattr(mips, "GROUP_BYTES", 4000)
    rows = _rows()
    df = _frame(spark, rows)
    packed = mips._pack(mips.quantised(df, "vec_id", "embedding", 1.0), 16, "test-b")
    assert packed.agg(F.max("part")).first()[0] < 3 and packed.count() > 20
    got = mips.top_k(df, df.filter(F.col("vec_id") % 5 == 0), 3, factor=1.0, bucket_rows=16, query_rows=8).collect()
    assert sorted(tuple(x) for x in got) == _plain(rows, lambda q: q % 5 == 0, 3)


@pytest.mark.parametrize("times", [1, 5000, 1 << 22, 1 << 40])        # products as float32, float64 and Python integers
@pytest.mark.parametrize("seek", [-1, 1 << 21])
def test_blocks_meet_buckets(monkeypatch, times, seek):
    monkeypatch.setattr(mips, "TILE", 16)
    monkeypatch.setattr(mips, "SEEK", seek)
    k, rows = 4, [(i, v) for i, v in _rows(150) if len(v) == 6]
    ids, vecs = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.int64) * times
    a = mips.Asked(ids[::3], vecs[::3], None, k)
    for lo in range(0, len(ids), 120):
        a.meet(mips.Bucket(ids[lo:lo + 120], mips._narrow(vecs[lo:lo + 120])))
    for j, q in enumerate(ids[::3]):
        best = sorted((-max(-mips.MOST, min(mips.MOST, sum(int(x) * int(y) for x, y in zip(vecs[3 * j], w, strict=True)))), int(i))
                      for i, w in zip(ids, vecs, strict=True) if i != q)[:k]
        assert [(-int(s), int(i)) for i, s in zip(a.vecs[j], a.scores[j], strict=True)] == best
    assert (a.found == k).all() and (a.least == a.scores[:, -1]).all()


@pytest.mark.parametrize("seek", [-1, 1 << 21])
def test_lists_are_searched_where_a_product_is_dearer(monkeypatch, seek):
    monkeypatch.setattr(mips, "SEEK", seek)
    listed, whole = [], mips.candidates
    monkeypatch.setattr(mips, "candidates", lambda *a: listed.append(whole(*a)) or listed[-1])
    g = np.random.default_rng(2)
    near = g.normal(size=(40, 8))[g.integers(40, size=2000)] + 0.02 * g.normal(size=(2000, 8))
    b = mips.Bucket(np.arange(2000), (near / np.linalg.norm(near, axis=1)[:, None] * 5000).astype(np.int64))
    asked = b.rows[:30] * 2
    best = [mips.search(b, -1, q, 5, mips.NONE) for q in asked]
    listed.clear()
    a = mips.Asked(np.full(30, -1), asked, np.array([x[-1][1] for x in best]), 5)
    a.meet(b)
    assert [list(zip(v.tolist(), s.tolist(), strict=True)) for v, s in zip(a.vecs, a.scores, strict=True)] == best
    assert any(isinstance(x, np.ndarray) for x in listed) == (seek < 0)

"""Near duplicates, decontamination, toxicity, language and quality."""
import random
from collections import Counter

import numpy as np
import pytest

from starloom.llm import decontamination as D
from starloom.llm import language_id as L
from starloom.llm import near_dup as N
from starloom.llm import quality_cnn as Q
from starloom.llm import toxicity as T

R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(3, 8))) for _ in range(600)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, share, r=R):
    return " ".join(r.choice(VOCAB) if r.random() < share else w for w in text.split())


# near duplicates

def near_rows():
    r = random.Random(9)
    rows, base = [], prose(120, r)
    rows += [base] * 40                                                       # exact copies
    rows += [edited(base, r.choice([0.005, 0.01, 0.02]), r) for _ in range(60)]  # a big group of near copies
    for _ in range(30):
        t = prose(r.randint(5, 200), r)
        rows += [t, edited(t, 0.01, r), t.upper() + "!"]
    passage = prose(40, r)
    rows += [prose(100, r) + " " + passage for _ in range(60)]                # a shared passage is no copy
    rows += ["", "", " ", "...", None, "one", "One.", "one two", "x" * 30000, "x" * 30000]
    return rows


def plain_classes(rows, cfg):
    docs = [N.words_of(t) for t in rows]
    d, h, tf = N.shingles(docs, cfg.shingle)
    counts = np.concatenate([np.bincount(c, minlength=N.SKETCH) for c in N._cells(h)])
    w = N.Weights.of(counts, len(set(d.tolist())), cfg)(h, tf)
    vec = [(h[d == i], w[d == i]) for i in range(len(rows))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if len(vec[i][0]) and len(vec[j][0]) and N.similarity(vec[i], vec[j]) >= cfg.threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)  # families in one block, and in many
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in enumerate(rows)], "doc_id long, text string, class_id string, n int")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(rows))] == plain_classes(rows, N.Settings())


@pytest.mark.parametrize("block", [512, 5])
def test_candidates_just_over_and_under_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(21)
    base = prose(189, r).split()
    rows = []
    for k in range(90):  # one template; similarities between 0.4 and 0.9
        other = list(base)
        for at in r.sample(range(0, 189, 9), k % 8):
            other[at] = r.choice(VOCAB)
        rows.append(" ".join(other))
    rows += [prose(150, r) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in N.near_duplicates(df).collect()}
    want = plain_classes(rows, N.Settings())
    assert len(set(want)) > 50 and [got[i] for i in range(len(rows))] == want


def test_units_of_open_families_meet_whole(spark):
    """Links that only the last step can find, by family and by bucket."""
    r = random.Random(5)
    rows = [prose(120, r) for _ in range(40)]
    pairs = [(k, k + 20) for k in range(20)]
    for a, b in pairs:
        rows[b] = rows[a] + " end"
    n = len(rows)
    weights = spark.sparkContext.broadcast(N.Weights(np.ones((N.SKETCH_ROWS, N.SKETCH))))
    texts = spark.createDataFrame(list(enumerate(rows)), "tid long, text string")
    state = spark.createDataFrame([(k, 0, k) for k in range(n)], "tid long, family long, group long")
    sizes = texts.selectExpr("tid", "cast(length(text) as long) as chars")
    for buckets in ([(k, 0, 9) for k in range(n)], [(k, 3, k % 20) for k in range(n)]):
        met = spark.createDataFrame(buckets, "tid long, band int, h long")
        got = {tuple(sorted(x)) for x in N._apart(state, met, sizes, texts, weights, N.Settings()).collect()}
        assert got == set(pairs)


def test_products_equal_the_plain_similarity():
    r = random.Random(8)
    texts = [prose(r.randint(1, 60), r) for _ in range(25)] + ["a b c d e " * 40, "a b c d e " * 30 + "x", "", "one two"]
    g = np.random.default_rng(3)
    weights = N.Weights(g.choice([1.0, .5, .7], (N.SKETCH_ROWS, N.SKETCH)))
    texts += [edited(t, .03, r) for t in texts]
    vec, n = N.Vectors(texts, weights, 5), len(texts)
    d, h, tf = N.shingles([N.words_of(t) for t in texts], 5)
    w = weights(h, tf)
    want = np.array([[N.similarity((h[d == i], w[d == i]), (h[d == j], w[d == j])) for j in range(n)] for i in range(n)])
    assert np.allclose(vec.similar((0, n), (0, n))[~np.eye(n, dtype=bool)], want[~np.eye(n, dtype=bool)])
    assert np.allclose(vec.similar((0, 9), (9, n)), want[:9, 9:])


def test_recall_of_all_pairs_over_the_threshold(spark):
    """Every pair of the given documents at 0.8 or more is in one class: recall
    1 against all pairs, at least 0.9 asked."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.text for r in docs.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    want = plain_classes(rows, N.Settings())
    linked = [(i, w) for i, w in enumerate(want) if i != w and rows[i]]
    assert linked and sum(got[ids[i]] == got[ids[w]] for i, w in linked) >= .9 * len(linked)


def test_texts_under_one_id_are_linked(spark):
    import corpus_pipeline

    r = random.Random(31)
    one, two, three = (prose(50, r) for _ in range(3))
    rows = [(5, one), (7, one), (7, two), (9, two), (11, three), (13, two + " " + three), (15, "b " + one), (15, "a " + three + three)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.class_id) for x in N.near_duplicates(df).collect()}
    assert got >= {(5, 5), (7, 5), (9, 5), (13, 13)}
    assert all(sum(a == b == c for a, b in got) == 1 for c in {b for _, b in got})
    two_texts = spark.createDataFrame([(3, None), (3, two), (3, one), (4, three), (None, one)], "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, two_texts, "")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, min(one, two)), (4, three), (None, one)], key=str)


def test_near_duplicates_of_an_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_samples_agree_as_often_as_the_similarity():
    g = np.random.default_rng(0)
    hits, want = [], []
    for _ in range(60):
        h = np.sort(g.integers(0, 1 << 63, 200).astype(np.uint64))
        wa, wb = g.choice([0.5, 1, 2, 3.7], 200), g.choice([0.5, 1, 2, 3.7], 200)
        a, b = N.signatures(np.zeros(200, int), h, wa, 1), N.signatures(np.zeros(200, int), h, wb, 1)
        hits.append((a == b).mean())
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    got = {r.id: r.group for r in N.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# decontamination

ITEMS = [(i, f"{prose(R.randint(8, 30))}? {prose(R.randint(3, 12))}.") for i in range(80)]


def plain_index(cfg=D.Settings()):
    df = Counter(t for _, x in ITEMS for t in set(D.words_of(x)))
    n = [len(D.words_of(x)) for _, x in ITEMS]
    return D.Index.build(ITEMS, df, len(ITEMS), sum(n) / len(n), cfg)


def test_wand_equals_scoring_every_item():
    index, r = plain_index(), random.Random(2)
    for _ in range(100):
        words = set(edited(r.choice(ITEMS)[1], 0.3, r).lower().replace("?", "").replace(".", "").split()) | set(prose(30, r).split())
        terms = sorted(index.term[w] for w in words if w in index.term)
        score = Counter()
        for t in terms:
            for i, x in zip(index.postings[t], index.impacts[t]):
                score[i] += x
        for least in (0.2, 0.5):
            want = sorted((i, round(s, 9)) for i, s in score.items() if s >= least)
            assert sorted((i, round(s, 9)) for i, s in index.search(terms, least, 16)) == want


def test_leaks_are_found(spark):
    r = random.Random(8)
    item = dict(ITEMS)
    docs = [prose(400, r) for _ in range(40)] + [prose(r.randint(0, 200), r) + " " + item[i].upper() + " " + prose(r.randint(0, 200), r) for i in range(80)]
    docs += [item[3], item[4].split("?")[0], "", None, " ".join(item[i] for i in range(80))]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(docs)], "doc_id long, text string, score double")
    bench = spark.createDataFrame([*ITEMS, (900, None), (901, "..."), (None, "x y z"), (5, ITEMS[5][1])], "item_id long, text string")
    for cfg in (D.Settings(), D.Settings(index_chars=2000)):
        got = {(x.doc_id, x.item_id) for x in D.contaminated(df, bench, cfg).collect()}
        assert got == {(40 + i, i) for i in range(80)} | {(120, 3)} | {(124, i) for i in range(80)}
        assert {x.doc_id for x in D.without_items(df, bench, cfg).collect()} == {*range(40), 121, 122, 123}
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0


def some_changed(text, k, r):
    words = text.split()
    for i in r.sample(range(len(words)), k):
        words[i] = r.choice(VOCAB)
    return " ".join(words)


@pytest.mark.parametrize("mark", [". ", "? "])
def test_lightly_edited_leaks_are_found(mark):
    r = random.Random(12)
    items = [(i, f"{prose(r.randint(14, 30), r)}{mark}{prose(r.randint(3, 5), r)}.") for i in range(60)]
    df = Counter(t for _, x in items for t in set(D.words_of(x)))
    index = D.Index.build(items, df, len(items), sum(len(D.words_of(x)) for _, x in items) / len(items), D.Settings())
    hits = lambda texts: {h[:2] for h in D.search_texts(index, [f"{prose(90, r)} {t} {prose(90, r)}" for t in texts], D.Settings())}
    for k in range(1, 5):
        if mark == ". ":
            leaks = [some_changed(x, k, r) for _, x in items]
        else:  # one word of the answer, the others in the question
            leaks = [some_changed(x.split(mark)[0], k - 1, r) + mark + some_changed(x.split(mark)[1], 1, r) for _, x in items]
        found = hits(leaks)
        assert all(i == j for i, j in found) and len(found) >= (60 if mark == ". " else 57)
    first = hits([x.split(mark)[0] for _, x in items])  # without the last sentence, or the question alone
    assert first == ({(i, i) for i in range(60)} if mark == ". " else set())
    assert not hits([prose(40, r) for _ in range(60)])


# toxicity

def plain_segments(scores):
    """Definition by recursion: the best segment, then left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1], -x[2]))
    _, _, i, j = best
    return plain_segments(scores[:i]) + [(sum(scores[i:j]), i, j)] + [(s, a + j, b + j) for s, a, b in plain_segments(scores[j:])]


def test_segments_equal_their_definition():
    r = random.Random(1)
    odds = {"bad": 2.1, "worse": 3.3, "good": -1.7}
    for _ in range(150):
        tokens = [r.choice(["bad", "worse", "good", "x", "x", "x", "x"]) for _ in range(r.randint(0, 25))]
        got = T.segments(tokens, T.Scores(odds), 0.45)
        want = plain_segments([odds.get(t, -0.45) for t in tokens])
        assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in want]


def test_the_scan_is_linear():
    r = random.Random(2)
    shapes = {"alternating": lambda n: [2.0, -1.9] * (n // 2), "falling": lambda n: [1.0, -1.1] * (n // 2), "rising": lambda n: [1.0, -0.9] * (n // 2),
              "sparse": lambda n: ([3.0] + [None] * 80) * (n // 81), "random": lambda n: [r.gauss(0, 1) for _ in range(n)],
              "saw": lambda n: ([1.0, -1.5] * 50 + [40.0, -60.0]) * (n // 102)}
    for name, make in shapes.items():
        for n in (8_000, 16_000, 64_000):
            assert T.scan(make(n), 0.05)[1] <= 2 * n, name
    for _ in range(200):  # and still right
        scores = [r.choice([2.1, 3.3, -1.7, -0.45, -0.45, -0.45]) for _ in range(r.randint(0, 25))]
        got = T.scan([None if s == -0.45 else s for s in scores], 0.45)[0]
        assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in plain_segments(scores)]


def test_toxicity(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        t = prose(r.randint(20, 120), r)
        y = int(i % 4 == 0)
        if y:
            w = t.split()
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["scoundrel", "rotter", "rotters"]))
            t = " ".join(w)
        rows.append((i, t, y, "c"))
    rows += [(900, None, None, "c"), (901, "", 0, "c"), (902, "123 456", None, "c"), (903, "rotter " * 20000, None, "c"), (0, rows[0][1], 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = T.fit(df.filter("doc_id < 300 or doc_id >= 900"))
    got = {x.doc_id: x for x in T.score(df, model, with_passages=True).collect()}
    assert sum(got[i].predicted == rows[i][2] for i in range(300, 400)) >= 98
    assert got[900].score == got[901].score == got[902].score < 0.3 and got[903].predicted == 1
    p = got[903].passages
    assert len(p) == 1 and (p[0]["first"], p[0]["last"]) == (0, 20000)
    assert T.score(df.limit(0), model).count() == 0
    for only, want in (("toxic = 0", 0), ("toxic = 1", 1), ("1 = 0", 0)):
        assert {x.predicted for x in T.score(df, T.fit(df.filter(only))).collect()} == {want}


# language

def test_gradients_by_time():
    x, n, _ = L.windows([b"abcdefghij", b"xyz", b"qrs tuv wxyz 12"], 16)
    steps, live = L._steps(x, n)
    net = L.Network(["a", "b"], seed=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    y = np.array([0, 1, 0])
    _, g = net.gradients(steps, live, y)
    for k, d in g.items():
        i = np.unravel_index(np.abs(d).argmax(), d.shape)
        e, keep = 1e-4, net.w[k][i]
        net.w[k][i] = keep + e
        up = net.gradients(steps, live, y)[0]
        net.w[k][i] = keep - e
        down = net.gradients(steps, live, y)[0]
        net.w[k][i] = keep
        assert abs((up - down) / (2 * e) - d[i]) < 1e-3 * max(1, abs(d[i])) + 1e-4, k


def test_language(spark):
    r = random.Random(3)
    say = {"aa": "kala mana tavu rilo", "bb": "schtrom pflug ngrik bzst", "cc": "éàè ôïû ñçá öüä"}
    rows = [(i, " ".join(r.choice(say[c].split()) for _ in range(r.randint(1, 60))), c, 1.0) for i in range(300) for c in [r.choice(list(say))]]
    rows += [(1000, None, "aa", 1.0), (1001, "", None, 1.0), (1002, "12 34 !!", "bb", 1.0), (1003, "kala " * 20000, None, 1.0), (0, rows[0][1], rows[0][2], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    net = L.fit(df.filter("doc_id < 200"), L.Settings(steps=120))
    got = {x.doc_id: x for x in L.predict(df, net).collect()}
    assert sum(got[i].lang_pred == rows[i][2] for i in range(200, 300)) >= 97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert L.predict(df.limit(0), net).count() == 0
    none = L.fit(df.filter("1 = 0"))
    assert {x.lang_pred for x in L.predict(df, none).collect()} == {"und"}


def test_windows_cover_the_text():
    texts = [b"", b"a", bytes(range(1, 200)) * 7]
    x, n, owner = L.windows(texts, 64)
    assert [b"".join(x[i, :n[i]].tobytes() for i in np.flatnonzero(owner == k)) for k in range(3)] == texts


# quality

def test_gradients_through_pooling():
    net = Q.Network(seed=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, n, owner = Q.chunks([prose(160, random.Random(1)).encode(), b"xyz", b""])  # without repeats, so that each maximum is unique
    y, w = np.array([1.0, 0.0, 1.0]), np.full(3, 1 / 3)
    _, g = net.gradients(x, n, owner, y, w)
    for k, d in g.items():
        i = np.unravel_index(np.abs(d).argmax(), d.shape)
        e, keep = 1e-5, net.w[k][i]
        net.w[k][i] = keep + e
        up = net.gradients(x, n, owner, y, w)[0]
        net.w[k][i] = keep - e
        down = net.gradients(x, n, owner, y, w)[0]
        net.w[k][i] = keep
        assert abs((up - down) / (2 * e) - d[i]) < 0.01 * abs(d[i]) + 1e-5, k


def test_chunks_cover_and_overlap():
    t = bytes(range(1, 251)) * 9
    x, live, owner = Q.chunks([t, b"", b"ab"])
    a = np.concatenate([x[i, :Q.STEP] for i in np.flatnonzero(owner == 0)])
    assert a[:len(t)].tobytes() == t and (x[0, Q.STEP:] == x[1, :Q.CHUNK - Q.STEP]).all()
    assert live[-2] == 1 and live[-1] == 1


def test_quality(spark):
    r = random.Random(5)
    rows = [(i, prose(r.randint(10, 300), r) if y else " ".join(w + "###" for w in prose(r.randint(10, 300), r).split()), y) for i in range(400) for y in [int(i % 3 > 0)]]
    rows += [(900, None, None), (901, "", 1), (902, "word " * 30000, None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, quality int, predicted int")
    net = Q.fit(df.filter("doc_id < 300"), Q.Settings(rounds=120))
    got = {x.doc_id: x for x in Q.score(df, net).collect()}
    assert sum(got[i].predicted == rows[i][2] for i in range(300, 400)) >= 96
    assert got[900].score == got[901].score and all(0 <= x.score <= 1 for x in got.values())
    assert Q.score(df.limit(0), net).count() == 0
    for only, want in (("quality = 0", 0), ("quality = 1", 1), ("1 = 0", 0)):
        assert {x.predicted for x in Q.score(df, Q.fit(df.filter(only))).collect()} == {want}

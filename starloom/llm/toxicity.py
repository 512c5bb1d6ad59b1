"""Toxic passages by maximum-scoring segment search.

Each token scores its log-odds between toxic and clean labelled documents
under an informative Dirichlet prior.  The units counted are words and word
stems (a stem stands for all words that begin with it, so that inflected and
compounded forms share their evidence); a token takes the score of its most
significant unit, and a token without one a small negative drift.  One linear pass over a text finds all maximal
scoring segments, and extreme-value theory turns their scores, given the
text's length, into the chance of seeing them in clean text.  A one-variable
logistic fit turns that into the document's probability.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, one_sample, only, ship, written

TOKEN = re.compile(r"[^\W\d_]+")
STEP_BYTES = 4 << 20


@dataclass(frozen=True)
class Settings:
    """Bounds and constants of the fit.  ``per_label`` bounds the labelled
    rows of each label that are learned from."""
    per_label: int = 4000
    #: Mass of the Dirichlet prior, as a share of all tokens learned from.
    prior_share: float = 0.01
    #: Significance, odds and number of copy groups that a unit needs.
    min_z: float = 2.0
    min_odds: float = 2.5
    min_groups: int = 4
    drift: float = 0.05


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]  # unit -> score; stems end with "*"
    drift: float
    decay: float       # lambda of the extreme-value law
    scale: float       # K of the extreme-value law
    slope: float
    intercept: float

    def evidence(self, segments: list[tuple[float, int, int]], n_tokens: int) -> float:
        """-log of the chance that clean text of this length holds the
        significant segments found (the sum of their normalised scores)."""
        total, r = 0.0, 0
        for s, _, _ in segments:
            x = self.decay * s - math.log(self.scale * max(n_tokens, 1))
            if x > 0:
                total += x
                r += 1
        return total - math.lgamma(r + 1) if r else 0.0

    def probability(self, evidence: float) -> float:
        x = self.slope * math.log1p(max(0.0, evidence)) + self.intercept
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


#: Lengths of the stems that are units.
STEMS = range(4, 9)


def units(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


class Scores(dict):
    """Score of every word met so far; the best unit decides (the first in
    ``rank`` order), and a word without a unit has None.  Bounded."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds
        self.rank = {u: i for i, u in enumerate(odds)}

    def __missing__(self, word: str):
        if len(self) > 150_000:
            self.clear()
        found = [u for u in units(word) if u in self.rank]
        self[word] = got = self.odds[min(found, key=self.rank.__getitem__)] if found else None
        return got


def segments(tokens: list[str], scores: Scores, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last + 1), in order."""
    return scan([scores[w] for w in tokens], drift)[0]


def scan(score_of: list[float | None], drift: float) -> tuple[list[tuple[float, int, int]], int]:
    """The segments, and the number of candidates looked at.

    Only tokens with a score of their own are visited; the gap between two
    costs ``drift`` a token, so one step of the scan is a gap and a token.
    Candidates are kept with the running total before and after them; a new
    one swallows those from the last candidate that started lower.  Each
    candidate knows that one (``near``), and the search hops along it:
    whatever is hopped over is behind the new candidate and never looked at
    again, so the scan is linear."""
    total, at, steps = 0.0, 0, 0
    left: list[float] = []    # running total before each candidate
    right: list[float] = []   # and after it
    near: list[int] = []      # the last candidate before it with a smaller left total
    spans: list[tuple[int, int]] = []
    for i, s in enumerate(score_of):
        if s is None:
            continue
        total -= drift * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        lo, first, j = before, i, len(left) - 1
        while j >= 0:
            steps += 1
            if left[j] >= lo:
                j = near[j]
            elif right[j] >= total:
                break
            else:
                lo, first, k = left[j], spans[j][0], near[j]
                del left[j:], right[j:], near[j:], spans[j:]
                j = k
        left.append(lo)
        right.append(total)
        near.append(j)
        spans.append((first, i + 1))
    return [(b - a, s, e) for a, b, (s, e) in zip(left, right, spans, strict=True)], steps


def tokenise(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _group(tokens: list[str]) -> int:
    """The smallest hash of the text's three-word runs: copies share it, so
    that a copied document counts once."""
    runs = zip(tokens, tokens[1:], tokens[2:]) if len(tokens) > 2 else [tuple(tokens)]
    return min(xxhash.xxh64_intdigest(" ".join(r)) for r in runs) - (1 << 63)


def fit(labelled: DataFrame, cfg: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from rows of text and label (0, 1; null labels are left out).

    Unit counts are Spark aggregates over documents' groups of copies; only
    significant units, which the bounded sample bounds, and one statistic per
    sampled row reach the driver.  With no toxic or no clean row, every text gets the
    base rate (0 with no rows at all)."""
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"))
    rows = written(one_sample(rows, F.col("y"), F.col("id"), cfg.per_label), "tox")

    def words(it):
        for b in batches(it, STEP_BYTES):
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tokens = tokenise(t)
                if tokens:
                    found = Counter(u for w in tokens for u in units(w))
                    found[""] = len(tokens)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, _group(tokens), np.int64)), pa.array(list(found), pa.string()),
                         pa.array(np.full(n, y, np.int32)), pa.array(found.values(), pa.int64())], names=["g", "u", "y", "n"])

    per_group = rows.mapInArrow(words, "g long, u string, y int, n long").groupBy("u", "y", "g").agg(F.max("n").alias("n"))
    per_unit = per_group.groupBy("u").agg(F.sum(F.col("n") * F.col("y")).alias("y1"), F.sum(F.col("n") * (1 - F.col("y"))).alias("y0"),
                                          F.greatest(F.sum("y"), F.sum(1 - F.col("y"))).alias("groups"))
    per_unit = written(per_unit.filter((F.col("groups") >= cfg.min_groups) | (F.col("u") == "")), "tox-u")
    total = per_unit.filter("u = ''").collect()
    n1, n0 = (float(total[0]["y1"]), float(total[0]["y0"])) if total else (0.0, 0.0)
    if not n1 or not n0:
        return Model({}, cfg.drift, 1.0, 1.0, 0.0, 40.0 if n1 else -40.0)
    share, a = F.lit(cfg.prior_share), cfg.prior_share * (n1 + n0)
    p1, p0 = F.col("y1") + share * (F.col("y1") + F.col("y0")), F.col("y0") + share * (F.col("y1") + F.col("y0"))
    odds = F.log(p1 / (F.lit(n1 + a) - p1)) - F.log(p0 / (F.lit(n0 + a) - p0))
    sig = (per_unit.filter("u <> ''").filter((F.lit(n1 + a) > p1) & (F.lit(n0 + a) > p0))
           .withColumn("odds", odds).withColumn("z", F.abs(F.col("odds")) / F.sqrt(1 / p1 + 1 / p0))
           .filter((F.col("z") >= cfg.min_z) & (F.abs("odds") >= cfg.min_odds))
           .orderBy(F.desc("z"), "u").collect())
    table = {r["u"]: float(r["odds"]) for r in sig}

    # how often each score comes up in clean text gives the extreme-value law
    clean = {r["s"]: r["n"] for r in _clean_scores(rows, table).groupBy("s").agg(F.sum("n").alias("n")).collect()}
    s = np.array(sorted(set(table.values())))
    p = np.array([(clean.get(v, 0) + 0.5) / (n0 + 1) for v in s])
    decay = _decay(s, p, cfg.drift)
    model = Model(table, cfg.drift, decay, _scale(s, p, decay), 0.0, 0.0)
    got = np.array([(r["y"], r["x"]) for r in _statistics(rows, model).collect()], float).reshape(-1, 2)
    shares = labelled.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect()
    rate = {r[0]: float(r[1]) for r in shares}
    slope, intercept = _logistic(np.log1p(got[:, 1]), got[:, 0], rate.get(1, 0.0), rate.get(0, 0.0))
    return Model(table, cfg.drift, decay, model.scale, slope, intercept)


def _clean_scores(rows: DataFrame, table: dict[str, float]) -> DataFrame:
    """Scores of the scored tokens of clean rows, with their number."""
    def run(it):
        scores, seen = Scores(table), Counter()
        for b in it:
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not y:
                    seen.update(v for w in tokenise(t) if (v := scores[w]) is not None)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(seen.values(), pa.int64())], names=["s", "n"])

    return rows.mapInArrow(run, "s double, n long")


def _statistics(rows: DataFrame, model: Model) -> DataFrame:
    """Label and evidence of each row."""
    def run(it):
        scores = Scores(model.odds)
        for b in batches(it, STEP_BYTES):
            x = []
            for t in b.column(1).to_pylist():
                tokens = tokenise(t)
                x.append(max(0.0, model.evidence(segments(tokens, scores, model.drift), len(tokens))))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(x, pa.float64())], names=["y", "x"])

    return rows.mapInArrow(run, "y int, x double")


def _decay(s: np.ndarray, p: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(x * score)] = 1 for one clean token."""
    rest = max(0.0, 1 - float(p.sum()))
    f = lambda x: float((p * np.exp(np.minimum(x * s, 600))).sum()) + rest * math.exp(-x * drift) - 1
    if not (s > 0).any():
        return 1.0
    lo, hi = 1e-6, 1e-6
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _scale(s: np.ndarray, p: np.ndarray, decay: float) -> float:
    """K: the rate per token at which a positive run can start, in units of
    exp(decay * score)."""
    up = s > 0
    return max(1e-12, float((p[up] * np.exp(np.minimum(decay * s[up], 600))).sum()))


def _logistic(x: np.ndarray, y: np.ndarray, n1: float, n0: float) -> tuple[float, float]:
    """Newton steps of a ridge logistic fit, weighted back to the labels' own rates."""
    if not len(x) or y.min() == y.max():
        return 0.0, 0.0
    w = np.where(y == 1, n1 / max(1.0, (y == 1).sum()), n0 / max(1.0, (y == 0).sum()))
    d = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(d @ b, -30, 30)))
        grad = d.T @ (w * (q - y)) + 1e-2 * np.array([b[0], 0])
        hess = (d * (w * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ d + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          with_passages: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` columns, score (0 to 1), predicted, and on request
    the passages (first token, last token + 1, score) of every whole text.

    A null or empty text, or one without a letter, holds no passage and gets
    the score of a text without evidence.  No shuffle; repeated rows score
    alike; an empty table gives an empty result; other columns stay unread.
    """
    ship(docs.sparkSession)
    kept = [docs.schema[c] for c in (id_col, *keep)]
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(it):
        only("toxicity")
        scores = Scores(model.odds)
        for b in batches(it, STEP_BYTES, "__text"):
            p, found = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                tokens = tokenise(t or "")
                seg = segments(tokens, scores, model.drift)
                p.append(model.probability(model.evidence(seg, len(tokens))))
                if with_passages:
                    least = math.log(model.scale * max(len(tokens), 1)) / model.decay
                    found.append([{"first": a, "last": e, "score": s} for s, a, e in seg if s > least])
            cols = [*b.columns[:-1], pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32())]
            names = [id_col, *keep, "score", "predicted"]
            if with_passages:
                cols.append(pa.array(found, passage))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    out = [*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if with_passages:
        out.append(T.StructField("passages", T.ArrayType(T.StructType().add("first", "long").add("last", "long").add("score", "double"))))
    return rows.mapInArrow(run, T.StructType(out))

"""Language identification by a bidirectional gated recurrent network.

The network reads bytes in windows that cover the whole text.  A position is
a patch of ``PATCH`` bytes, read by one step; forward and backward states
label every position, the positions' probabilities are pooled into the
document's, and on request runs of equal labels come back as spans of bytes.  It is trained here
in numpy by backpropagation through time.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, only, ship, unit_of

#: Bytes read by one step, bytes of one window, hidden units of a direction.
PATCH, WINDOW, HIDDEN = 4, 256, 16
STEP_BYTES = 1 << 20
#: Windows that run together.
ROWS = 512
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the stretches of ``stretch`` characters of each
    language that are learned from; they are drawn from all of its texts, each
    text being cut into such stretches from end to end."""
    per_language: int = 2000
    stretch: int = 256
    steps: int = 360
    batch: int = 96
    train_window: int = 128
    rate: float = 0.012
    seed: int = 7


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent layers (one a direction) and a softmax per position."""

    def __init__(self, classes: list[str], weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        self.classes = classes
        if weights is None:
            r, c = np.random.default_rng(seed), len(classes)
            h = HIDDEN
            weights = {"V": r.normal(0, 0.1, (2 * h, c)), "c": np.zeros(c)}
            for d in "fb":
                weights[f"E{d}"] = r.normal(0, 0.3, (PATCH, 256, 3 * h))
                weights[f"U{d}"] = r.normal(0, 1 / np.sqrt(h), (h, 2 * h))
                weights[f"W{d}"] = r.normal(0, 1 / np.sqrt(h), (h, h))
                weights[f"b{d}"] = np.zeros(3 * h)
            weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w = weights

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of one direction: x is (windows, steps, PATCH) bytes; steps
        that are not live leave the state as it is."""
        n, steps, _ = x.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        e, u, w, bias = (self.w[k + d] for k in "EUWb")
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = bias + e[0][x[:, t, 0]]
            for k in range(1, PATCH):
                a += e[k][x[:, t, k]]
            gates = _sigmoid(a[:, :2 * HIDDEN] + h @ u)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            rh = r * h
            cand = np.tanh(a[:, 2 * HIDDEN:] + rh @ w)
            new = h + (z * live[:, t, None]) * (cand - h)
            if trace is not None:
                trace.append((t, h, z, r, cand))
            h = out[t] = new
        return out

    def positions(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Class probabilities of every step: (steps, windows, classes)."""
        s = self._run("f", x, live) @ self.w["V"][:HIDDEN] + self._run("b", x, live) @ self.w["V"][HIDDEN:] + self.w["c"]
        s = np.exp(s - s.max(-1, keepdims=True))
        return s / s.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over live positions and its gradients, by
        backpropagation through time."""
        traces: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(d, x, live, traces[d]) for d in "fb"}
        s = states["f"] @ self.w["V"][:HIDDEN] + states["b"] @ self.w["V"][HIDDEN:] + self.w["c"]
        s = np.exp(s - s.max(-1, keepdims=True))
        p = s / s.sum(-1, keepdims=True)
        m = (live.T / max(1.0, float(live.sum()))).astype(np.float32)
        hit = p[:, np.arange(len(y)), y]
        loss = float(-(m * np.log(np.maximum(hit, 1e-9))).sum())
        d_s = p
        d_s[:, np.arange(len(y)), y] -= 1
        d_s = d_s * m[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        both = np.concatenate([states["f"], states["b"]], -1)
        g["V"] = both.reshape(-1, 2 * HIDDEN).T @ d_s.reshape(-1, len(self.classes))
        g["c"] = d_s.sum((0, 1))
        for i, d in enumerate("fb"):
            out = d_s @ self.w["V"][i * HIDDEN:(i + 1) * HIDDEN].T
            u, w = self.w["U" + d], self.w["W" + d]
            dh = np.zeros_like(out[0])
            for t, h, z, r, cand in reversed(traces[d]):
                dh = dh + out[t]
                on = live[:, t, None]
                d_cand = dh * z * on * (1 - cand * cand)
                d_rh = d_cand @ w.T
                d_z = dh * on * (cand - h) * z * (1 - z)
                d_r = d_rh * h * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], 1)
                g["W" + d] += (r * h).T @ d_cand
                g["U" + d] += h.T @ d_gates
                d_a = np.concatenate([d_gates, d_cand], 1)
                g["b" + d] += d_a.sum(0)
                for k in range(PATCH):
                    np.add.at(g["E" + d][k], x[:, t, k], d_a)
                dh = dh * (1 - z * on) + d_rh * r + d_gates @ u.T
        return loss, g


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` bytes that cover every text: bytes (n, size, zero
    padded), live bytes of each and the text it belongs to."""
    count = np.array([-(-len(t) // size) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    out = np.zeros((int(count.sum()), size), np.uint8)
    length = np.empty(len(out), np.int64)
    row = 0
    for t, c in zip(texts, count, strict=True):
        if c:
            flat = out[row:row + c].reshape(-1)
            flat[:len(t)] = np.frombuffer(t, np.uint8)
            length[row:row + c] = size
            length[row + c - 1] = len(t) - (c - 1) * size
            row += c
    return out, length, owner


def _steps(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = x.shape[1] // PATCH
    return x.reshape(len(x), n, PATCH), (np.arange(n) * PATCH < length[:, None]).astype(np.float32)


def train(texts: list[bytes], labels: list[str], cfg: Settings = Settings()) -> Network:
    """Adam on batches of windows drawn evenly from the languages; a window
    may be cut short, so that short texts are learned too."""
    classes = sorted(set(labels))
    net = Network(classes, seed=cfg.seed)
    rng = np.random.default_rng(cfg.seed)
    x, length, owner = windows(texts, cfg.train_window)
    if not len(x) or len(classes) < 2:
        return net
    y = np.array([classes.index(v) for v in labels])[owner]
    pools = [p for c in range(len(classes)) if len(p := np.flatnonzero(y == c))]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    for i in range(1, cfg.steps + 1):
        pick = np.concatenate([rng.choice(p, -(-cfg.batch // len(pools))) for p in pools])
        xs, ls = x[pick].copy(), length[pick].copy()
        short = rng.random(len(pick)) < 0.3
        ls[short] = np.minimum(ls[short], rng.integers(3, cfg.train_window, short.sum()))
        xs[np.arange(xs.shape[1]) >= ls[:, None]] = 0
        steps, live = _steps(xs, ls)
        _, g = net.gradients(steps, live, y[pick])
        norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
        rate = cfg.rate * min(1.0, i / 20) * (1 - 0.9 * i / cfg.steps)
        for k, d in g.items():
            d *= min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            net.w[k] -= (rate * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.99 ** i)) + 1e-7)).astype(np.float32)
    return net


def classify(net: Network, texts: list[bytes], labels: list[np.ndarray] | None = None) -> np.ndarray:
    """Pooled class probabilities of whole texts: (texts, classes).  A list
    given as ``labels`` gets each text's best class per position."""
    x, length, owner = windows(texts)
    total = np.zeros((len(texts), len(net.classes)))
    weight = np.zeros(len(texts))
    order = np.argsort(-length, kind="stable")
    best: list[np.ndarray | None] = [None] * len(length)
    for lo in range(0, len(order), ROWS):
        pick = order[lo:lo + ROWS]
        wide = -(-int(length[pick[0]]) // PATCH) * PATCH
        steps, live = _steps(x[pick, :wide], length[pick])
        p = net.positions(steps, live)
        np.add.at(total, owner[pick], np.einsum("tnc,nt->nc", p, live))
        np.add.at(weight, owner[pick], live.sum(1))
        if labels is not None:
            top = p.argmax(-1).T.astype(np.uint16)
            for row, i in enumerate(pick):
                best[i] = top[row, :-(-int(length[i]) // PATCH)]
    if labels is not None:
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        labels += [np.concatenate([np.zeros(0, np.uint16), *best[a:z]]) for a, z in zip(first[:-1], first[1:])]
    return total / np.maximum(weight, 1)[:, None]


def spans(label: np.ndarray, n_bytes: int, classes: list[str]) -> list[dict]:
    """Runs of equal labels of positions as spans of bytes; they cover the text."""
    if not len(label):
        return []
    at = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(label)]])
    return [{"first": int(a) * PATCH, "last": min(int(z) * PATCH, n_bytes), "lang": classes[int(label[a])]} for a, z in zip(at[:-1], at[1:])]


def fit(docs: DataFrame, cfg: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Learn from rows with a language (null languages and empty texts are
    left out).  The driver gets at most about ``per_language`` stretches of
    ``stretch`` characters a language, drawn evenly from whole texts by a hash of
    id and place.  With no rows the network knows no language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang is not null and length(text) > 0")
    starts = F.expr(f"sequence(1, length(text), {cfg.stretch})")
    number = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.size(starts)).alias("n")).collect()}  # a row a language
    if not number:
        return train([], [], cfg)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(number.items()) for x in (lang, min(1.0, cfg.per_language / n))])
    # places are drawn before the text is cut, so that a long text is not copied for each of its stretches
    drawn = F.filter(starts, lambda at: unit_of(F.struct(F.col("id"), at.alias("at"))) < share[F.col("lang")])
    cut = F.transform(drawn, lambda at: F.col("text").substr(at, F.lit(cfg.stretch)))
    got = rows.select("lang", F.explode(cut).alias("t")).collect()
    got.sort(key=lambda r: (r["lang"], r["t"]))
    return train([r["t"].encode() for r in got], [r["lang"] for r in got], cfg)


def predict(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
            with_spans: bool = False) -> DataFrame:
    """``id_col``, ``keep`` columns, lang_pred and score (the pooled
    probability of the predicted language), and on request the labelled spans
    (first byte, last byte + 1, language), which cover each text in order.

    A text that is null, empty or without a letter is ``und`` with score 0,
    as is every text if no language was learned.  Whole texts are read, in
    steps of bounded memory; ties go to the language that sorts first; an
    empty table gives an empty result; other columns stay unread."""
    ship(docs.sparkSession)
    kept = [docs.schema[c] for c in (id_col, *keep)]
    classes, weights = net.classes, net.w

    def run(it):
        only("language_id")
        model = Network(classes, weights)
        for b in batches(it, STEP_BYTES, "__text"):
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            use = [i for i, t in enumerate(texts) if classes and LETTER.search(t)]
            lang, score, found = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if use:
                raw, labels = [texts[i].encode() for i in use], [] if with_spans else None
                p = classify(model, raw, labels)
                for k, (i, q) in enumerate(zip(use, p, strict=True)):
                    lang[i], score[i] = classes[int(q.argmax())], float(min(1.0, q.max()))
                    if with_spans:
                        found[i] = spans(labels[k], len(raw[k]), classes)
            cols, names = [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, *keep, "lang_pred", "score"]
            if with_spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    out = [*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if with_spans:
        out.append(T.StructField("spans", T.ArrayType(T.StructType().add("first", "long").add("last", "long").add("lang", "string"))))
    return rows.mapInArrow(run, T.StructType(out))

"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded, learned filters of eight bytes slide over overlapping
chunks that together cover the whole text, every filter is max-pooled over a
chunk, and the chunks' maxima and mean are combined into one probability.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, one_sample, only, ship

#: Embedding size, bytes per position, positions per filter, filters, hidden units, positions of a chunk.
EMBED, STRIDE, SPAN, FILTERS, HIDDEN, POSITIONS = 8, 2, 4, 24, 16, 256
#: Bytes of a chunk; neighbouring chunks share the last (SPAN - 1) * STRIDE bytes.
STEP = POSITIONS * STRIDE
CHUNK = STEP + (SPAN - 1) * STRIDE
STEP_BYTES = 1 << 20
#: Chunks that run together.
ROWS = 256


@dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the labelled rows of each label that are learned
    from, and ``pieces`` the pieces of STEP characters of each of them: a text of
    more is represented by that many, drawn from all of it.  A step of the
    descent looks at ``chunks`` chunks of a text, others each time."""
    per_label: int = 1500
    pieces: int = 16
    rounds: int = 300
    batch: int = 48
    chunks: int = 8
    rate: float = 0.01
    decay: float = 1e-4
    held: float = 0.2
    seed: int = 11


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks that cover each text (one at least, also of an empty
    text): bytes, live positions and owner.  A position is live while its
    first byte lies in the text."""
    count = np.array([max(1, -(-len(t) // STEP)) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    out = np.zeros((len(owner), CHUNK), np.uint8)
    live = np.empty(len(owner), np.int64)
    row = 0
    for t, c in zip(texts, count, strict=True):
        raw = np.zeros(int(c) * STEP + CHUNK - STEP, np.uint8)
        raw[:len(t)] = np.frombuffer(t, np.uint8)
        out[row:row + c] = np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[::STEP][:c]
        live[row:row + c] = POSITIONS
        live[row + c - 1] = max(1, -(-(len(t) - (c - 1) * STEP) // STRIDE))
        row += c
    return out, live, owner


class Network:
    def __init__(self, weights: dict[str, np.ndarray] | None = None, slope: float = 1.0, intercept: float = 0.0, seed: int = 11):
        if weights is None:
            r = np.random.default_rng(seed)
            weights = {"E": r.normal(0, 0.5, (256, EMBED)), "W": r.normal(0, 0.15, (SPAN, STRIDE * EMBED, FILTERS)), "b": np.zeros(FILTERS),
                       "H": r.normal(0, 0.2, (2 * FILTERS, HIDDEN)), "h": np.zeros(HIDDEN), "o": r.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}
            weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w, self.slope, self.intercept = weights, slope, intercept

    def pooled(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over a chunk's live positions, and where it is."""
        e = self.w["E"][x].reshape(len(x), CHUNK // STRIDE, STRIDE * EMBED)
        a = e[:, :POSITIONS] @ self.w["W"][0]
        for k in range(1, SPAN):
            a += e[:, k:k + POSITIONS] @ self.w["W"][k]
        short = np.flatnonzero(live < POSITIONS)
        for i in short:
            a[i, live[i]:] = -np.inf
        at = a.argmax(1)
        return np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.w["b"], 0), at

    def head(self, top: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.concatenate([top, mean], 1)
        h = np.tanh(f @ self.w["H"] + self.w["h"])
        return f, h, h @ self.w["o"] + self.w["c"][0]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        x, live, owner = chunks(texts)
        top = np.zeros((len(texts), FILTERS), np.float32)
        total = np.zeros((len(texts), FILTERS))
        for lo in range(0, len(x), ROWS):
            v, _ = self.pooled(x[lo:lo + ROWS], live[lo:lo + ROWS])
            who = owner[lo:lo + ROWS]
            np.maximum.at(top, who, v)
            np.add.at(total, who, v)
        n = np.bincount(owner, minlength=len(texts))
        return self.head(top, (total / n[:, None]).astype(np.float32))[2].astype(np.float64)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.intercept, -30, 30)))

    def gradients(self, x, live, owner, y, weight) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted cross-entropy of the documents and its gradients; below
        the pooling they flow only through the positions that won."""
        n = len(y)
        v, at = self.pooled(x, live)
        count = np.bincount(owner, minlength=n).astype(np.float32)
        mean = np.zeros((n, FILTERS), v.dtype)
        np.add.at(mean, owner, v)
        mean /= count[:, None]
        top = np.zeros((n, FILTERS), v.dtype)
        np.maximum.at(top, owner, v)
        f, h, z = self.head(top, mean)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
        dz = (weight * (p - y)).astype(np.float32)
        dh = np.outer(dz, self.w["o"]) * (1 - h * h)
        df = dh @ self.w["H"].T
        g = {"o": h.T @ dz, "c": np.array([dz.sum()], np.float32), "H": f.T @ dh, "h": dh.sum(0)}
        won = v >= top[owner]
        won &= v > 0
        share = np.zeros((n, FILTERS), np.float32)
        np.add.at(share, owner, won.astype(np.float32))
        dv = np.where(won, df[owner, :FILTERS] / np.maximum(share[owner], 1), 0) + df[owner, FILTERS:] / count[owner, None]
        dv = np.where(v > 0, dv, 0)
        g["b"] = dv.sum(0)
        g["W"], g["E"] = np.empty_like(self.w["W"]), np.zeros_like(self.w["E"])
        rows = np.arange(len(x))[:, None]
        for k in range(SPAN):
            byte = np.stack([x[rows, (at + k) * STRIDE + j] for j in range(STRIDE)], -1)
            e = self.w["E"][byte].reshape(len(x), FILTERS, STRIDE * EMBED)
            g["W"][k] = np.einsum("nfd,nf->df", e, dv)
            de = (dv[:, :, None] * self.w["W"][k].T[None]).reshape(len(x), FILTERS, STRIDE, EMBED)
            np.add.at(g["E"], byte.ravel(), de.reshape(-1, EMBED))
        return loss, g


def train(texts: list[bytes], y: np.ndarray, rate: dict[int, float], cfg: Settings = Settings()) -> Network:
    """Adam on batches with both labels in equal number; the held part of the
    sample then calibrates the output to the labels' own ``rate``."""
    net = Network(seed=cfg.seed)
    if not len(texts) or y.min() == y.max():
        net.slope, net.intercept = 0.0, (30.0 if len(texts) and y.min() == 1 else -30.0)
        return net
    r = np.random.default_rng(cfg.seed)
    held = np.zeros(len(texts), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        held[r.permutation(own)[:int(len(own) * cfg.held)]] = True
    x, live, owner = chunks(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    pools = [np.flatnonzero((y == c) & ~held) for c in (0, 1)]
    m = {k: np.zeros_like(w) for k, w in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    for i in range(1, cfg.rounds + 1):
        docs = np.concatenate([r.choice(p, cfg.batch // 2) for p in pools])
        own = [np.arange(first[d], first[d + 1]) for d in docs]
        own = [o if len(o) <= cfg.chunks else np.sort(r.choice(o, cfg.chunks, replace=False)) for o in own]
        pick = np.concatenate(own)
        who = np.repeat(np.arange(len(docs)), [len(o) for o in own])
        _, g = net.gradients(x[pick], live[pick], who, y[docs].astype(np.float32), np.full(len(docs), 1 / len(docs), np.float32))
        rate_i = cfg.rate * min(1.0, i / 20) * (1 - 0.9 * i / cfg.rounds)
        for k, d in g.items():
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            net.w[k] -= (rate_i * ((m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.99 ** i)) + 1e-7) + cfg.decay * net.w[k])).astype(np.float32)
    use = held if held.any() and y[held].min() != y[held].max() else ~held
    z = net.logits([t for t, u in zip(texts, use, strict=True) if u])
    net.slope, net.intercept = _calibrate(z, y[use].astype(float), rate)
    return net


def _calibrate(z: np.ndarray, y: np.ndarray, rate: dict[int, float]) -> tuple[float, float]:
    """Ridge logistic fit of the output, weighted to the labels' rates."""
    w = np.where(y == 1, rate[1] / (y == 1).sum(), rate[0] / (y == 0).sum()) * len(y) / (rate[0] + rate[1])
    d, b = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ b, -30, 30)))
        hess = (d * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ d + 1e-2 * np.eye(2)
        b -= np.clip(np.linalg.solve(hess, d.T @ (w * (p - y)) + 1e-2 * np.array([b[0], 0.0])), -1, 1)
    return float(b[0]), float(b[1])


def fit(labelled: DataFrame, cfg: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Learn from rows of text and label (0, 1; null labels are left out).
    The driver gets at most about ``per_label`` texts a label, of each at most
    ``pieces`` pieces that a hash of id and place picks from the whole text.
    With one label or none, the score is that label (0 for none)."""
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"))
    rate = {0: 0.0, 1: 0.0} | {r["y"]: float(r["count"]) for r in rows.groupBy("y").count().collect()}
    places = f"slice(array_sort(transform(sequence(0, (length(text) - 1) div {STEP}), i -> struct(xxhash64(id, i) as h, i as i))), 1, {cfg.pieces})"
    drawn = F.expr(f"concat_ws('', transform(array_sort(transform({places}, p -> p.i)), i -> substring(text, cast(i * {STEP} + 1 as int), {STEP})))")
    got = one_sample(rows, F.col("y"), F.col("id"), cfg.per_label).select("y", F.when(F.length("text") > 0, drawn).otherwise("").alias("t")).collect()
    got.sort(key=lambda r: (r["y"], r["t"]))
    return train([r["t"].encode() for r in got], np.array([r["y"] for r in got], np.int64), rate, cfg)


def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` columns, score (0 to 1) and predicted of every
    whole text; no shuffle.

    A null text scores as an empty one, which has one chunk without bytes.
    Memory follows the longest text; repeated rows score alike; an empty
    table gives an empty result; other columns stay unread."""
    ship(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    weights, slope, intercept = net.w, net.slope, net.intercept

    def run(it):
        only("quality_cnn")
        model = Network(weights, slope, intercept)
        for b in batches(it, STEP_BYTES, "__text"):
            p = model.probabilities([(t or "").encode() for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                             names=[id_col, *keep, "score", "predicted"])

    rows = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")

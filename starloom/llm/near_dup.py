"""Near-duplicate groups by consistent weighted sampling.

A document is the weighted set of its five-word shingles, weighted by term
frequency times inverse document frequency.  Improved consistent weighted
sampling draws ``SAMPLES`` (shingle, level) samples from it; two documents
agree on a sample with the probability of their weighted Jaccard similarity.
Four samples make a band; documents that share a band are candidates, and two
candidates are linked if their exact weighted Jaccard similarity reaches the
threshold.  Linked documents form a group.

No pair of candidates is ever written down.  Each text of a bucket points to
the bucket's first text; what hangs together that way is a family.  A family
that fits a block goes to one task with its texts, where a matrix product of
shared shingles gives the exact similarity of all its pairs, and one row per
text comes out: its group.  A larger family is cut into blocks, then one
member of each group goes into new blocks, again and again while that joins
groups.  What is then still apart is compared exactly: every text outside the
largest group of a unit with all of the unit, block by block.  A unit is the
family or, where that ships less text, each of its buckets.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, holds, maybe_in, only, ship, written

WORD = re.compile(r"\w+")
STEP_BYTES = 1 << 20
#: Samples of a signature, samples of a band.
SAMPLES, ROWS = 64, 4
BANDS = SAMPLES // ROWS
#: Rows and columns of the document-frequency sketch, and entries of the random tables.
SKETCH_ROWS, SKETCH, TABLE = 4, 1 << 17, 1 << 16
#: Texts and characters of a block, and shingles of a step of the matrix product.
BLOCK, BLOCK_CHARS, COLUMNS = 512, 4 << 20, 2048
#: Similarities are sums of doubles in any order.
ROUNDING = 1e-9
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    #: Share of documents up to which a shingle has full weight, and the least weight.
    common: float = 0.05
    floor: float = 0.5


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class _Words(dict):
    """64-bit hash of each word met; bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_WORDS = _Words()
holds("near_dup", _WORDS)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(docs: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, shingle hash and count, sorted by document and hash,
    each shingle of a document once.  Fewer than ``k`` words make one shingle;
    no word makes none."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.fromiter((h for d in docs for h in map(_WORDS.__getitem__, d)), U, int(size.sum()))
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(docs)), size)
    n = max(0, len(flat) - k + 1)
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ flat[j:j + n]) * MIX
            h ^= h >> U(29)
        whole = np.arange(n) + k <= (start + size)[owner[:n]] if n else np.zeros(0, bool)
        hashes, at = [h[whole]], [owner[:n][whole]]
        for i in np.flatnonzero((size > 0) & (size < k)):
            x = U(int(size[i]))
            for w in flat[start[i]:start[i] + size[i]]:
                x = (x ^ w) * MIX
                x ^= x >> U(29)
            hashes.append(np.array([x], U))
            at.append(np.array([i], np.int64))
        h = _mix(np.concatenate(hashes))
    d = np.concatenate(at)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return d[first], h[first], np.diff(first, append=len(h))


def _cells(h: np.ndarray) -> list[np.ndarray]:
    """Column of each shingle in every row of the sketch."""
    return [(h >> U(3 + 15 * row)).astype(np.int64) & (SKETCH - 1) for row in range(SKETCH_ROWS)]


class Weights:
    """Weight of a shingle: its count times its inverse document frequency,
    from a count-min sketch of the document frequencies of the whole corpus."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    @staticmethod
    def of(counts: np.ndarray, n_docs: int, cfg: Settings) -> "Weights":
        """``counts``: documents per cell (SKETCH_ROWS x SKETCH), each distinct
        shingle of a document counted once.  A shingle's frequency is its least
        cell, less the mean load of the other cells.  That load is the shingles
        of a mean document over SKETCH, as a share of the documents, at any
        corpus size: 0.4 % at 500 shingles, far below ``common``, up to which
        the weight is full."""
        counts = counts.reshape(SKETCH_ROWS, SKETCH)
        noise = (counts.sum(1, keepdims=True) - counts) / max(1, SKETCH - 1)
        df = np.maximum(1.0, counts - noise)
        full = math.log1p(1 / cfg.common)
        return Weights(np.clip(np.log1p(max(1, n_docs) / df) / full, cfg.floor, 1.0))

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        cells = _cells(h)
        out = self.idf[0][cells[0]]
        low = np.flatnonzero(out < 1)  # the least cell has the largest weight
        for row in range(1, SKETCH_ROWS):
            out[low] = np.maximum(out[low], self.idf[row][cells[row][low]])
        return tf * out


def _tables() -> tuple[np.ndarray, ...]:
    """Random draws of the sampling, addressed by 16 bits of a mixed hash:
    r and c from Gamma(2, 1), b from U(0, 1), and the ready order key of
    weight 1 (level 0)."""
    g = np.random.default_rng(20100)
    r, c, b = g.gamma(2, 1, TABLE), g.gamma(2, 1, TABLE), g.random(TABLE)
    return r, np.log(c), b, _order(np.log(c) - r * (1 - b))


def _order(x: np.ndarray) -> np.ndarray:
    """Log-values as the upper half of sortable integers."""
    return np.clip((x + 64) * float(1 << 23), 0, (1 << 31) - 1).astype(np.int64) << 32


R, LOG_C, B, ONE = _tables()
SEEDS = _mix((np.arange(1, SAMPLES + 1, dtype=U) * MIX) ^ U(0xABCDEF)) | U(1)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Samples of each document, (n_docs, SAMPLES) unsigned 32-bit; documents
    without a shingle keep zeros."""
    out = np.zeros((n_docs, SAMPLES), np.uint32)
    if not len(doc):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    odd = np.flatnonzero(weight != 1)
    log_w = np.log(weight[odd])
    low = (h & U(0xFFFFFFFF)).astype(np.int64)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            at = ((h * SEEDS[k]) >> U(48)).astype(np.int64)
            key = ONE[at] | low
            if len(odd):
                i = at[odd]
                t = np.floor(log_w / R[i] + B[i])
                level = (t.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF
                key[odd] = _order(LOG_C[i] - R[i] * (t - B[i] + 1)) | (low[odd] ^ level)
            out[doc[first], k] = (np.minimum.reduceat(key, first) & 0xFFFFFFFF).astype(np.uint32)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    with np.errstate(over="ignore"):
        x = np.zeros((len(sig), BANDS), U)
        for j in range(ROWS):
            x = _mix((x ^ sig[:, j::ROWS].astype(U)) * MIX + U(j + 1))
    return x.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes, weights), hashes sorted."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    rest = float(a[1].sum() + b[1].sum()) - least
    return least / rest if rest > 0 else 0.0


def _sketch(docs: DataFrame, cfg: Settings) -> tuple[np.ndarray, int]:
    """Documents per cell and number of documents with a shingle.  Each task
    adds up its own; the result has SKETCH_ROWS x SKETCH entries at any size."""
    size = SKETCH_ROWS * SKETCH

    def run(it):
        only("near_dup")
        counts, n = np.zeros(size, np.int64), 0
        for b in batches(it, STEP_BYTES):
            d, h, _ = shingles([words_of(t) for t in b.column(1).to_pylist()], cfg.shingle)
            for row, cell in enumerate(_cells(h)):
                counts[row * SKETCH:(row + 1) * SKETCH] += np.bincount(cell, minlength=SKETCH)
            n += len(np.unique(d))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], n), pa.int64())], names=["k", "n"])

    total = docs.select("id", "text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    at, n = total.column("k").to_numpy(), total.column("n").to_numpy()
    counts = np.zeros(size)
    counts[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


def _signed(docs: DataFrame, weights, cfg: Settings) -> DataFrame:
    """id, hash of the text, key of the word sequence, characters and bands of
    documents that have a word."""
    def run(it):
        only("near_dup")
        w = weights.value
        for b in batches(it, STEP_BYTES):
            texts = b.column(1).to_pylist()
            docs_ = [words_of(t) for t in texts]
            d, h, tf = shingles(docs_, cfg.shingle)
            sig = signatures(d, h, w(h, tf), len(docs_))
            use = np.flatnonzero([bool(x) for x in docs_])
            keys = [xxhash.xxh3_128_digest(" ".join(docs_[i])) for i in use]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(use)), b.column(2).take(pa.array(use)), pa.array(keys, pa.binary()),
                 pa.array([len(texts[i]) for i in use], pa.int64()), pa.array(list(bands(sig[use])), pa.list_(pa.int64()))],
                names=["id", "hash", "key", "chars", "bands"])

    return docs.select("id", "text", "hash").mapInArrow(run, "id long, hash long, key binary, chars long, bands array<long>")


class Vectors:
    """Weighted shingles of some texts, as features: a shingle that a text
    holds k times is k features of its weight, so that the weight two texts share is
    that of the features they share."""

    def __init__(self, texts: list[str], weights: Weights, k: int):
        doc, h, tf = shingles([words_of(t) for t in texts], k)
        weight = weights(h, np.ones(len(h)))
        self.total = np.bincount(doc, tf * weight, minlength=len(texts))
        at = np.repeat(np.arange(len(h)), tf)
        level = (np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf)).astype(U)
        with np.errstate(over="ignore"):
            self.key = np.where(level == 0, h[at], _mix(h[at] + level * MIX))
        self.doc, self.weight = doc[at], weight[at]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def of(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document (from 0), key and weight of the features of texts lo to hi."""
        s = slice(self.first[lo], self.first[hi])
        return self.doc[s] - lo, self.key[s], self.weight[s]

    def similar(self, a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
        """Exact weighted Jaccard similarity of texts a[0] to a[1] with b[0] to b[1]."""
        na, nb = a[1] - a[0], b[1] - b[0]
        (da, ka, wa), (db, kb, _) = self.of(*a), self.of(*b)
        names, of_a = np.unique(ka, return_inverse=True)
        at = np.minimum(np.searchsorted(names, kb), max(0, len(names) - 1))
        ok = names[at] == kb if len(names) else np.zeros(len(kb), bool)
        db, of_b = db[ok], at[ok]
        # features of both sides, numbered
        both = np.zeros(len(names), bool)
        both[of_b] = True
        if a == b:  # a feature of one text alone joins no pair
            both &= np.bincount(of_a, minlength=len(names)) > 1
        number = np.cumsum(both) - 1
        ok = both[of_a]
        da, of_a, wa = da[ok], number[of_a[ok]], wa[ok]
        ok = both[of_b]
        db, of_b = db[ok], number[of_b[ok]]
        order_a, order_b = np.argsort(of_a, kind="stable"), np.argsort(of_b, kind="stable")
        da, of_a, wa, db, of_b = da[order_a], of_a[order_a], wa[order_a], db[order_b], of_b[order_b]
        shared = np.zeros((na, nb))
        for lo in range(0, int(both.sum()), COLUMNS):
            sa, sb = (slice(*np.searchsorted(x, [lo, lo + COLUMNS])) for x in (of_a, of_b))
            x, y = np.zeros((na, COLUMNS)), np.zeros((nb, COLUMNS))
            x[da[sa], of_a[sa] - lo] = wa[sa]
            y[db[sb], of_b[sb] - lo] = 1
            shared += x @ y.T
        rest = self.total[a[0]:a[1], None] + self.total[None, b[0]:b[1]] - shared
        return np.divide(shared, rest, out=np.zeros_like(shared), where=rest > 0)


def _labels(link: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches over a symmetric matrix of links."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None], len(link)).min(1, initial=len(link)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _runs(it, n_keys: int, text: int):
    """Rows of sorted batches in lists that end with a key, of STEP_BYTES of
    texts or one key; each list with the places where its keys begin."""
    rows, starts, held, last = [], [], 0, None
    for b in it:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols):
            if row[:n_keys] != last:
                if held > STEP_BYTES:
                    yield rows, [*starts, len(rows)]
                    rows, starts, held = [], [], 0
                last = row[:n_keys]
                starts.append(len(rows))
            rows.append(row)
            held += len(row[text])
    if rows:
        yield rows, [*starts, len(rows)]


def _grouped(blocks: DataFrame, weights, cfg: Settings) -> DataFrame:
    """tid, rep (the smallest tid of its group in the block), family and parts
    of texts in blocks (family, part): every pair of a block is compared."""
    def run(it):
        only("near_dup")
        w = weights.value
        for rows, starts in _runs(it, 2, 4):
            vec = Vectors([r[4] for r in rows], w, cfg.shingle)
            tid = np.array([r[2] for r in rows], np.int64)
            rep = tid.copy()
            for lo, hi in zip(starts, starts[1:]):
                if hi - lo > 1:
                    link = vec.similar((lo, hi), (lo, hi)) >= cfg.threshold - ROUNDING
                    link |= tid[lo:hi, None] == tid[None, lo:hi]
                    label = _labels(link)
                    least = np.full(hi - lo, np.iinfo(np.int64).max)
                    np.minimum.at(least, label, tid[lo:hi])
                    rep[lo:hi] = least[label]
            yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(rep), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                                             names=["tid", "rep", "family", "parts"])

    cols = ["family", "part"]
    dealt = blocks.select(*cols, "tid", "parts", "text").repartition(*cols).sortWithinPartitions(*cols)
    return dealt.mapInArrow(run, "tid long, rep long, family long, parts long")


def _crossed(tasks: DataFrame, weights, cfg: Settings) -> DataFrame:
    """Links (a, b) between different groups, from tasks (task, side, tid,
    group, text): every text of side 0 is compared with all of side 1."""
    def run(it):
        only("near_dup")
        w = weights.value
        for rows, starts in _runs(it, 1, 4):
            vec = Vectors([r[4] for r in rows], w, cfg.shingle)
            tid, group = (np.array([r[c] for r in rows], np.int64) for c in (2, 3))
            side = np.array([r[1] for r in rows])
            out: list[tuple[int, int]] = []
            for lo, hi in zip(starts, starts[1:]):
                mid = lo + int(np.searchsorted(side[lo:hi], 1))
                if lo < mid < hi:
                    ok = (vec.similar((lo, mid), (mid, hi)) >= cfg.threshold - ROUNDING) & (group[lo:mid, None] != group[None, mid:hi])
                    found = {(group[lo + i], group[mid + j]): (int(tid[lo + i]), int(tid[mid + j])) for i, j in zip(*np.nonzero(ok))}
                    out += found.values()  # one link for two groups
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = tasks.select("task", "side", "tid", "group", "text").repartition("task").sortWithinPartitions("task", "side")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _parts(n, chars):
    """Blocks that so many texts and characters need."""
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(chars / F.lit(BLOCK_CHARS)))


def _apart(state: DataFrame, buckets: DataFrame, sizes: DataFrame, texts: DataFrame, weights, cfg: Settings) -> DataFrame:
    """Links that the blocks of large families left open.  ``state``: tid,
    family, group; ``buckets``: tid, band, h; ``sizes``: tid, chars.

    A unit is a family or one of its buckets.  In each unit with several
    groups the texts outside the largest one meet all texts, block by block;
    of a family's two kinds of units the one is taken that ships less text."""
    one = state.join(sizes, "tid")
    unit = ["family", "band", "h"]
    rows = one.withColumn("band", F.lit(-1)).withColumn("h", F.lit(0).cast("long")).unionByName(one.join(buckets, "tid"))
    by_group = rows.groupBy(*unit, "group").agg(F.count("*").alias("m"), F.sum("chars").alias("c"))
    main = by_group.groupBy(*unit).agg(F.max_by("group", F.struct("m", "group")).alias("main"), F.count("*").alias("groups"), F.sum("m").alias("n"),
                                       F.sum("c").alias("all_chars"), F.max(F.struct("m", "group", "c")).alias("top")).filter("groups > 1")
    main = main.withColumn("rest_n", F.col("n") - F.col("top.m")).withColumn("rest_chars", F.col("all_chars") - F.col("top.c")).drop("top", "groups")
    main = main.withColumn("whole_parts", _parts(F.col("n"), F.col("all_chars"))).withColumn("rest_parts", _parts(F.col("rest_n"), F.col("rest_chars")))
    main = main.withColumn("ships", F.col("rest_parts") * F.col("all_chars") + F.col("whole_parts") * F.col("rest_chars"))
    cost = main.groupBy("family").agg(*(F.sum(F.when(c, F.col("ships")).otherwise(0)).alias(n) for c, n in ((F.col("band") < 0, "by_family"), (F.col("band") >= 0, "by_bucket"))))
    chosen = written(main.join(cost, "family").filter(F.when(F.col("by_family") <= F.col("by_bucket"), F.col("band") < 0).otherwise(F.col("band") >= 0))
                     .select(*unit, "main", "whole_parts", "rest_parts"), "dup-units")
    open_ = rows.join(chosen, unit)
    place = lambda parts: F.pmod(F.xxhash64("tid"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    rest = open_.filter(F.col("group") != F.col("main")).withColumn("r", place("rest_parts")).withColumn("w", every("whole_parts")).withColumn("side", F.lit(0))
    whole = open_.withColumn("w", place("whole_parts")).withColumn("r", every("rest_parts")).withColumn("side", F.lit(1))
    task = F.concat_ws("/", *unit, "r", "w").alias("task")
    both = rest.select(task, "side", "tid", "group").unionByName(whole.select(task, "side", "tid", "group"))
    return _crossed(both.join(texts.select("tid", "text"), "tid"), weights, cfg)


def _same_id(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the texts of an id that has several."""
    several = signed.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("id")
    held = signed.select("id", "key").join(several, "id").join(texts.select("key", "tid"), "key")
    least = held.groupBy("id").agg(F.min("tid").alias("a"))
    return written(held.join(least, "id").select("a", F.col("tid").alias("b")).filter("a <> b").distinct(), "dup-i")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """id, group (the smallest id reached): neighbours' minima and pointer
    jumping, each round written to the shared folder."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), tag)
    at = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")), tag)
    while True:
        near = both.join(at.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        low = at.join(near, "id").select("id", "group", F.least("group", "near").alias("low"))
        up = at.select(F.col("id").alias("low"), F.col("group").alias("up"))
        new = written(low.join(up, "low").select("id", F.least("low", "up").alias("group"), (F.least("low", "up") < F.col("group")).alias("moved")), tag)
        if not new.filter("moved").head(1):
            return new.select("id", "group")
        at = new.select("id", "group")


def near_duplicates(docs: DataFrame, cfg: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, class_id (the smallest id of the group) and text_id (the
    smallest id with the same word sequence) for every row with an id.

    Documents with the same words are one text from the start, whatever their
    number; only distinct texts are compared, and their groups spread back
    over the copies.  A null or empty text, or one without a word, is a class
    of its own.  Rows that repeat an id belong to one document if their texts
    are alike and are otherwise linked through that id.  An empty table gives
    an empty result; other columns stay unread (a column class_id or text_id
    of the input too).  Groups are sets named by their smallest id, so there are
    no ties.  A very long text is compared whole, in a block of its own if it fills one.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("id is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    counts, n_docs = _sketch(rows, cfg)
    weights = spark.sparkContext.broadcast(Weights.of(counts, n_docs, cfg))  # SKETCH_ROWS x SKETCH entries at any size
    signed = written(_signed(rows, weights, cfg), "dup-s")
    one = signed.groupBy("key").agg(F.min(F.struct("id", "hash", "chars", "bands")).alias("one"))
    texts = written(one.select("key", "one.*").withColumn("tid", F.monotonically_increasing_id()), "dup-k")  # numbers hold once written

    # families: what hangs together through the first text of each bucket
    in_band = texts.select("tid", F.posexplode("bands").alias("band", "h"))
    hubs = in_band.groupBy("band", "h").agg(F.min("tid").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    met = written(in_band.join(hubs.drop("n"), ["band", "h"]), "dup-b")
    # a text points to its lowest hub, and its other hubs do, each pair of hubs once: about one edge a text, not one a band
    low = met.groupBy("tid").agg(F.min("hub").alias("low"))
    others = met.select("tid", "hub").join(low, "tid").select(F.col("hub").alias("a"), F.col("low").alias("b"))
    star = low.select(F.col("tid").alias("a"), F.col("low").alias("b")).unionByName(others.distinct())
    family = components(star.filter("a <> b").distinct(), "dup-f")
    known = family.select(F.col("id").alias("tid"), F.col("group").alias("family")).join(texts.select("tid", "id", "hash", "chars"), "tid")
    parts = known.groupBy("family").agg(_parts(F.count("*"), F.sum("chars")).alias("parts"))
    needed = written(known.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts"))), "dup-n")
    near = maybe_in(rows, needed.select("id"), "id").filter("__maybe").select("id", "text", "hash")
    held = written(near.join(needed, ["id", "hash"]).select("tid", "family", "part", "parts", "text"), "dup-t")

    state = written(_grouped(held, weights, cfg), "dup-g")
    edges = state.select(F.col("tid").alias("a"), F.col("rep").alias("b"))
    state = state.filter("parts > 1").select("tid", "family", F.col("rep").alias("group")).distinct()
    if state.head(1):
        large = held.filter("parts > 1")
        sizes = needed.filter("parts > 1").select("tid", "chars")
        least = state.select("family", "group").distinct().count()
        while True:  # one member of each group, in new blocks
            reps = state.select("family", F.col("group").alias("tid")).distinct().join(sizes, "tid")
            cut = reps.groupBy("family").agg(_parts(F.count("*"), F.sum("chars")).alias("parts"))
            dealt = reps.join(cut, "family").withColumn("part", F.pmod(F.xxhash64("tid", F.lit(least)), F.col("parts")))
            joined = written(_grouped(dealt.join(large.select("tid", "text"), "tid"), weights, cfg), "dup-r")
            state = written(state.join(joined.select(F.col("tid").alias("group"), "rep").distinct(), "group").select("tid", "family", F.col("rep").alias("group")), "dup-g")
            now, many = state.select("family", "group").distinct().count(), bool(joined.filter("parts > 1").head(1))
            if not many or now > 0.8 * least:  # the rest is compared in full
                break
            least = now
        more = _apart(state, met.select("tid", "band", "h"), sizes, large, weights, cfg)
        edges = edges.unionByName(state.select(F.col("tid").alias("a"), F.col("group").alias("b"))).unionByName(more)
    edges = written(edges.filter("a <> b").unionByName(_same_id(signed, texts)).distinct(), "dup-e")
    groups = texts.select("tid", "id", "key").join(components(edges, "dup-c").withColumnRenamed("id", "tid"), "tid", "left")
    groups = groups.withColumn("group", F.coalesce("group", "tid"))
    classes = groups.groupBy("group").agg(F.min("id").alias("class_id"))
    by_text = groups.join(classes, "group").select("key", F.col("id").alias("text_id"), "class_id")
    placed = signed.select("id", "key").join(by_text, "key").groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("text_id").alias("text_id"))
    out = rows.select("id").join(placed, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("text_id", "id").alias("text_id"))

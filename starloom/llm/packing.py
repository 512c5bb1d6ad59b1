"""Vector best-fit packing of token pieces into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths).  Items go longest first into the open bin that takes
them under every capacity and scores best, by the weighted dot product of the
item with the bin's residual or by the weighted norm of what would be left.

An item's three demands depend on its length alone, so the plan is made on
the histogram of lengths: at most one row per length, whatever the number of
documents.  Bins with equal residuals form one group, and a step of the plan
says "the next n items of this length go j to a bin into these bins".  Spark
then numbers the items of each length across partitions and looks each one's
place up in the plan.  The result equals packing all items in one list.
"""
from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Pool, by_chunk, split_chunks, text_ids
from .common import batches, holds, only, ship, written
from .token_counts import byte_letters

#: Words, and chunks between white space, that a task's tokenizer keeps with their ids.
CACHE_WORDS = 300_000
STEP_BYTES = 4 << 20


class WordTokenizer:
    """Token ids of a ``tokenizers`` file.

    For a file whose own steps drop white space and never join what it
    separates (compared on opening), each distinct chunk of a batch is split
    and each distinct word encoded by the file's model once; for any other
    file the library encodes whole texts."""

    #: Printable stand-ins for bytes.
    STAND_IN = {b: c for c, b in byte_letters().items() if ord(c) != b}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_chunk = by_chunk(json.load(f))
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.words = Pool(self._encode_words, CACHE_WORDS)
        self.chunks = Pool(lambda new: self.words.gather_cut(split_chunks(new, self.special, lambda c: [(c,)])), CACHE_WORDS)

    def _encode_words(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; a chunk that is not plain comes whole, as a tuple."""
        model, out = self.tok.model, []
        for w in words:
            if isinstance(w, tuple):
                out.append(self.tok.encode(w[0], add_special_tokens=False).ids)
            else:
                out.append([t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.STAND_IN))])
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for ids in out for i in ids), np.uint32, int(size.sum())), size

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        if self.by_chunk:
            return text_ids(texts, self.chunks)
        got = [np.asarray(self.tok.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}
holds("packing", _TOKENIZERS)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32.

    A document's ids end with ``end_id``; only documents of more than
    ``max_tokens`` ids are cut, and only their last piece may be shorter.  A
    null text counts as empty (one piece holding ``end_id``).
    """
    ship(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(it):
        only("packing")
        tok = tokenizer(tokenizer_path)
        for b in batches(it, STEP_BYTES):
            rows, piece, start, length, crc = [], [], [], [], []
            flat, at = tok.ids(b.column(1))
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                ids = memoryview(flat[a:z].astype("<u4", copy=False).tobytes() + tail)
                for k, lo in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[lo:lo + 4 * max_tokens]
                    rows.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Capacity:
    """What a bin holds, and how the three residuals weigh in the choice."""
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


@dataclass
class Plan:
    """Steps, sorted by (size, first): items first, first + 1, ... of a size go
    ``each`` to a bin from ``bin`` on, the first of them at ``offset``."""
    size: np.ndarray
    first: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = int(rank.max(initial=0)) + 1
        if int(self.size.max(initial=0)) * max(scale, int(self.first.max(initial=0)) + 1) < 2 ** 62:
            scale = max(scale, int(self.first.max(initial=0)) + 1)
            at = np.searchsorted(self.size * scale + self.first, size * scale + rank, side="right") - 1
        else:  # one size at a time
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                lo, hi = np.searchsorted(self.size, [s, s + 1])
                m = size == s
                at[m] = lo + np.searchsorted(self.first[lo:hi], rank[m], side="right") - 1
        t = rank - self.first[at]
        return self.bin[at] + t // self.each[at], self.offset[at] + (t % self.each[at]) * size


def make_plan(histogram: dict[int, int], cap: Capacity) -> Plan:
    """Best-fit decreasing on (length -> number of items)."""
    full = cap.vector()
    w = np.asarray(cap.weights, float)
    rest = np.empty((0, 3), np.int64)          # residuals of each group of open bins
    groups: list[list[tuple[int, int]]] = []   # the groups' bins as (first bin, number)
    index: dict[tuple[int, int, int], int] = {}
    steps: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(residual: np.ndarray, lo: int, n: int):
        nonlocal rest
        key = tuple(int(x) for x in residual)
        if n <= 0 or key[0] <= 0 or key[1] <= 0 or key[2] <= 0:
            return
        if key not in index:
            index[key] = len(groups)
            groups.append([])
            rest = np.vstack([rest, residual])
        groups[index[key]].append((lo, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        need = np.array([size, 1, size * size], np.int64)
        if (need > full).any():
            raise ValueError(f"an item of {size} tokens exceeds a bin's capacity")
        while left:
            g = -1
            if len(groups):
                fits = np.flatnonzero((rest >= need).all(1))
                if len(fits):
                    if cap.rule == "dot":
                        score = -((rest[fits] / full) * (need / full) * w).sum(1)
                    else:
                        score = (w * ((rest[fits] - need) / full) ** 2).sum(1)
                    g = int(fits[np.argmin(score)])
            if g < 0:
                each = int((full // need).min())
                n_bins = -(-left // each)
                steps.append((size, rank, each, bins, 0))
                whole, odd = divmod(left, each)
                put(full - each * need, bins, whole)
                if odd:
                    put(full - odd * need, bins + whole, 1)
                bins += n_bins
                break
            lo, n = groups[g].pop()
            residual = rest[g].copy()
            each = int((residual // need).min())
            take = min(left, n * each)
            whole, odd = divmod(take, each)
            steps.append((size, rank, each, lo, cap.tokens - int(residual[0])))
            put(residual - each * need, lo, whole)
            if odd:
                put(residual - odd * need, lo + whole, 1)
            put(residual, lo + whole + bool(odd), n - whole - bool(odd))
            left -= take
            rank += take
            if not groups[g]:  # drop the empty group
                last = len(groups) - 1
                del index[tuple(int(x) for x in rest[g])]
                if g != last:
                    index[tuple(int(x) for x in rest[last])] = g
                    groups[g], rest[g] = groups[last], rest[last]
                groups.pop()
                rest = rest[:last]
    steps.sort()
    cols = np.array(steps, np.int64).reshape(-1, 5).T.copy()
    return Plan(cols[0], cols[1], cols[2], cols[3], cols[4], bins)


def best_fit(items: DataFrame, cap: Capacity = Capacity(), *, size_col: str = "length") -> DataFrame:
    """``items`` with sequence_id and offset (its place there, gapless from 0).

    Two shuffles of the items' own rows never happen at once: the items are
    written once with their position among the items of their length in their
    partition; counts per (partition, length) give each partition's offset in
    the length's numbering; one join by (partition, length) brings it back.
    Only the histogram of lengths (at most ``cap.tokens`` rows) reaches the
    driver, and the plan made of it the tasks.

    Every size must be from 1 to ``cap.tokens``; a null one is an error.  An empty table gives an
    empty result; repeated rows are packed each on its own.
    """
    spark = items.sparkSession
    ship(spark)
    names = items.columns
    clash = {"sequence_id", "offset", "__part", "__at", "__base"} & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    at_size = names.index(size_col)

    def number(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(cap.tokens + 1, np.int64)
        for b in it:
            if b.column(at_size).null_count:
                raise ValueError(f"column {size_col!r} holds nulls")
            size = b.column(at_size).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(size, kind="stable")
            s = size[order]
            new = np.flatnonzero(np.diff(s, prepend=-1))
            run = np.arange(len(s)) - np.repeat(new, np.diff(new, append=len(s)))
            at = np.empty(len(s), np.int64)
            at[order] = seen[s] + run
            np.add.at(seen, size, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(at)],
                                             names=[*names, "__part", "__at"])

    numbered = written(items.mapInArrow(number, f"{kinds}, __part int, __at long"), "pack")
    per_part = numbered.groupBy("__part", size_col).agg(F.count("*").alias("__n"))
    histogram = {r[0]: r[1] for r in per_part.groupBy(size_col).agg(F.sum("__n")).collect()}
    plan = make_plan(histogram, cap)
    shared = spark.sparkContext.broadcast(plan)  # a few steps per length, not per item
    w = Window.partitionBy(size_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")

    def place(it):
        p = shared.value
        for b in it:
            size = b.column(at_size).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            seq, off = p.place(size, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ranked = numbered.join(base, ["__part", size_col]).select(*names, (F.col("__base") + F.col("__at")).alias("__rank"))
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")

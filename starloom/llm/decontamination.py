"""Benchmark decontamination: BM25 over the test items, block-max WAND.

The index holds the benchmark, not the corpus: for every term the items that
use it, each with its BM25 impact divided by the item's own full score, so
that a passage's score says what part of the item's weighted terms it covers.
Every document is cut into overlapping passages, such that any run of words
as long as the longest item lies whole in one of them.  Every passage queries
the index and retrieves all items that reach the threshold; a hit counts when
the passage covers both the item's question and its answer, or the whole of an
item that marks no answer, by word runs or by words in their order, so that a
few edited words do not hide an item.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, only, ship

WORD = re.compile(r"[^\W_]+")
ANSWER, ASKED = re.compile(r"(?i)\banswer\s*:"), re.compile(r"\?(?=\s+\S)")
STEP_BYTES = 512 << 10
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    #: Part of an item's full BM25 score that a passage must reach.
    threshold: float = 0.5
    #: Words of a run, and the part of the question's and of the answer's runs, or words in order, that must occur in the passage.
    run: int = 3
    question: float = 0.6
    answer: float = 0.6
    #: Items of a posting block, and neighbouring items that share one bound when many passages are bounded at once.
    block: int = 16
    span: int = 2
    #: Characters of benchmark text in one index; a larger benchmark is searched index by index, all with the same statistics.
    index_chars: int = 32 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: cut at an answer mark, else
    after the last question mark, else before the last sentence, else at two
    thirds of the words."""
    m = ANSWER.search(text)
    if m is None:
        marks = list(ASKED.finditer(text)) or list(re.finditer(r"[.!](?=\s+\S)", text))
        m = marks[-1] if marks else None
    q, a = (words_of(text[:m.start()]), words_of(text[m.end():])) if m else ([], [])
    if len(q) < 3 or len(a) < 3:
        w = words_of(text)
        cut = max(1, len(w) * 2 // 3)
        q, a = w[:cut], w[cut:]
    return q, a


def answer_size(text: str) -> int:
    """Words after the answer mark or the last question mark; 0 in an item
    with neither, which has no answer of its own."""
    m = ANSWER.search(text) or next(reversed(list(ASKED.finditer(text))), None)
    return len(words_of(text[m.end():])) if m and len(words_of(text[:m.start()])) >= 3 else 0


def _runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


def _share(part: list[str], words: list[str], run: int) -> float:
    want = _runs(part, run)
    return len(want & _runs(words, min(run, len(part)))) / len(want) if want else 1.0


def in_order(part: list[str], words: list[str], weight: dict[str, float], least: float) -> float:
    """Largest share of ``part`` that stands in its order (longest common
    subsequence) in a window of twice its length, over the windows with at
    least ``least`` of its weight: common words alone do not make a match."""
    n = len(part)
    masks: dict[str, int] = {}
    for i, w in enumerate(part):
        masks[w] = masks.get(w, 0) | 1 << i
    hits = [i for i, w in enumerate(words) if w in masks]
    need = (least - SLACK) * sum(weight[w] for w in masks)
    best, full, step = 0, (1 << n) - 1, max(1, n // 2)
    for lo in range(0, max(1, len(words) - n), step):
        here = [words[i] for i in hits[bisect_left(hits, lo):bisect_left(hits, lo + 2 * n)]]
        if len(here) <= best or sum(weight[w] for w in set(here)) < need:
            continue
        free = full  # bit i is 0 where the length grows at word i
        for w in here:
            used = free & masks[w]
            free = ((free + used) | (free - used)) & full
        best = max(best, n - free.bit_count())
    return best / n if n else 1.0


@dataclass
class Index:
    """Posting lists of (item, impact) per term, with block maxima."""
    ids: list[int]
    parts: list[tuple[list[str], list[str]]]
    #: Words of each item's marked answer; 0 without a mark.
    answer: list[int]
    term: dict[str, int]
    postings: list[list[int]]
    impacts: list[list[float]]
    best: np.ndarray                 # per term
    blocks: list[list[float]] = field(default_factory=list)
    longest: int = 1
    span: int = 2
    #: Maxima per term and span of items, term by term: where a term's begin, the span, the maximum.
    span_start: np.ndarray | None = None
    span_at: np.ndarray | None = None
    span_max: np.ndarray | None = None

    @staticmethod
    def build(items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_len: float, cfg: Settings) -> "Index":
        """``df``, ``n_items``, ``mean_len``: statistics of all items, also of
        those in other indexes."""
        ids, parts, answer, term, postings, impacts, longest = [], [], [], {}, [], [], 1
        for item, text in sorted(items):
            q, a = split_item(text)
            tf = Counter(q + a)
            if not tf:
                continue
            size = sum(tf.values())
            longest = max(longest, size)
            norm = cfg.k1 * (1 - cfg.b + cfg.b * size / mean_len)
            score = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (cfg.k1 + 1) / (c + norm) for t, c in tf.items()}
            full = sum(score.values())
            for t, s in score.items():
                k = term.setdefault(t, len(term))
                if k == len(postings):
                    postings.append([])
                    impacts.append([])
                postings[k].append(len(ids))
                impacts[k].append(s / full)
            ids.append(item)
            parts.append((q, a))
            answer.append(answer_size(text))
        blocks = [[max(x[i:i + cfg.block]) for i in range(0, len(x), cfg.block)] for x in impacts]
        out = Index(ids, parts, answer, term, postings, impacts, np.array([max(x) for x in impacts]), blocks, longest, cfg.span)
        where = np.array([(t, i // cfg.span) for t, p in enumerate(postings) for i in p], np.int64).reshape(-1, 2)
        first = np.flatnonzero(np.diff(where, axis=0, prepend=-1).any(1))
        out.span_at = where[first, 1]
        out.span_max = np.maximum.reduceat(np.array([x for row in impacts for x in row]), first) if len(first) else np.zeros(0)
        out.span_start = np.searchsorted(where[first, 0], np.arange(len(term) + 1))
        return out

    def may_reach(self, passage: np.ndarray, term: np.ndarray, n: int, least: float) -> np.ndarray:
        """Passages (of ``n``) in which some span of items can reach ``least``:
        block maxima of every distinct (passage, term) pair, sorted by passage,
        added up for many passages at once."""
        spans = -(-len(self.ids) // self.span)
        out = np.zeros(n, bool)
        at_once = max(1, (1 << 22) // max(1, spans))
        for lo in range(0, n, at_once):
            a, e = np.searchsorted(passage, [lo, lo + at_once])
            t = term[a:e]
            count = self.span_start[t + 1] - self.span_start[t]
            skip = np.repeat(self.span_start[t] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            rows = min(at_once, n - lo)
            bound = np.bincount(np.repeat(passage[a:e] - lo, count) * spans + self.span_at[skip], weights=self.span_max[skip], minlength=rows * spans)
            out[lo:lo + rows] = bound.reshape(rows, spans).max(1, initial=0) >= least
        return out

    def search(self, terms: list[int], least: float, block: int) -> list[tuple[int, float]]:
        """All items whose impacts over ``terms`` sum to ``least`` or more:
        document-at-a-time, a pivot by term maxima, then by block maxima."""
        lists = [(self.postings[t], self.impacts[t], self.blocks[t], float(self.best[t])) for t in terms]
        at = [0] * len(lists)
        order = list(range(len(lists)))
        end = len(self.ids)
        here = lambda i: lists[i][0][at[i]] if at[i] < len(lists[i][0]) else end
        found = []
        while True:
            order.sort(key=here)
            bound, pivot = 0.0, -1
            for n, i in enumerate(order):
                if here(i) == end:
                    break
                bound += lists[i][3]
                if bound >= least:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = here(order[pivot])
            while pivot + 1 < len(order) and here(order[pivot + 1]) == item:
                pivot += 1
            bound, next_item = 0.0, end
            for i in order[:pivot + 1]:  # the blocks in which the pivot item would lie
                post, _, maxima, _ = lists[i]
                p = bisect_left(post, item, at[i])
                if p < len(post):
                    k = p // block
                    bound += maxima[k]
                    last = post[min(len(post), (k + 1) * block) - 1]
                    next_item = min(next_item, last + 1)
            if bound >= least:
                score = 0.0
                for i in order[:pivot + 1]:
                    post, impact = lists[i][0], lists[i][1]
                    at[i] = bisect_left(post, item, at[i])
                    if at[i] < len(post) and post[at[i]] == item:
                        score += impact[at[i]]
                        at[i] += 1
                if score >= least:
                    found.append((item, score))
            else:
                if pivot + 1 < len(order):
                    next_item = min(next_item, here(order[pivot + 1]))
                to = max(item + 1, next_item)
                for i in order[:pivot + 1]:
                    at[i] = bisect_left(lists[i][0], to, at[i])

    def overlap(self, item: int, words: list[str], cfg: Settings) -> tuple[float, float]:
        """Parts of the question and of the answer found in ``words``; of an
        item without an answer mark twice the part of the whole item, unless
        the runs of its first and last words suffice."""
        q, a = (_share(part, words, cfg.run) for part in self.parts[item])
        if q >= cfg.question and a >= cfg.answer:
            return q, a
        text, n = [w for part in self.parts[item] for w in part], self.answer[item]
        weight = {}
        for t in set(text):
            post = self.postings[k := self.term[t]]
            weight[t] = self.impacts[k][bisect_left(post, item)]
        cover = [max(_share(part, words, cfg.run), in_order(part, words, weight, cfg.threshold))
                 for part in ((text[:-n], text[-n:]) if n else (text,))]
        return cover[0], cover[-1]


def search_texts(index: Index, texts: list[str | None], cfg: Settings) -> list[tuple[int, int, int, float, float, float]]:
    """(text, item, first word of the passage, score, question overlap, answer
    overlap) of every verified hit; the best passage of each text and item.

    A passage is two neighbouring blocks of as many words as the longest item
    has.  All passages of the slice are bounded at once: each block's distinct
    index terms add their maxima, over all items and then over spans of
    items.  Those that may reach the threshold query the index."""
    m = index.longest
    docs = [words_of(t) for t in texts]
    get = index.term.get
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.fromiter((k for d in docs for k in map(get, d, repeat(-1))), np.int64, int(size.sum()))
    start = np.cumsum(size) - size
    n_blocks = -(-size // m)
    base = np.cumsum(n_blocks) - n_blocks
    at = np.flatnonzero(flat >= 0)
    doc = np.searchsorted(start, at, side="right") - 1
    block = base[doc] + (at - start[doc]) // m
    n_terms = len(index.term)
    pair = np.unique(block * n_terms + flat[at])
    total = np.bincount(pair // n_terms, weights=index.best[pair % n_terms], minlength=int(n_blocks.sum()) + 1)
    owner = np.repeat(np.arange(len(docs)), n_blocks)
    last = np.zeros(len(owner) + 1, bool)
    last[base + n_blocks - 1] = n_blocks > 0
    own, nxt = total[:len(owner)], np.where(last[:len(owner)], 0.0, total[1:len(owner) + 1])
    best: dict[tuple[int, int], tuple] = {}
    cut = np.searchsorted(pair, np.arange(len(owner) + 2) * n_terms)
    alone = last[:len(owner)] & (n_blocks[owner] > 1)  # a last block lies in the passage before it
    passages = np.flatnonzero((own + nxt >= cfg.threshold - SLACK) & ~alone)
    if not len(passages):
        return []
    stop = np.where(last[passages], cut[passages + 1], cut[passages + 2])
    length = stop - cut[passages]
    take = np.repeat(cut[passages] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    both = np.unique(np.repeat(np.arange(len(passages)), length) * n_terms + pair[take] % n_terms)
    which, term = both // n_terms, both % n_terms
    edge = np.searchsorted(which, np.arange(len(passages) + 1))
    for k in np.flatnonzero(index.may_reach(which, term, len(passages), cfg.threshold - SLACK)):
        p = passages[k]
        d = int(owner[p])
        terms = term[edge[k]:edge[k + 1]]
        first = int(p - base[d]) * m
        words = None
        for item, score in index.search(terms.tolist(), cfg.threshold - SLACK, cfg.block):
            words = words or docs[d][first:first + 2 * m]
            q, a = index.overlap(item, words, cfg)
            if q >= cfg.question and a >= cfg.answer:
                hit = (score, -first, q, a)
                if hit > best.get((d, item), (-1.0,)):
                    best[d, item] = hit
    return [(d, item, -f, s, q, a) for (d, item), (s, f, q, a) in sorted(best.items())]


def _indexes(benchmark: DataFrame, cfg: Settings, item_col: str, item_text_col: str):
    """Broadcast indexes that together hold the benchmark, one after another."""
    spark = benchmark.sparkSession
    ship(spark)
    items = (benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
             .filter("item is not null and text is not null").distinct())
    shards = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // cfg.index_chars))

    def term_rows(it):
        for b in it:
            found = [Counter(words_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(f) for f in found], pa.list_(pa.string())),
                                              pa.array([sum(f.values()) for f in found], pa.int64())], names=["item", "terms", "size"])

    counted = items.mapInArrow(term_rows, "item long, terms array<string>, size long").filter("size > 0")
    n_items, mean_len = counted.agg(F.count("*"), F.avg("size")).first()
    shard_of = F.pmod(F.xxhash64("item"), F.lit(shards))
    by_term = counted.select("item", F.explode("terms").alias("t"))
    df = by_term.groupBy("t").agg(F.count("*").alias("df"))
    for s in range(shards if n_items else 0):
        part = [(r["item"], r["text"]) for r in items.filter(shard_of == s).collect()]
        here = {r["t"]: r["df"] for r in df.join(by_term.filter(shard_of == s).select("t").distinct(), "t").collect()}
        yield spark.sparkContext.broadcast(Index.build(part, here, n_items, mean_len, cfg))


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col``, item_id, first_word, score, question, answer of every
    benchmark item found in a document.

    The corpus is scanned, never shuffled.  The index follows the benchmark
    alone; a benchmark of more than ``index_chars`` characters is cut into
    that many indexes by item, each broadcast in its turn.  Items without a
    word, with a null text or id, and null or empty documents match nothing.
    Repeated documents are all reported, repeated items under each id.  Empty
    tables give an empty result; other columns stay unread.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {kind}, item_id long, first_word long, score double, question double, answer double"
    out = None
    for index in _indexes(benchmark, cfg, item_col, item_text_col):
        def run(it, index=index):
            only("decontamination")
            for b in batches(it, STEP_BYTES):
                hits = search_texts(index.value, b.column(1).to_pylist(), cfg)
                cols = [list(c) for c in zip(*hits)] or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array([index.value.ids[i] for i in cols[1]], pa.int64()),
                     pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])],
                    names=[id_col, "item_id", "first_word", "score", "question", "answer"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings(), *, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns as
    they are; the same search as ``contaminated``, without a shuffle."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, cfg, item_col, item_text_col):
        def run(it, index=index):
            only("decontamination")
            for b in batches(it, STEP_BYTES, text_col):
                keep = np.ones(b.num_rows, bool)
                keep[[h[0] for h in search_texts(index.value, b.column(at).to_pylist(), cfg)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

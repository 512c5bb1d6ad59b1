"""How the sources of each language differ in their use of words.

*Counting.*  A task finds the terms of its texts as stretches of bytes.  Terms
are bucketed by length: up to 8 bytes they are one unsigned 64-bit word, up to
16 two, big-endian and padded with zeros, and sorted by an LSD radix sort of
16-bit digits; longer ones stay bytes, in buckets of their own, sorted
bytewise.  Runs of equal keys are counted in numpy, so that a task hands on
one row per term and group, with its occurrences and its documents.

*Comparing.*  Spark adds the rows up, keeps the terms that enough documents of
a language use and gives each (language, source) group a share per term in
whole billionths.  The differences of all pairs of sources are summed in
cells: a cell is a block of sources against a block of sources over one shard
of the terms, so neither the terms nor the pairs of a language meet in one
task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, only, ship, written

STEP_BYTES = 4 << 20
#: Widths of the packed buckets (one word, then two) and of the byte buckets; longer terms have the last one.
PACKED, BYTEWISE = (4, 8, 12, 16), (24, 32, 64, 128)
#: Counted runs, and bytes of long terms, that a task holds before it hands them on.
HELD_RUNS, HELD_BYTES = 600_000, 32 << 20
#: Sources of a block, cells of a language (so far as blocks don't make more), and shares held at a time.
BLOCK, CELLS, DENSE = 256, 32, 1 << 21
#: Shares are in units of one part in SHARE.
SHARE = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned keys, the first most significant: least
    significant 16-bit digit first; digits that are equal everywhere are
    passed over."""
    order = None
    for key in reversed(keys):
        if not len(key):
            return np.zeros(0, np.int64)
        differ = int(np.bitwise_or.reduce(key ^ key[0]))
        for shift in range(0, key.dtype.itemsize * 8, 16):
            if differ >> shift & 0xFFFF:
                digit = (key >> key.dtype.type(shift)).astype(np.uint16)  # numpy sorts 16-bit integers by radix
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """True where any of the sorted keys differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return new


class TermCounts:
    """Occurrences and documents of each term in each group, of one task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.runs: dict[int, list[tuple]] = {}  # bucket -> [(key columns, group, occurrences, documents)]
        self.held = self.held_bytes = 0

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        """Count the terms of some documents; the lists have no null."""
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
        lo, hi = int(at[0]), int(at[-1])
        raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        at = at - lo
        text = np.zeros(len(raw) + 16, np.uint8)
        text[:len(raw)] = _LOWER[raw]
        inside = _TERM[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True                        # a term ends with its document
        before, after = np.roll(inside, 1), np.roll(inside, -1)
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        size = np.flatnonzero(inside & (~after | edge[1:])) + 1 - start
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)), np.int64, n)
        # documents numbered by group, so that their order keeps the groups together
        order = np.argsort(group, kind="stable")
        number = np.empty(n, np.uint32)
        number[order] = np.arange(n, dtype=np.uint32)
        doc = number[np.searchsorted(at, start, side="right") - 1]
        of_doc = group[order].astype(np.uint32)
        word = np.ndarray((len(raw) + 9,), ">u8", text, strides=(1,))  # the 8 bytes from any place on
        low = 0
        for width in PACKED:
            some = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(some):
                s, z = start[some], size[some].astype(np.uint64)
                keys = [self._word(word[s], z)] if width <= 8 else [word[s].astype(np.uint64), self._word(word[s + 8], z - np.uint64(8))]
                by = radix_order([*keys, doc[some]])
                self._count(width, [k[by] for k in keys], doc[some][by], of_doc)
        for width in BYTEWISE:
            some = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(some):
                wide = np.zeros((len(some), width), np.uint8)
                fill = np.arange(width)[None] < size[some][:, None]
                wide[fill] = text[(start[some][:, None] + np.arange(width)[None])[fill]]
                self._by_bytes(width, wide.view(f"S{width}").ravel(), doc[some], of_doc)
        some = np.flatnonzero(size > low)
        if len(some):
            terms = np.empty(len(some), object)
            terms[:] = [text[s:s + z].tobytes() for s, z in zip(start[some].tolist(), size[some].tolist())]
            self._by_bytes(0, terms, doc[some], of_doc)

    @staticmethod
    def _word(w: np.ndarray, size: np.ndarray) -> np.ndarray:
        shift = np.uint64(64) - np.uint64(8) * size
        return w.astype(np.uint64) >> shift << shift

    def _by_bytes(self, width: int, terms: np.ndarray, doc: np.ndarray, of_doc: np.ndarray) -> None:
        by = radix_order([doc])
        by = by[np.argsort(terms[by], kind="stable")]
        self._count(width, [terms[by]], doc[by], of_doc)

    def _count(self, bucket: int, keys: list[np.ndarray], doc: np.ndarray, of_doc: np.ndarray) -> None:
        group = of_doc[doc]
        first = np.flatnonzero(_changes([*keys, group]))
        times = np.diff(first, append=len(group))
        docs = np.add.reduceat(_changes([*keys, doc]).astype(np.int64), first)
        self._hold(bucket, [k[first] for k in keys], group[first], times, docs)

    def _hold(self, bucket: int, keys: list[np.ndarray], *counts: np.ndarray) -> None:
        self.runs.setdefault(bucket, []).append((keys, *counts))
        self.held += len(counts[0])
        self.held_bytes += sum(map(len, keys[0])) if bucket == 0 else 0

    def _merged(self, bucket: int) -> tuple:
        """All runs of a bucket, equal ones added up."""
        parts = self.runs.pop(bucket)
        if len(parts) == 1:
            return parts[0]
        keys = [np.concatenate(k) for k in zip(*(p[0] for p in parts))]
        group, times, docs = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        if keys[0].dtype == np.uint64:
            by = radix_order([*keys, group])
        else:
            by = radix_order([group])
            by = by[np.argsort(keys[0][by], kind="stable")]
        keys, group = [k[by] for k in keys], group[by]
        first = np.flatnonzero(_changes([*keys, group]))
        return [k[first] for k in keys], group[first], np.add.reduceat(times[by], first), np.add.reduceat(docs[by], first)

    def full(self) -> bool:
        """Merge when enough is held; true if that did not help."""
        if self.held <= HELD_RUNS and self.held_bytes <= HELD_BYTES:
            return False
        for bucket in list(self.runs):
            self.runs[bucket] = [self._merged(bucket)]
        self.held = sum(len(p[0][1]) for p in self.runs.values())
        self.held_bytes = sum(map(len, self.runs[0][0][0][0])) if 0 in self.runs else 0
        return self.held > HELD_RUNS // 2 or self.held_bytes > HELD_BYTES // 2

    def out(self) -> Iterator[pa.RecordBatch]:
        """Everything held, as (lang, source, term, times, docs); nothing stays."""
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        for bucket in sorted(self.runs):
            keys, group, times, docs = self._merged(bucket)
            for k in range(0, len(group), 100_000):
                s = slice(k, k + 100_000)
                at = pa.array(group[s].astype(np.int64))
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), _strings([x[s] for x in keys]), pa.array(times[s]), pa.array(docs[s])],
                                                 names=["lang", "source", "term", "times", "docs"])
        self.held = self.held_bytes = 0


def _strings(keys: list[np.ndarray]) -> pa.Array:
    """Terms from their keys; no term holds a zero byte."""
    if keys[0].dtype == object:
        return pa.array(keys[0].tolist(), pa.binary()).cast(pa.string())
    if keys[0].dtype == np.uint64:
        wide = np.stack([k.astype(">u8").view(np.uint8).reshape(-1, 8) for k in keys], 1).reshape(len(keys[0]), -1)
    else:
        wide = keys[0].view(np.uint8).reshape(len(keys[0]), -1)
    used = wide != 0
    offsets = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(wide), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(wide[used].tobytes())])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, times (occurrences) and docs (documents) of rows
    (text, lang, source) without nulls, added up over the whole table."""
    ship(docs.sparkSession)

    def run(it):
        only("divergence")
        counts = TermCounts()
        for b in batches(it, STEP_BYTES):
            counts.add(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())
            if counts.full():
                yield from counts.out()
        yield from counts.out()

    part = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, times long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


def _share(times: str, total: str, terms: str) -> Column:
    """1 + floor(SHARE * (times + 2) / (total + 2 * terms)) of columns of
    longs, exact in 64 bits for counts below 9e15: the factor goes in as three
    of 1000, and the remainder of each division into the next."""
    whole, rest, digits = f"({total} + 2L * {terms})", f"({times} + 2L)", []
    for _ in range(3):
        digits.append(f"(({rest} * 1000L) div {whole})")
        rest = f"(({rest} * 1000L) % {whole})"
    return F.expr(f"1L + {digits[0]} * 1000000L + {digits[1]} * 1000L + {digits[2]}")


def _cells(info: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """The shares of kept terms, and one marker per source (null term, its
    share of a term that it never uses), in every cell that needs them."""
    blocks = F.expr(f"(sources - 1) div {block} + 1")
    shards = F.expr(f"greatest(1L, {CELLS} div (blocks * (blocks + 1) div 2))")
    grid = info.withColumn("block", F.expr(f"(place - 1) div {block}")).withColumn("blocks", blocks).withColumn("shards", shards)
    common = ["lang", "source", "place", "terms", "block", "blocks", "shards"]
    marks = grid.select(*common, F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"), F.lit(None).cast("string").alias("term"), F.col("none").alias("p"))
    used = rows.join(grid.select(*common), ["lang", "source"]).select(*common, F.expr("pmod(xxhash64(term), shards)").alias("shard"), "term", "p")
    both = marks.unionByName(used).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return both.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "shard", "term", "place", "p", "source", "terms")


class _Cell:
    """Sums of one cell, of terms that come in order."""

    def __init__(self, head: tuple, block: int, dense: int):
        self.head, self.block, self.dense = head, block, dense  # head: lang, a, b, shard
        self.place, self.source, self.none, self.terms = [], [], [], 0
        self.sums: np.ndarray | None = None
        self.seen = 0

    def mark(self, place, source, none, terms) -> None:
        self.place += place
        self.source += source
        self.none += none
        self.terms = terms

    def _gap(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = p - q
        return d * d // (p + q)

    def _open(self) -> None:
        _, a, b, _ = self.head
        place = np.array(self.place, np.int64)
        self.at = np.full(int(place.max(initial=0)) + 1, -1, np.int64)
        self.at[place] = np.arange(len(place))
        self.base = np.array(self.none, np.int64)
        left = (place - 1) // self.block == a
        i, j = np.nonzero(left[:, None] & ((place - 1) // self.block == b)[None] & (place[:, None] < place[None]))
        self.i, self.j, self.sums = i, j, np.zeros(len(i), np.int64)

    def add(self, place: np.ndarray, p: np.ndarray, new: np.ndarray) -> None:
        """Rows of whole terms; ``new`` is true at the first row of each."""
        if self.sums is None:
            self._open()
        term = np.cumsum(new) - 1
        self.seen += int(new.sum())
        most = max(1, self.dense // max(1, len(self.base)))
        edges = np.searchsorted(term, np.arange(0, int(term[-1]) + most + 1, most))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            share = np.repeat(self.base[:, None], int(term[hi - 1] - term[lo]) + 1, 1)
            share[self.at[place[lo:hi]], term[lo:hi] - term[lo]] = p[lo:hi]
            step = max(1, self.dense // share.shape[1])
            for k in range(0, len(self.i), step):
                some = slice(k, k + step)
                self.sums[some] += self._gap(share[self.i[some]], share[self.j[some]]).sum(1)

    def out(self) -> pa.RecordBatch:
        """Sum for each pair of sources; terms that neither uses count in shard 0."""
        if self.sums is None:
            self._open()
        lang, _, _, shard = self.head
        rest = (self.terms if shard == 0 else 0) - self.seen
        value = self.sums + rest * self._gap(self.base[self.i], self.base[self.j])
        names = np.array(self.source, object)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(value), pa.string()), pa.array(names[self.i].tolist(), pa.string()), pa.array(names[self.j].tolist(), pa.string()), pa.array(value, pa.int64())],
            names=["lang", "source", "item", "value"])


def _sum_cells(it: Iterator[pa.RecordBatch], block: int, dense: int) -> Iterator[pa.RecordBatch]:
    """One pass over sorted cells.  A batch's last term waits for the next batch."""
    only("divergence")
    cell: _Cell | None = None
    wait: tuple | None = None  # place, p and term of rows not yet added

    def flush():
        nonlocal wait
        if wait is not None:
            cell.add(wait[0], wait[1], _changes([wait[2]]))
            wait = None

    for batch in it:
        if not batch.num_rows:
            continue
        lang, a, b, shard, term, place, p, source, terms = batch.columns
        code = lang.dictionary_encode().indices.to_numpy()
        key = [code, a.to_numpy(), b.to_numpy(), shard.to_numpy()]
        first = np.flatnonzero(_changes(key))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
            head = (lang[lo].as_py(), a[lo].as_py(), b[lo].as_py(), shard[lo].as_py())
            if cell is None or cell.head != head:
                flush()
                if cell is not None:
                    yield cell.out()
                cell = _Cell(head, block, dense)
            names = term.slice(lo, hi - lo)
            n = names.null_count  # markers come first
            if n:
                some = slice(lo, lo + n)
                cell.mark(place[some].to_pylist(), source[some].to_pylist(), p[some].to_pylist(), terms[lo].as_py())
            if hi - lo > n:
                words = np.array(names.slice(n).to_pylist(), object)
                at, share = place.slice(lo + n, hi - lo - n).to_numpy(), p.slice(lo + n, hi - lo - n).to_numpy()
                if wait is not None:
                    at, share, words = (np.concatenate(x) for x in zip(wait, (at, share, words)))
                last = int(np.flatnonzero(_changes([words]))[-1])
                if last:
                    cell.add(at[:last], share[:last], _changes([words[:last]]))
                wait = at[last:], share[last:], words[last:]
    if cell is not None:
        flush()
        yield cell.out()


def source_divergence(docs: DataFrame, *, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source", block: int = BLOCK, dense: int = DENSE) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` gives each other
    source of the language with the sum of the terms' gaps, part ``term`` the
    ``top`` terms that the source uses more than its language does.

    Terms are stretches of ASCII letters and characters beyond ASCII, with
    A to Z in lower case; a language keeps those that at least ``min_docs`` of
    its documents hold.  Null text, language or source count as ''; a group
    without terms takes part with the share of no occurrence; a language
    without kept terms gives pairs of value 0.  Equal values rank by item in
    UTF-8 order; repeated rows count each; an empty table gives an empty
    result; a very long text or term is held once; other columns are not read.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    term = Window.partitionBy("lang", "term")
    counts = term_counts(read).withColumn("all", F.sum("times").over(term)).withColumn("in_docs", F.sum("docs").over(term))
    kept = counts.filter(F.col("in_docs") >= min_docs).withColumn("head", F.min("source").over(term) == F.col("source"))
    kept = written(kept.select("lang", "source", "term", "times", "all", "head"), "divergence")  # read for totals, pairs and terms

    of_lang = kept.groupBy("lang").agg(F.sum("times").alias("lang_total"), F.sum(F.col("head").cast("long")).alias("terms"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    by_lang = Window.partitionBy("lang")
    groups = read.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("times"))
    groups = groups.withColumn("place", F.row_number().over(by_lang.orderBy("source")).cast("long")).withColumn("sources", F.count("*").over(by_lang))
    info = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    # without kept terms there is no share; any positive one does, as it is counted no time
    info = written(info.withColumn("none", F.when(F.col("terms") > 0, _share("times", "total", "terms")).otherwise(F.lit(1).cast("long"))), "divergence-groups")

    rows = kept.join(info.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    rows = rows.select("lang", "source", "term", _share("times", "total", "terms").alias("p"), _share("all", "lang_total", "terms").alias("q"))

    cells = _cells(info, rows.drop("q"), block)
    key = ["lang", "a", "b", "shard"]
    sums = cells.repartition(*key).sortWithinPartitions(*key, "term").mapInArrow(lambda it: _sum_cells(it, block, dense), "lang string, source string, item string, value long")
    one_way = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair")
    pairs = one_way.select("lang", "value", both).select("lang", "pair.source", "pair.item", "value")
    more = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, name: part.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(more, "term").filter(F.col("rank") <= top))

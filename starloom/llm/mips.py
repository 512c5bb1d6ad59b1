"""Exact top-k inner-product search by norm buckets.

All vectors are sorted by length and cut into buckets of similar length.  In
a bucket whose longest vector has length ``l`` a query ``q`` whose current
k-th best product is ``t`` needs only candidates of cosine ``t / (|q| l)`` or
more: its local threshold.  Above 1 the whole bucket is skipped.  Otherwise
the bucket either scans the candidates long enough to reach ``t`` (length
pruning) or intersects the feasible ranges of the query's largest coordinates
in the bucket's sorted coordinate lists (coordinate pruning), whichever keeps
fewer rows, and verifies the products of what is left exactly.  Many queries
meet a bucket at once, in one matrix product over the rows long enough;
coordinate lists are searched where a query's part of that product is dearer.

Spark carries blocks: a bucket is one packed row, and so is a block of
queries.  Blocks of queries form groups that fit a task, buckets are dealt to
spans, and a task holds a cell of this grid: its group's blocks, which meet
the buckets of its span one after the other, the longest first, and whose
thresholds rise on the way.  So a bucket is sent once for each group that the
length bound does not rule out, a block of queries once for each span, and
none of them to the driver, save one block of the longest vectors.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: Rows of one bucket and of one query block.
BUCKET_ROWS = 4096
QUERY_ROWS = 1024
#: Values of one block at most; with long vectors it has fewer rows.
BLOCK_VALUES = 1 << 22
#: Ranges of lengths at most: Spark's driver samples some hundred keys for each.
RANGES = 512
#: Bytes of a group of queries with the best rows so far, as a task holds them.
GROUP_BYTES = 96 << 20
#: Buckets of one span at most, and spans for each core if there are buckets enough.
SPAN = 128
SPANS_A_CORE = 4
#: Queries of one matrix product.
TILE = 256
#: Multiplications of a matrix product in the time that one query's lists take.
SEEK = 1 << 21
#: Coordinates whose lists are intersected by coordinate pruning.
FOCUS = 3
#: Relative slack of float bounds, so that rounding never prunes a result.
SLACK = 1e-9
#: "No bound yet".
NONE = -(1 << 63)
MOST = (1 << 63) - 1


class Bucket:
    """Vectors of similar length: ids, integer rows, lengths, directions and a
    sorted list per coordinate."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.rows, self.norm = ids[order], rows[order], norm[order]
        self.longest = float(self.norm[0]) if len(ids) else 0.0
        self._lists: tuple[np.ndarray, np.ndarray] | None = None
        self._as: dict[type, np.ndarray] = {}
        self._by_id: tuple[np.ndarray, np.ndarray] | None = None

    @functools.cached_property
    def unit(self) -> np.ndarray:
        return self.rows / np.maximum(self.norm, 1e-300)[:, None]

    @functools.cached_property
    def exact(self) -> np.ndarray:
        return _exact_products(self.rows)

    def rows_as(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.rows.astype(kind)
        return self._as[kind]

    def with_id(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ids``, row) of every row with one of these ids."""
        if self._by_id is None:
            by = np.argsort(self.ids, kind="stable")
            self._by_id = by, self.ids[by]
        by, values = self._by_id
        lo, hi = np.searchsorted(values, ids, "left"), np.searchsorted(values, ids, "right")
        some = np.flatnonzero(hi > lo)
        if not len(some):
            return some, some
        return np.repeat(some, (hi - lo)[some]), np.concatenate([by[lo[j]:hi[j]] for j in some])

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        if self._lists is None:
            by = np.argsort(self.unit, axis=0, kind="stable")
            self._lists = by, np.take_along_axis(self.unit, by, axis=0)
        return self._lists


def _exact_products(rows: np.ndarray) -> np.ndarray:
    """Rows as float64 where every product sum stays below 2**53 (BLAS is then
    exact); otherwise as Python integers."""
    big = float(np.abs(rows.astype(np.float64)).max(initial=0.0))
    return rows.astype(np.float64) if big * big * max(1, rows.shape[1]) < 2.0 ** 52 else rows.astype(object)


def _longs(products) -> np.ndarray:
    """Python integers as 64-bit ones; what exceeds 64 bits takes the nearest bound."""
    return np.array([max(-MOST, min(MOST, int(x))) for x in products], dtype=np.int64)


def _score(block: np.ndarray, q: np.ndarray) -> np.ndarray:
    if block.dtype == object:
        return _longs(block @ q.astype(object))
    big = float(np.abs(q.astype(np.float64)).max(initial=0.0)) * float(np.abs(block).max(initial=0.0))
    if big * block.shape[1] >= 2.0 ** 52:
        return _longs(block.astype(np.int64).astype(object) @ q.astype(object))
    return (block @ q.astype(np.float64)).astype(np.int64)


def candidates(b: Bucket, q: np.ndarray, qn: float, least: float) -> np.ndarray | slice:
    """Rows of the bucket that may reach a product of ``least`` with q."""
    if least <= 0 or qn == 0:
        return slice(None)
    by_length = int(np.searchsorted(-b.norm, -(least / qn) * (1 - SLACK), side="right"))
    theta = min(1.0, least / (qn * b.longest)) * (1 - SLACK)
    if by_length < 64:
        return slice(0, by_length)
    unit = q / qn
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    spread = np.sqrt(np.maximum(0.0, (1 - unit[focus] ** 2) * (1 - theta * theta))) + SLACK
    low = np.where(-unit[focus] >= theta, -1.0, unit[focus] * theta - spread)
    high = np.where(unit[focus] >= theta, 1.0, unit[focus] * theta + spread)
    by, values = b.lists()
    ranges = [(np.searchsorted(values[:, f], lo, "left"), np.searchsorted(values[:, f], hi, "right"))
              for f, lo, hi in zip(focus, low, high, strict=True)]
    if min(e - s for s, e in ranges) >= by_length // 2:
        return slice(0, by_length)
    seen = np.zeros(len(b.ids), dtype=np.uint8)
    for f, (s, e) in zip(focus, ranges, strict=True):
        seen[by[s:e, f]] += 1
    found = np.flatnonzero(seen[:by_length] == len(focus))
    return found


def search(b: Bucket, qid: int, q: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
    """(vec_id, score) of the bucket's k best rows for q with a score of
    ``least`` or more, other rows than the query's own."""
    qn = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    if least > 0 and qn * b.longest * (1 + SLACK) < least:
        return []
    rows = candidates(b, q, qn, least)
    ids = b.ids[rows]
    if not len(ids):
        return []
    score = _score(b.exact[rows], q)
    ok = (ids != qid) & (score >= least)
    ids, score = _first(ids[ok], score[ok], k)
    return list(zip(ids.tolist(), score.tolist(), strict=True))


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first by (score descending, id), in this order."""
    if len(ids) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        more, same = score > kth, np.sort(ids[score == kth])[:k]
        ids, score = np.concatenate([ids[more], same]), np.concatenate([score[more], np.full(len(same), kth, dtype=score.dtype)])
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


class Asked:
    """A block of queries of one dimension, each with a lower bound of its k-th
    best product (``least``) and its best rows so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, least: np.ndarray | None, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        self.longest = float(self.norm.max(initial=0.0))
        self.least = np.full(len(ids), NONE, dtype=np.int64) if least is None else least.copy()
        self.vecs, self.scores = np.zeros((2, len(ids), k), dtype=np.int64)
        self.found = np.zeros(len(ids), dtype=np.int64)
        self._as: dict[type, np.ndarray] = {}

    def rows_as(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as = {kind: self.rows.astype(kind)}
        return self._as[kind]

    def need(self) -> np.ndarray:
        """Least length of a row that may reach the bound; 0 without one."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((self.least > 0) & (self.norm > 0), self.least / self.norm, 0.0)

    def keep(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take the rows ``ids`` of the queries at ``at`` among their best."""
        k = self.k
        last = self.scores[at, k - 1]
        ok = (self.found[at] < k) | (scores > last) | ((scores == last) & (ids < self.vecs[at, k - 1]))
        at, ids, scores = at[ok], ids[ok], scores[ok]
        if not len(at):
            return
        rows, n = np.unique(at, return_counts=True)
        if n.max() > 64 + 8 * k:  # many equal products
            by = np.argsort(at, kind="stable")
            parts = [(j, *_first(ids[c], scores[c], k)) for j, c in zip(rows, np.split(by, np.cumsum(n)[:-1]), strict=True)]
            at = np.repeat(rows, [len(p[1]) for p in parts])
            ids, scores = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        have = np.arange(k) < self.found[rows][:, None]
        at = np.concatenate([at, np.repeat(rows, self.found[rows])])
        ids, scores = np.concatenate([ids, self.vecs[rows][have]]), np.concatenate([scores, self.scores[rows][have]])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        start = np.searchsorted(at, rows)
        n = np.diff(np.append(start, len(at)))
        rank = np.arange(len(at)) - np.repeat(start, n)
        ok = rank < k
        self.vecs[at[ok], rank[ok]], self.scores[at[ok], rank[ok]] = ids[ok], scores[ok]
        self.found[rows] = np.minimum(n, k)
        full = rows[n >= k]
        self.least[full] = np.maximum(self.least[full], self.scores[full, k - 1])

    def meet(self, b: Bucket) -> None:
        """Take the bucket's rows that are among the best of a query, other
        rows than the query's own."""
        # every partial sum is an integer of at most |q| |b|: exact in these types, in any order
        most = self.longest * b.longest * (1 + SLACK)
        kind = np.float32 if most < 2.0 ** 24 else np.float64 if most < 2.0 ** 52 else None
        need = self.need()
        reach = np.where(need > 0, np.searchsorted(-b.norm, -need * (1 - SLACK), side="right"), len(b.ids))
        for j in np.flatnonzero(reach * b.rows.shape[1] > SEEK) if kind else np.flatnonzero(reach):
            if kind and isinstance(candidates(b, self.rows[j], float(self.norm[j]), float(self.least[j])), slice):
                continue  # its lists save too little
            got = search(b, int(self.ids[j]), self.rows[j], self.k, int(self.least[j]))
            if got:
                self.keep(np.full(len(got), j), *np.array(got, dtype=np.int64).T)
            reach[j] = 0
        order = np.argsort(-reach, kind="stable")[:np.count_nonzero(reach)]
        for lo in range(0, len(order), TILE):
            at = order[lo:lo + TILE]
            n = int(reach[at[0]])
            s = self.rows_as(kind)[at] @ b.rows_as(kind)[:n].T
            j, c = b.with_id(self.ids[at])
            s[j[c < n], c[c < n]] = -np.inf
            least = self.least[at].astype(kind)
            bare = np.flatnonzero(self.least[at] == NONE)
            if len(bare) and n > self.k:
                least[bare] = np.maximum(np.partition(s[bare], n - self.k, axis=1)[:, n - self.k], np.finfo(kind).min)
            j, c = np.divmod(np.flatnonzero(s >= least[:, None]), n)
            if len(j):
                self.keep(at[j], b.ids[c], s[j, c].astype(np.int64))


def quantised(vectors: DataFrame, id_col: str, vec_col: str, factor: float) -> DataFrame:
    """id and floor(factor * x) of every valid vector; vectors that are null,
    empty or hold a null or non-finite component take no part."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.floor(F.lit(factor) * v.cast("double")).cast("long"))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("q"),
                           (x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False))).alias("ok"))
            .filter("ok and vec_id is not null").drop("ok")
            .withColumn("norm2", F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def _narrow(rows: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    lo, hi = rows.min(initial=0), rows.max(initial=0)
    return rows.astype(next(f"<i{n}" for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= lo and hi < 1 << 8 * n - 1))


def _pack(rows: DataFrame, block_rows: int, tag: str) -> DataFrame:
    """Rows packed into blocks of at most ``block_rows`` vectors of one
    dimension.  Partition ``part`` holds the part-th range of (length
    descending, id), so equal lengths spread over several partitions; each
    partition is cut into blocks where it lies."""
    ship(rows.sparkSession)
    parts = max(1, min(RANGES, -(-rows.count() // block_rows)))
    dealt = (rows.repartitionByRange(parts, F.col("norm2").desc(), F.col("vec_id"))
             .sortWithinPartitions(F.size("q"), F.col("norm2").desc(), "vec_id").select("vec_id", "q"))

    def pack(it):
        from pyspark import TaskContext

        part, ids, vecs, held, seq = TaskContext.get().partitionId(), [], [], 0, 0

        def block():
            nonlocal seq, held
            m = np.concatenate(vecs)
            norm = np.sqrt((m.astype(np.float64) ** 2).sum(1))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([m.shape[1]], pa.int32()),
                 pa.array([float(norm.max())], pa.float64()),
                 pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([_narrow(m).tobytes()], pa.binary())],
                names=["part", "seq", "dim", "longest", "ids", "rows"])
            seq, held = seq + 1, 0
            ids.clear()
            vecs.clear()
            return row

        for b in it:
            if not b.num_rows:
                continue
            i, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False)
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            turns = [*(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
            lo = 0
            for turn in turns:
                dim = int(size[lo])
                most = min(block_rows, max(1, BLOCK_VALUES // dim))
                if held and vecs[0].shape[1] != dim:
                    yield block()
                while lo < turn:
                    hi = min(turn, lo + most - held)
                    ids.append(i[lo:hi])
                    vecs.append(x[at[lo]:at[hi]].reshape(hi - lo, dim))
                    lo, held = hi, held + hi - lo
                    if held == most:
                        yield block()
        if held:
            yield block()

    return written(dealt.mapInArrow(pack, "part int, seq int, dim int, longest double, ids binary, rows binary"), tag)


def _open(dim: int, ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype="<i8")
    return i, np.frombuffer(rows, dtype=f"<i{len(rows) // (len(i) * dim)}").reshape(len(i), dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding",
          factor: float = 256.0, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products
    of the components floor(factor * x), ties to the smaller vec_id, rows with
    the query's own id left out.

    Exact.  Pass 1: every query meets one bucket of the longest vectors; its
    k-th best product there is a proven lower bound.  Pass 2: every bucket
    that this bound, or the better one that the buckets before it have set,
    does not rule out.  Vectors of another dimension than a query never meet
    it.  Fewer than ``k`` rows come back only where fewer
    candidates exist.  Vectors that are null, empty or hold a null or
    non-finite component, and rows with a null id, take no part.  Products are
    exact; one beyond 64 bits is reported as the nearest 64-bit bound.  Rows that
    share an id are separate candidates, and each such query row is answered.
    Empty tables give an empty result; other columns are never read.
    """
    spark = vectors.sparkSession
    buckets = _pack(quantised(vectors, id_col, vec_col, factor), bucket_rows, "mips-b")
    asked = _pack(quantised(queries, id_col, vec_col, factor), query_rows, "mips-q")

    # one block of the longest vectors: bucket_rows rows at most, whatever the input's size; its place first, so that no other is sent
    place = buckets.agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).first()
    first = place["first"] or (-1, -1)
    seed = [(r["dim"], r["ids"], r["rows"]) for r in buckets.filter((F.col("part") == first[0]) & (F.col("seq") == first[1])).collect()]

    def bound(it):
        top = Bucket(*_open(*seed[0])) if seed else None
        for batch in it:
            for r in batch.to_pylist():
                a = Asked(*_open(r["dim"], r["ids"], r["rows"]), None, k)
                if top is not None and top.rows.shape[1] == r["dim"]:
                    a.meet(top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([r["dim"]], pa.int32()),
                     pa.array([float(a.need().min()) * (1 - SLACK)], pa.float64()), pa.array([a.least.astype("<i8").tobytes()], pa.binary()),
                     pa.array([r["ids"]], pa.binary()), pa.array([r["rows"]], pa.binary())],
                    names=["part", "seq", "dim", "need", "least", "ids", "rows"])

    bounded = written(asked.select("part", "seq", "dim", "ids", "rows")
                      .mapInArrow(bound, "part int, seq int, dim int, need double, least binary, ids binary, rows binary"), "mips-s")

    # the grid of groups of queries and spans of buckets
    held = asked.agg(F.sum(F.length("ids") / 8 * (F.col("dim") * 8 + 16 * k + 40)).alias("bytes")).first()["bytes"] or 0
    groups = max(1, -(-int(held) // GROUP_BYTES))
    cores = spark.sparkContext.defaultParallelism
    spans = max(1, -(-place["n"] // SPAN), min(place["n"], -(-SPANS_A_CORE * cores // groups)))
    group = F.pmod(F.col("part") + F.col("seq"), F.lit(groups))
    span = F.pmod(F.col("part") + F.col("seq"), F.lit(spans))
    needs = bounded.groupBy(group.alias("group"), "dim").agg(F.min("need").alias("need"))
    asks = (bounded.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
            .select((group * spans + F.col("span")).cast("int").alias("cell"), F.lit(0).alias("kind"), "part", "seq", "dim",
                    F.lit(0.0).alias("longest"), "ids", "rows", "least"))
    met = (buckets.join(F.broadcast(needs), "dim").filter("longest >= need")
           .select((F.col("group") * spans + span).cast("int").alias("cell"), F.lit(1).alias("kind"), "part", "seq", "dim",
                   "longest", "ids", "rows", F.lit(None).cast("binary").alias("least")))
    cells = (asks.unionByName(met).repartitionById(groups * spans, F.col("cell"))
             .sortWithinPartitions("cell", "kind", F.desc("longest"), "part", "seq"))

    def best(it):
        cell, blocks = None, []

        def answers():
            for part, seq, a in blocks:
                row, rank = np.nonzero(np.arange(k) < a.found[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), part, np.int32)), pa.array(np.full(len(row), seq, np.int32)), pa.array(row.astype(np.int32)),
                     pa.array(a.ids[row]), pa.array(a.vecs[row, rank]), pa.array(a.scores[row, rank])],
                    names=["q_part", "q_seq", "q_row", "query_id", "vec_id", "score"])

        for batch in it:
            for j in range(batch.num_rows):
                r = {n: batch.column(n)[j].as_py() for n in batch.schema.names}
                if r["cell"] != cell:
                    yield from answers()
                    cell, blocks = r["cell"], []
                if r["kind"] == 0:
                    blocks.append((r["part"], r["seq"], Asked(*_open(r["dim"], r["ids"], r["rows"]), np.frombuffer(r["least"], dtype="<i8"), k)))
                    continue
                b = Bucket(*_open(r["dim"], r["ids"], r["rows"]))
                for _, _, a in blocks:
                    if a.rows.shape[1] == r["dim"]:
                        a.meet(b)
        yield from answers()

    found = cells.mapInArrow(best, "q_part int, q_seq int, q_row int, query_id long, vec_id long, score long")
    w = Window.partitionBy("q_part", "q_seq", "q_row").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")

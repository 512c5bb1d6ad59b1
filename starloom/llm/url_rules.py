"""URL filter lists as a sorted digest array.

Rules are ``(host, path)`` keys with a verdict.  The keys' 64-bit xxhash
digests are written as one sorted array plus an array of byte offsets into
the stored full strings; tasks memory-map the files and probe them with a
vectorised binary search (``numpy.searchsorted``), then compare the stored
string, so that a digest collision can never decide a URL.

A rule fits its host and every subdomain when the URL's path starts with the
rule's path.  The longest fitting rule wins (longest host, then longest
path).  A URL that no rule fits gets the list's default verdict.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

#: Rows of one probing step inside a task; bounds its memory.
PROBE_ROWS = 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


def parse_rule(verdict: str, pattern: str) -> Rule:
    """``example.com/en/`` -> host ``example.com``, path ``/en/``."""
    host, slash, path = pattern.partition("/")
    return Rule(verdict, host.lower(), slash + path)


class DigestIndex:
    """Memory-mapped sorted digests, string offsets, strings and verdicts."""

    def __init__(self, folder: str):
        load = lambda n: np.load(os.path.join(folder, n), mmap_mode="r")
        self.digest, self.start, self.verdict = load("digest.npy"), load("start.npy"), load("verdict.npy")
        self.blob, self.path_len = load("blob.npy"), np.load(os.path.join(folder, "path_len.npy"))

    @staticmethod
    def write(rules: Iterable[Rule], folder: str) -> None:
        """Later duplicates of a key replace earlier ones."""
        by_key = {r.key.encode(): r for r in rules}
        keys = sorted(by_key, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        digest = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        start = np.zeros(len(keys) + 1, dtype=np.int64)
        start[1:] = np.cumsum([len(k) for k in keys]) if keys else 0
        os.makedirs(folder, exist_ok=True)
        save = lambda n, a: np.save(os.path.join(folder, n), a)
        save("digest.npy", digest)
        save("start.npy", start)
        save("verdict.npy", np.array([by_key[k].verdict == "block" for k in keys], dtype=np.uint8))
        save("blob.npy", np.frombuffer(b"".join(keys) or b"\0", dtype=np.uint8))
        save("path_len.npy", np.array(sorted({len(r.path.encode()) for r in by_key.values()}), dtype=np.int64))

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Row of each probe in the index, -1 where it is absent."""
        out = np.full(len(probes), -1, dtype=np.int64)
        if not len(self.digest) or not probes:
            return out
        d = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), dtype=np.uint64, count=len(probes))
        lo = np.searchsorted(self.digest, d, side="left")
        hi = np.searchsorted(self.digest, d, side="right")
        for i in np.flatnonzero(hi > lo):
            for row in range(lo[i], hi[i]):
                if self.blob[self.start[row]:self.start[row + 1]].tobytes() == probes[i]:
                    out[i] = row
                    break
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge(index: DigestIndex, urls: list[str | None], default: str):
    """host, path, rule and verdict of each URL.

    Probes run from the most to the least specific key: every suffix of the
    host at a label border, each with every path prefix whose length some
    rule has.  One vectorised search answers a whole slice of URLs."""
    hosts, paths, owner, probes = [], [], [], []
    for i, u in enumerate(urls):
        h, p = split_url(u)
        hosts.append(h)
        paths.append(p)
        if not h:
            continue
        pb = p.encode()
        cuts = [int(n) for n in index.path_len[::-1] if n <= len(pb)]
        suffix = h
        while True:
            sb = suffix.encode()
            for n in cuts:
                owner.append(i)
                probes.append(sb + pb[:n])
            _, dot, suffix = suffix.partition(".")
            if not dot:
                break
    row = index.find(probes)
    best = np.full(len(urls), -1, dtype=np.int64)
    hit = np.flatnonzero(row >= 0)[::-1]
    best[np.asarray(owner, dtype=np.int64)[hit]] = row[hit]  # the first probe that hit is written last
    rules, verdicts = [], []
    for b in best:
        if b < 0:
            rules.append(None)
            verdicts.append(default)
        else:
            rules.append(index.blob[index.start[b]:index.start[b + 1]].tobytes().decode())
            verdicts.append("block" if index.verdict[b] else "allow")
    return hosts, paths, rules, verdicts


_OPEN: dict[str, DigestIndex] = {}


def _index(names: tuple[str, ...]) -> DigestIndex:
    if names[0] not in _OPEN:
        folder = tempfile.mkdtemp(prefix="urls-")
        for n in names:
            os.symlink(SparkFiles.get(n), os.path.join(folder, n.rsplit("-", 1)[1]))
        _OPEN[names[0]] = DigestIndex(folder)
    return _OPEN[names[0]]


def apply_url_rules(spark: SparkSession, urls: DataFrame, rules: Iterable[Rule], *, id_col: str = "page_id",
                    url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col``, host, path, rule, verdict for every row of ``urls``.

    The index files go to every executor through Spark's file distribution
    (their size follows the rule list, never the URLs) and are memory-mapped
    there, so the pages are shared by an executor's workers.  No shuffle.

    Null, empty and malformed URLs have an empty host and path, fit no rule
    and get ``default``.  Repeated rows are judged alike; an empty table or an
    empty rule list gives an empty result or ``default`` everywhere; other
    columns of ``urls`` are never read.
    """
    ship(spark)
    folder = tempfile.mkdtemp(prefix="urlidx-")
    DigestIndex.write(rules, folder)
    tag = os.path.basename(folder)
    names = []
    for n in sorted(os.listdir(folder)):
        os.rename(os.path.join(folder, n), to := os.path.join(folder, f"{tag}-{n}"))
        spark.sparkContext.addFile(to)
        names.append(os.path.basename(to))
    files = tuple(names)

    def run(it):
        index = _index(files)
        for b in it:
            for lo in range(0, b.num_rows, PROBE_ROWS):
                s = b.slice(lo, PROBE_ROWS)
                h, p, r, v = judge(index, s.column(1).to_pylist(), default)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(h, pa.string()), pa.array(p, pa.string()),
                     pa.array(r, pa.string()), pa.array(v, pa.string())],
                    names=[id_col, "host", "path", "rule", "verdict"])

    kind = urls.schema[id_col].dataType.simpleString()
    rows = urls.select(F.col(id_col), F.col(url_col).cast("string").alias("__url"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")

"""Prefix trie of conversations: what they share from their first turn on.

A turn is known by the SHA-256 digest of its role and text.  Conversations
with the same turns are one sequence from the start, whatever their number;
their ids are written out in order and hashed in blocks.  The distinct
sequences are range-partitioned in their order into shards.  A shard codes its
turns as small integers in digest order and builds a ternary search tree: a
node holds one turn, with links to lower and higher turns at the same depth
and to the next depth.  Sequences go in median first, so the links of a depth
stay balanced.  One walk without recursion adds up members, leaves and savings
from the leaves to the root.

Only prefixes of a shard's first or last sequence can go on in a neighbour.
Each shard knows how many turns its first sequence shares with the last one
before it, and its last with the first one after it; so it counts a node's own
length, and the node as its parent's child, only where the node begins, and a
leaf only where nothing continues it.  All figures then add up, and the
boundary nodes of all shards are merged by their prefix.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, ship, written

#: Turns of a shard (about), ids of a block, and copies of the boundary nodes that other nodes look their parent up in.
SHARD_TURNS, BLOCK_IDS, COPIES = 40_000, 4096, 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place from 1), digest and size (code points) of each turn.

    Turns are ordered by turn, null first, then by role and text; a null role
    or text is empty.  Rows without conv_id take no part.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.filter("conv_id is not null").select("conv_id", place.cast("long").alias("at"), digest.alias("digest"), F.length("text").cast("long").alias("size"))


def sequences(turns_: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, key (a hash of the sequence), digests and sizes: one row per
    conversation of ``turns_``, and one without turns for any other of ``ids``."""
    one = F.struct("at", "digest", "size")
    rows = turns_.select("conv_id", one.alias("t"))
    if ids is not None:
        rows = rows.unionByName(ids.select("conv_id"), allowMissingColumns=True)
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    key = F.sha2(F.array_join(F.transform("t", lambda t: F.hex(t.digest)), ""), 256)
    return held.select("conv_id", key.alias("key"), F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes"))


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as one row per key and at most BLOCK_IDS ids."""
    only("prefix_trie")
    for b in it:
        key, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        out, lo = [], 0
        for i in range(1, len(key) + 1):
            if i == len(key) or key[i] != key[lo] or i - lo == BLOCK_IDS:
                out.append((key[lo], ids[lo], i - lo, ",".join(map(str, ids[lo:i]))))
                lo = i
        yield pa.RecordBatch.from_pylist([dict(zip(("key", "first", "n", "ids"), r)) for r in out], schema=pa.schema([("key", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]))


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks as one row per key: a running hash, whatever the number of ids."""
    only("prefix_trie")
    kind = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
    key, first, n, sha = None, 0, 0, hashlib.sha256()
    for b in it:
        out = []
        for k, f, m, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
            if k != key:
                if key is not None:
                    out.append({"key": key, "conv_id": first, "n": n, "ends_sha256": sha.hexdigest()})
                key, first, n, sha = k, f, 0, hashlib.sha256()
            sha.update(("," if n else "").encode() + ids.encode())
            n += m
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "conv_id": first, "n": n, "ends_sha256": sha.hexdigest()}], schema=kind)


def ends(seqs: DataFrame) -> DataFrame:
    """key, conv_id (the smallest), n and ends_sha256 of each distinct
    sequence.  The ids of a hot sequence are sorted and written out in many
    tasks; only the hash over the ready blocks runs in order."""
    blocks = seqs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        _blocks, "key string, first long, n long, ids string")
    return blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key string, conv_id long, n long, ends_sha256 string")


class TernaryTree:
    """Ternary search tree over sequences of integers.  Node 0 is the empty
    prefix; ``equal`` leads from a prefix to the tree of its next turns."""

    def __init__(self):
        self.turn, self.low, self.equal, self.high = [-1], [-1], [-1], [-1]
        self.parent, self.size, self.row = [-1], [0], [-1]

    def _new(self, turn: int, parent: int, size: int) -> int:
        for column, x in ((self.turn, turn), (self.low, -1), (self.equal, -1), (self.high, -1), (self.parent, parent), (self.size, size), (self.row, -1)):
            column.append(x)
        return len(self.turn) - 1

    def insert(self, ids: list[int], sizes: list[int], row: int) -> None:
        at, turn, equal = 0, self.turn, self.equal
        for x, size in zip(ids, sizes):
            i = equal[at]
            if i < 0:
                i = equal[at] = self._new(x, at, size)
            while turn[i] != x:
                side = self.low if x < turn[i] else self.high
                if side[i] < 0:
                    side[i] = self._new(x, at, size)
                i = side[i]
            at = i
        self.row[at] = row

    @staticmethod
    def of(seqs: list[list[int]], sizes: list[list[int]]) -> "TernaryTree":
        """Tree of sorted distinct sequences, the median of each stretch first."""
        tree, todo = TernaryTree(), [(0, len(seqs))]
        while todo:
            lo, hi = todo.pop()
            if lo < hi:
                mid = (lo + hi) // 2
                tree.insert(seqs[mid], sizes[mid], mid)
                todo += [(mid + 1, hi), (lo, mid)]
        return tree

    def walk(self) -> list[int]:
        """All nodes, each after its prefix."""
        out, todo = [], [0]
        while todo:
            i = todo.pop()
            out.append(i)
            todo += [j for j in (self.equal[i], self.low[i], self.high[i]) if j >= 0]
        return out

    def path(self, ids: list[int]) -> list[int]:
        """Nodes of the prefixes of a sequence, the empty one first."""
        out = [0]
        for x in ids:
            i = self.equal[out[-1]]
            while self.turn[i] != x:
                i = self.low[i] if x < self.turn[i] else self.high[i]
            out.append(i)
        return out


_NODE = ("key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "shared long, own long, ends_sha256 string, size long")
_KIND = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _NODE.split(", ")])


def shard_nodes(rows: list[dict], before: int | None, after: int | None) -> list[dict]:
    """Nodes of one shard: sorted distinct sequences with ``digests``,
    ``sizes``, ``n``, ``conv_id`` and ``ends_sha256``.  ``before`` is the number of turns
    that the first one shares with the sequence before the shard, ``after``
    that of the last one with the sequence after it (None: there is none).
    Boundary nodes have a key, others the figures of the whole corpus."""
    code = {d: i for i, d in enumerate(sorted({d for r in rows for d in r["digests"]}))}
    seqs = [[code[d] for d in r["digests"]] for r in rows]
    tree = TernaryTree.of(seqs, [r["sizes"] for r in rows])
    order = tree.walk()
    m = len(order)
    first, last = tree.path(seqs[0]), tree.path(seqs[-1])
    key: dict[int, str] = {}
    for nodes, digests, shared in ((first, rows[0]["digests"], before), (last, rows[-1]["digests"], after)):
        sha = hashlib.sha256()
        for depth in range(min(shared or 0, len(digests)) + 1):  # the empty prefix is always shared
            if depth:
                sha.update(digests[depth - 1])
            key[nodes[depth]] = sha.hexdigest()
    old = set(first[:before + 1]) if before is not None else set()  # they begin in an earlier shard
    open_end = last[-1] if after is not None and after == len(seqs[-1]) else -1  # the next shard continues it

    members, least, leaves = [0] * m, [None] * m, [0] * m
    children, shared, own, depth = [0] * m, [0] * m, [0] * m, [0] * m
    sha_of: dict[int, str] = {}
    has_next = [False] * m
    for i in order[1:]:
        depth[i] = depth[tree.parent[i]] + 1
        has_next[tree.parent[i]] = True
    for i in reversed(order):
        if tree.row[i] >= 0:
            r = rows[tree.row[i]]
            members[i] += r["n"]
            least[i] = r["conv_id"] if least[i] is None else min(least[i], r["conv_id"])
            sha_of[i] = r["ends_sha256"]
        if not has_next[i] and i != open_end:
            leaves[i] += 1
        shared[i] += members[i] * tree.size[i]
        own[i] += 0 if i in old else tree.size[i]
        p = tree.parent[i]
        if p >= 0:
            members[p] += members[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
            leaves[p] += leaves[i]
            children[p] += i not in old
            shared[p] += shared[i]
            own[p] += own[i]
    out = []
    for i in order:
        p = tree.parent[i]
        edge = i in key
        out.append({"key": key.get(i), "parent_key": key.get(p), "conv_id": least[i], "depth": depth[i],
                    "parent_conv_id": None if p < 0 or p in key else least[p], "n_convs": members[i], "n_children": children[i],
                    "n_leaves": leaves[i], "shared": shared[i], "own": own[i], "ends_sha256": sha_of.get(i, None if edge else NO_ENDS), "size": tree.size[i]})
    return out


def _shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and sequence; one shard is held at a time."""
    only("prefix_trie")

    def done():
        nodes = shard_nodes(rows, rows[0]["before"], rows[0]["after"])
        for k in range(0, len(nodes), 20_000):
            yield pa.RecordBatch.from_pylist(nodes[k:k + 20_000], schema=_KIND)

    rows: list[dict] = []
    for b in it:
        for r in b.to_pylist():
            if rows and rows[0]["shard"] != r["shard"]:
                yield from done()
                rows = []
            rows.append(r)
    if rows:
        yield from done()


def prefix_trie(seqs: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the ``sequences``: conv_id (the smallest
    member), depth, parent_conv_id (null for the empty prefix), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation without turns is a member of the empty prefix.  Equal
    conversations are members alike; equal figures need no order, as nodes are
    told apart by their prefix.  An empty table gives no node.  A conversation
    is held as one row of 40 bytes a turn, a shard as one tree.
    """
    ship(seqs.sparkSession)
    seqs = written(seqs, "trie-seqs")
    distinct = written(seqs.join(ends(seqs), ["key", "conv_id"]).drop("key"), "trie-distinct")  # the smallest member's row stands for all
    total = distinct.agg(F.coalesce(F.sum(F.size("digests") + 1), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // shard_turns))
    sharded = written(distinct.repartitionByRange(n_shards, "digests").withColumn("shard", F.spark_partition_id()), "trie-shards")

    in_order = Window.orderBy("shard")  # one row per shard
    edge = sharded.groupBy("shard").agg(F.min("digests").alias("first"), F.max("digests").alias("last"))
    edge = edge.select("shard", "first", "last", F.lag("last").over(in_order).alias("left"), F.lead("first").over(in_order).alias("right"))
    same = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)  # noqa: E731  first place that differs, or 0
    common = lambda a, b: F.when(F.col(b).isNotNull(), F.when(same(a, b) > 0, same(a, b) - 1).otherwise(F.size(a)))
    edge = edge.select("shard", common("first", "left").cast("long").alias("before"), common("last", "right").cast("long").alias("after"))
    rows = sharded.join(edge, "shard").select("shard", "digests", "sizes", "conv_id", "n", "ends_sha256", "before", "after")
    nodes = written(rows.repartition("shard").sortWithinPartitions("shard", "digests").mapInArrow(_shards, _NODE), "trie-nodes")

    add = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared", "own")]
    merged = nodes.filter("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        *add, F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256"))
    both = merged.unionByName(nodes.filter("key is null").select(*merged.columns))
    copies = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    found = both.withColumn("copy", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(COPIES)).cast("int")).join(copies, ["parent_key", "copy"], "left")
    return found.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        (F.col("shared") - F.col("own")).alias("saved_tokens"), "ends_sha256")


def with_shared_heads(own: DataFrame, *, group: int = 100, most: int = 6) -> DataFrame:
    """The ``turns`` of conversations rebuilt: conversation c takes the first
    h turns (all, if fewer) of c - c % group in place of its own, h being
    crc32(c as text) % most.  A base has at most ``group`` members and gives
    at most most - 1 turns, so no key of the join is hot."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    tails = own.withColumn("h", h).filter("at > h").drop("h")
    convs = own.select("conv_id").distinct().select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = own.filter(F.col("at") < most).withColumnRenamed("conv_id", "base")
    return tails.unionByName(convs.join(heads, "base").filter("at <= h").select(*tails.columns))

"""Prefix trie against a plain trie of Python dictionaries."""
import hashlib
import random
import zlib

import pytest

from starloom.llm import prefix_trie as T


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    out = []
    for p, node in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        children = lambda q: [x for x in nodes if len(x) == len(q) + 1 and x[:len(q)] == q]
        saved = sum((len(nodes[q]["members"]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.append((min(node["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(node["members"]), len(children(p)),
                    sum(not children(q) for q in below), saved, sha))
    return sorted(out, key=str)


def odd_rows(n=160, seed=12):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 + (100 if c % 7 == 0 else 0)
        if r.random() < .3:
            rows += [(c, t, "user", "the same") for t in range(3)]
            continue
        for t in range(r.randint(1, 7)):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "ünï🎉", "same", "x" * 50])))
    return rows + rows[:5] + [(None, 0, "user", "no id"), (7, 1, None, None), (-5, 0, "a", "b"), (-5, 0, "a", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")


def nodes_of(df, **options):
    own = T.turns(df)
    seqs = T.sequences(T.with_shared_heads(own), own.select("conv_id").distinct())
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in T.prefix_trie(seqs, **options).select(*cols).collect()), key=str)


@pytest.mark.parametrize("shard_turns", [10 ** 6, 40])
def test_equal_to_a_plain_trie(spark, shard_turns):
    rows = odd_rows()
    assert nodes_of(frame(spark, rows).repartition(3), shard_turns=shard_turns) == brute(rebuilt(rows))


def test_empty_table_and_turnless_conversations(spark):
    assert nodes_of(frame(spark, odd_rows()).limit(0)) == []
    short = [(c, 0, "u", "t") for c in (1, 2, 3, 4)]  # no base: those with h > 0 lose their only turn
    assert nodes_of(frame(spark, short)) == brute(rebuilt(short))
    assert any(r[1] == 0 and r[7] != T.NO_ENDS for r in brute(rebuilt(short)))


def test_ids_of_a_hot_sequence_are_hashed_in_blocks(spark):
    n = 3 * T.BLOCK_IDS + 5
    seqs = spark.range(n).selectExpr(f"{n - 1} - id as conv_id", "'k' as key")
    (row,) = T.ends(seqs.repartition(5)).collect()
    assert (row.conv_id, row.n, row.ends_sha256) == (0, n, hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest())


def shards_of(convs, cuts):
    """Plain driver of ``shard_nodes``: distinct sequences cut at ``cuts``."""
    by_seq = {}
    for c, turns in convs.items():
        by_seq.setdefault(tuple(hashlib.sha256(repr(t).encode()).digest() for t in turns), []).append((c, [len(t[1]) for t in turns]))
    seqs = sorted(by_seq)
    rows = [{"digests": list(s), "sizes": by_seq[s][0][1], "n": len(by_seq[s]), "conv_id": min(c for c, _ in by_seq[s]),
             "ends_sha256": hashlib.sha256(",".join(map(str, sorted(c for c, _ in by_seq[s]))).encode()).hexdigest()} for s in seqs]
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    edges = sorted({0, len(seqs), *(c for c in cuts if c < len(seqs))})
    nodes = []
    for lo, hi in zip(edges, edges[1:]):
        nodes += T.shard_nodes(rows[lo:hi], share(seqs[lo - 1], seqs[lo]) if lo else None, share(seqs[hi - 1], seqs[hi]) if hi < len(seqs) else None)
    return nodes


def test_any_cut_into_shards_adds_up():
    for seed in range(12):
        convs = rebuilt(odd_rows(40, seed))
        want, r = brute(convs), random.Random(seed)
        for cuts in ([], [1], list(range(60)), [r.randint(1, 40) for _ in range(4)]):
            merged, plain = {}, []
            for x in shards_of(convs, cuts):
                if x["key"] is None:
                    plain.append(x)
                    continue
                if x["key"] not in merged:
                    merged[x["key"]] = x
                    continue
                m = merged[x["key"]]
                for f in ("n_convs", "n_children", "n_leaves", "shared", "own"):
                    m[f] += x[f]
                m["conv_id"] = min(m["conv_id"], x["conv_id"])
                m["ends_sha256"] = m["ends_sha256"] or x["ends_sha256"]
            got = [(x["conv_id"], x["depth"], merged[x["parent_key"]]["conv_id"] if x["parent_key"] else x["parent_conv_id"], x["n_convs"], x["n_children"],
                    x["n_leaves"], x["shared"] - x["own"], x["ends_sha256"] or T.NO_ENDS) for x in [*merged.values(), *plain]]
            assert sorted(got, key=str) == want


def test_one_very_long_conversation_and_balance():
    long = [(0, t, "u", str(t)) for t in range(20_000)]
    nodes = shards_of(rebuilt(long), [])
    assert len(nodes) == 20_001 and max(x["depth"] for x in nodes) == 20_000
    tree = T.TernaryTree.of([[i] for i in range(4095)], [[1]] * 4095)

    def height(i):
        todo, most = [(i, 1)], 0
        while todo:
            j, d = todo.pop()
            most = max(most, d)
            todo += [(k, d + 1) for k in (tree.low[j], tree.high[j]) if k >= 0]
        return most
    assert height(tree.equal[0]) == 12  # the least possible for 4095 turns

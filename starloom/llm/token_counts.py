"""Exact token counts by compiled finite-state transducers.

Byte-level BPE is split in two deterministic machines.

*Splitter.*  The pre-tokenisation pattern of byte-level vocabularies, compiled
to a transducer over eight character classes (with two characters of
lookahead folded into the class).  A transition that opens a new pre-token
emits 1.  Text is cut into chunks; each chunk's effect is a map from start
state to end state; the maps compose associatively, so the start state of
every chunk comes from one parallel prefix scan, and all chunks then run at
once.

*Token machine.*  A transducer over bytes whose transitions carry the change
in the number of tokens of the prefix read so far.  Its states are built from
the vocabulary on demand (like a lazily determinised automaton): a state holds
every position at which a token that is still growing may start, as (trie
node, token that ends there, tokens up to there relative to now).  In BPE the
last token of a prefix is the only vocabulary token ending there that is
compatible with the token before it, so each transition is deterministic.  The
compiled transitions live in a numpy hash table and step all pre-tokens of a
batch in lock step.
"""
from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, holds, only, ship

# Character classes (rows) and splitter states (columns).
LETTER, NUMBER, OTHER, APOS2, APOS3, SPACE_LAST, WHITE_LAST, WHITE, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, SKIP1, SKIP2 = range(8)
#: Characters per chunk of the splitter, and bytes of text per step.
CHUNK = 256
STEP_BYTES = 2 << 20
#: Pre-tokens longer than this step alone, so that one long run of letters doesn't hold up the rest.
LONG = 48
#: Compiled states kept at a time; beyond it the machine starts anew (bounded memory, same counts).
MAX_STATES = 400_000


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for (class, state)."""
    go, emit = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.uint8)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOS2: IN_OTHER, APOS3: IN_OTHER}
    for c in range(9):
        for s in range(8):
            if c == END:
                continue
            if s == SKIP1:  # last letter of 's 't 'm 'd, 're 've 'll
                go[c, s] = FRESH
            elif s == SKIP2:
                go[c, s] = SKIP1
            elif c in run and s in (run[c], AFTER_SPACE):
                go[c, s] = run[c]
            elif c == WHITE:
                go[c, s], emit[c, s] = IN_WHITE, s != IN_WHITE
            else:
                go[c, s] = {APOS2: SKIP1, APOS3: SKIP2, SPACE_LAST: AFTER_SPACE, WHITE_LAST: FRESH}.get(c, run.get(c, FRESH))
                emit[c, s] = 1
    return go, emit


GO, EMIT = _splitter()
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point."""
    global _CLASS
    if _CLASS is None:
        kind = {"L": LETTER, "N": NUMBER, "Z": WHITE}
        _CLASS = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _CLASS[[9, 10, 11, 12, 13, 0x85]] = WHITE
    return _CLASS


def symbols(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Input symbols of the splitter for code points; ``ends`` marks separators."""
    c = _classes()[cp]
    c[ends] = END
    nxt = np.append(c[1:], np.uint8(END))
    last = (c == WHITE) & (nxt <= OTHER)
    c[last] = np.where(cp[last] == 32, SPACE_LAST, WHITE_LAST)
    at = np.flatnonzero((cp == 39) & (c == OTHER))
    if len(at):
        pad = np.append(np.where(c == END, 0, cp), [0, 0])
        one, two = pad[at + 1], pad[at + 2]
        letter = lambda x: np.isin(one, [ord(i) for i in x])
        c[at[letter("stmd")]] = APOS2
        c[at[(letter("rv") & (two == ord("e"))) | (letter("l") & (two == ord("l")))]] = APOS3
    return c


def starts(sym: np.ndarray) -> np.ndarray:
    """True where a pre-token begins: chunk maps, prefix scan, then one pass."""
    n = -(-len(sym) // CHUNK)
    cols = np.full(n * CHUNK, END, np.uint8)
    cols[:len(sym)] = sym
    cols = np.ascontiguousarray(cols.reshape(n, CHUNK).T).astype(np.intp) * 8
    go, emit = GO.ravel().astype(np.intp), EMIT.ravel().astype(bool)
    maps = np.tile(np.arange(8), (n, 1))
    for j in range(CHUNK):
        maps = go[cols[j][:, None] + maps]
    d = 1
    while d < n:  # inclusive scan: map i after all maps before it
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d], axis=1)])
        d *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]])
    out = np.empty((CHUNK, n), bool)
    for j in range(CHUNK):
        k = cols[j] + state
        out[j] = emit[k]
        state = go[k]
    return out.T.ravel()[:len(sym)]


_ZERO = 1 << 19


def _packed(node: int, token: int, d: int) -> int:
    """A growing token: trie node, the token before it (-1: none) and the count there relative to now."""
    return node << 40 | (token + 1) << 20 | d + _ZERO


class TokenMachine:
    """Lazily compiled transducer over bytes; transitions carry count changes."""

    ROOT = 0

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank = {m: i for i, m in enumerate(merges)}
        self.bytes_of = {i: t for t, i in vocab.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        reachable = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        for t, i in vocab.items():
            if t not in reachable:
                continue
            node = self.ROOT
            for b in t:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.inner = {k >> 8 for k in self.child}
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (_packed(self.ROOT, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.fits.clear()
        self._table(1 << 18)

    def _table(self, slots: int) -> None:
        self.mask, self.filled = slots - 1, 0
        self.keys, self.next, self.delta = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int16)

    def encode(self, text: bytes) -> list[bytes]:
        """Plain merging by rank; used for pairs of tokens only."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding?"""
        got = self.fits.get(left << 20 | right)
        if got is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            got = self.fits[left << 20 | right] = self.encode(a + b) == [a, b]
        return got

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the token count."""
        alive, hit = [], None
        for entry in self.states[state]:
            node = self.child.get(entry >> 40 << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if hit is None and token >= 0:
                before = (entry >> 20 & 0xFFFFF) - 1
                if before < 0 or self.compatible(before, token):
                    hit = token, (entry & 0xFFFFF) - _ZERO + 1
            if node in self.inner:
                alive.append(node << 40 | entry & 0xFFFFFFFFFF)
        token, change = hit
        form = (*(e - change for e in alive), _packed(self.ROOT, token, 0))
        to = self.number.get(form)
        if to is None:
            to = self.number[form] = len(self.states)
            self.states.append(form)
        return to, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the empty slot where it belongs."""
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot = (h >> np.uint64(32)).astype(np.int64) & self.mask
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = self.keys[slot[todo]]
            todo = todo[(at != keys[todo]) & (at != -1)]
        return slot

    def _put(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        if 4 * (self.filled + len(keys)) > self.mask:
            k, n, d = self.keys, self.next, self.delta
            old = k >= 0
            size = self.mask + 1
            while 4 * (int(old.sum()) + len(keys)) > size:
                size *= 2
            self._table(2 * size)
            self._put(k[old], n[old], d[old])
        left = np.arange(len(keys))
        while len(left):  # of keys that want the same slot, one gets it each round
            s = self._slots(keys[left])
            _, first = np.unique(s, return_index=True)
            pick = left[first]
            self.keys[s[first]], self.next[s[first]], self.delta[s[first]] = keys[pick], to[pick], change[pick]
            left = np.delete(left, first)
        self.filled += len(keys)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state.astype(np.int64) << 8 | byte
        slot = self._slots(keys)
        miss = self.keys[slot] != keys
        if miss.any():
            new = np.unique(keys[miss])
            got = np.array([self.transition(int(k >> 8), int(k & 255)) for k in new], dtype=np.int64)
            self._put(new, got[:, 0].astype(np.int32), got[:, 1].astype(np.int16))
            slot = self._slots(keys)
        return self.next[slot], self.delta[slot]

    def counts(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token buf[start : start + length]."""
        if len(self.states) > MAX_STATES:
            self.clear()
        out = np.zeros(len(start), np.int64)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= LONG]
        at, size = start[order], length[order]
        more = np.searchsorted(-size, -np.arange(1, LONG + 1), side="right")  # tokens with a j-th byte
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        for j in range(LONG):
            n = int(more[j])
            if not n:
                break
            state[:n], change = self.step(state[:n], buf[at[:n] + j])
            total[:n] += change
        out[order] = total
        for i in np.flatnonzero(length > LONG):
            out[i] = self._long(buf[start[i]:start[i] + length[i]].tobytes())
        return out

    def _long(self, text: bytes) -> int:
        state = n = 0
        memo: dict[int, tuple[int, int]] = {}
        for b in text:
            if len(self.states) > 2 * MAX_STATES:  # keep the current state only
                form = self.states[state]
                self.clear()
                memo.clear()
                state = self.number.get(form, len(self.states))
                if state:
                    self.number[form] = state
                    self.states.append(form)
            key = state << 8 | b
            got = memo.get(key)
            if got is None:
                got = memo[key] = self.transition(state, b)
            state, change = got
            n += change
        return n


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts of whole texts for a byte-level BPE ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE files with the standard split pattern can be compiled")
        raw = byte_letters()
        as_bytes = lambda t: bytes(raw[c] for c in t)
        added = [a["content"] for a in spec["added_tokens"]]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = TokenMachine({as_bytes(t): i for t, i in model["vocab"].items() if t not in added},
                                    [(as_bytes(a), as_bytes(b)) for a, b in merges])
        self.special = sorted(added, key=len, reverse=True)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string inside a text is one token."""
        segments, owner, n = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = [t]
            for s in self.special:
                cut = [p.split(s) for p in parts]
                n[i] += sum(len(c) - 1 for c in cut)
                parts = [p for c in cut for p in c]
            segments += parts
            owner += [i] * len(parts)
        joined = "\n".join(segments) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
        ends = np.cumsum(np.fromiter((len(s) + 1 for s in segments), np.int64, len(segments))) - 1
        is_end = np.zeros(len(cp), bool)
        is_end[ends] = True
        begin = starts(symbols(cp, is_end))
        edge = np.flatnonzero(begin | is_end)
        first = begin[edge]
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        at = offset[edge]
        size = np.diff(at, append=at[-1:])
        buf = np.frombuffer(joined.encode("utf-8"), np.uint8)
        got = self.machine.counts(buf, at[first], size[first])
        segment = np.searchsorted(ends, edge[first])
        np.add.at(n, np.asarray(owner, np.int64)[segment], got)
        return n


_COUNTERS: dict[str, TokenCounter] = {}
holds("token_counts", _COUNTERS)


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit of every whole text; no
    shuffle, only the two named columns are read.

    A null text counts as empty (0 bytes, 0 tokens).  Repeated rows give
    repeated results, an empty table an empty result.  Memory in a task
    follows the longest single text.
    """
    ship(docs.sparkSession)

    def run(it):
        only("token_counts")
        c = counter(tokenizer_path)
        for b in batches(it, STEP_BYTES):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

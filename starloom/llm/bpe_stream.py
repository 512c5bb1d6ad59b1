"""Byte-pair encoding and decoding as streaming transducers.

*Encoding.*  Merges run in the order of their rank.  Take a word and a longer
one that continues it: their merges can differ only from the end of the
shorter one, and each merge that carries the difference to the left has a
higher rank than the one before it and takes as right part a token that
begins with that one's left part.  The longest such chain of rules, measured
in bytes, is the *sufficient lookahead* of the merge list: a token that ends so
far before the end of what has been read never changes.  ``Lookahead`` finds
the chain by one pass over the rules; ``Encoder`` holds a buffer of four times
that size, emits what is stable and keeps the rest.  Words that fit a small
buffer are merged in lock step in numpy, all of a batch at once.

*Decoding.*  A vocabulary with a byte-level decoder turns ids into bytes, and
``Utf8`` is the state machine from bytes to text: it holds at most three bytes
back.  A vocabulary without a decoder joins its tokens by spaces.
"""
from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Pool, by_chunk, gathered, split_chunks, text_ids
from .common import batches, holds, only, ship
from .token_counts import byte_letters

STEP_BYTES = 4 << 20
#: Symbols of the widest words that are merged in lock step; longer ones stream.
WIDE = 64
#: Words kept with their ids by a task, and tokens decoded at a time.
CACHE_WORDS, DECODE_TOKENS = 300_000, 1 << 16
NONE = 1 << 40


class Lookahead:
    """Sufficient lookahead of a merge list, in bytes (``size``).

    ``rules`` are (left, right, product) by rank.  A list in which a token is
    used before it is made, or is made by two rules, has none: ``size`` is
    then None, and words are merged as a whole."""

    def __init__(self, rules: list[tuple[int, int, int]], length: dict[int, int]):
        made: dict[int, int] = {}
        reach: dict[int, int] = {}  # token -> longest chain that ends in a rule with this token on the left
        best = 0
        products = {p for _, _, p in rules}
        for left, right, product in rules:
            if product in made or any(t in products and t not in made for t in (left, right)):
                self.size = None
                return
            t, chain = right, reach.get(right, 0)
            while t in made:  # tokens that ``right`` begins with
                t = made[t]
                chain = max(chain, reach.get(t, 0))
            chain += length[left]
            reach[left] = max(reach.get(left, 0), chain)
            best = max(best, chain)
            made[product] = left
        self.size = best


class Merges:
    """Rules as pair -> (rank, product): a dictionary and, for whole batches, sorted keys."""

    def __init__(self, rules: list[tuple[int, int, int]]):
        self.of = {(a, b): (r, p) for r, (a, b, p) in reversed(list(enumerate(rules)))}
        key = np.array([a << 32 | b for a, b in self.of], np.int64)
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        got = np.array(list(self.of.values()), np.int64).reshape(-1, 2)[order]
        self.rank, self.product = np.append(got[:, 0], NONE), np.append(got[:, 1], 0)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NONE where there is no rule or no symbol (-1)."""
        key = left << 32 | right
        at = np.searchsorted(self.key, key)
        ok = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], NONE), self.product[at]

    def merge(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(token, number of symbols) of one sequence: lowest rank first, leftmost first."""
        of, n = self.of, len(symbols)
        sym, size, nxt, prv = list(symbols), [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, symbols[i + 1]) for i in range(n - 1) if (r := of.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, right = heapq.heappop(heap)
            j = nxt[i]
            if not size[i] or j >= n or sym[j] != right:
                continue
            got = of.get((sym[i], right))
            if got is None or got[0] != rank:
                continue
            sym[i], size[i], size[j] = got[1], size[i] + size[j], 0
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if more := of.get((sym[i], sym[k])):
                    heapq.heappush(heap, (more[0], i, sym[k]))
            if (p := prv[i]) >= 0 and (more := of.get((sym[p], sym[i]))):
                heapq.heappush(heap, (more[0], p, sym[i]))
        return [(sym[i], size[i]) for i in range(n) if size[i]]

    def lock_step(self, words: np.ndarray) -> np.ndarray:
        """The same for many short sequences: a row of symbols each, -1 after
        the end.  Every row does its next merge in every round."""
        out, rows = words.astype(np.int64), np.arange(len(words))
        s = out.copy()
        rank, product = self.ranks(s[:, :-1].ravel(), s[:, 1:].ravel())
        rank, product = rank.reshape(len(s), -1), product.reshape(len(s), -1)
        cols = np.arange(s.shape[1])
        while len(s):
            j = rank.argmin(1)
            live = rank[np.arange(len(s)), j] < NONE
            if not live.all():
                out[rows[~live]] = s[~live]
                s, rank, product, rows, j = s[live], rank[live], product[live], rows[live], j[live]
                if not len(s):
                    break
            i = np.arange(len(s))
            s[i, j] = product[i, j]
            close = np.minimum(cols[None] + (cols[None] > j[:, None]), len(cols) - 1)  # column j + 1 goes
            s = np.take_along_axis(s, close, 1)
            s[:, -1] = -1
            close = np.minimum(cols[None, :-1] + (cols[None, :-1] > j[:, None]), len(cols) - 2)
            rank, product = np.take_along_axis(rank, close, 1), np.take_along_axis(product, close, 1)
            rank[:, -1] = NONE
            for k, ok in ((j, j < len(cols) - 1), (j - 1, j > 0)):  # the new token's pairs
                x, k = i[ok], k[ok]
                rank[x, k], product[x, k] = self.ranks(s[x, k], s[x, k + 1])
        return out


class Vocabulary:
    """A ``tokenizers`` BPE file: its rules, lookahead, splitting and decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        rules = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        bare = lambda t: t[:-len(self.suffix)] if self.suffix and t.endswith(self.suffix) and t != self.suffix else t
        self.lookahead = Lookahead(rules, {i: len(bare(t)) for t, i in self.vocab.items()}).size
        self.merges = Merges(rules)
        letter = {b: c for c, b in byte_letters().items()}
        missing = [b for b in range(256) if letter[b] not in self.vocab or letter[b] + self.suffix not in self.vocab]
        if missing:
            raise ValueError("the vocabulary must hold every byte")
        self.inner = np.array([self.vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[letter[b] + self.suffix] for b in range(256)], np.int64)
        self.to_bytes = {ord(c): b for c, b in byte_letters().items()}
        added = spec.get("added_tokens") or []
        self.by_chunk = by_chunk(spec)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that reach beyond their own characters are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        decoder = spec.get("decoder")
        if decoder is not None and decoder["type"] != "ByteLevel":
            raise ValueError("decoders other than byte level are not supported")
        self.byte_level = decoder is not None
        self.words = Pool(self._encode_words, CACHE_WORDS)
        self.chunks = Pool(self._encode_chunks, CACHE_WORDS)

    def clear(self) -> None:
        self.words.clear()
        self.chunks.clear()

    # -- splitting -----------------------------------------------------------------
    def _pieces(self, text: str) -> list[int | str]:
        """Ids of added tokens, and words, in their order."""
        out: list[int | str] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._split(text[at:m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if self.tok.normalizer and text:
            text = self.tok.normalizer.normalize_str(text)
        cut = self.tok.pre_tokenizer.pre_tokenize_str(text) if text else []
        return [w.translate(self.to_bytes).encode("latin-1").decode() for w, _ in cut if w]

    # -- encoding ------------------------------------------------------------------
    def _encode_words(self, words: list[int | str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (an integer is an added token's id)."""
        raw = [w.encode() if isinstance(w, str) else b"" for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        parts, number, owner = [], np.zeros(len(raw), np.int64), []
        for lo, hi in ((0, 1), (1, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, WIDE)):
            which = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(which), 50_000):
                at = which[k:k + 50_000]
                grid = np.full((len(at), hi + 1), -1, np.int64)
                flat = np.frombuffer(b"".join(raw[i] for i in at), np.uint8)
                grid[np.arange(hi + 1)[None] < size[at][:, None]] = self.inner[flat]
                grid[np.arange(len(at)), size[at] - 1] = self.last[flat[np.cumsum(size[at]) - 1]]
                done = self.merges.lock_step(grid)
                number[at] = (done >= 0).sum(1)
                parts.append(done[done >= 0])
                owner.append(at)
        for i in np.flatnonzero((size > WIDE) | (size == 0)):
            coder = Encoder(self)
            ids = [*coder.feed(raw[i]), *coder.end()] if size[i] else [words[i]]
            number[i] = len(ids)
            parts.append(np.array(ids, np.int64))
            owner.append(np.array([i]))
        # back to the order of the words
        owner_ = np.concatenate([np.zeros(0, np.int64), *owner])
        start = np.empty(len(raw), np.int64)
        start[owner_] = np.cumsum(number[owner_]) - number[owner_]
        return gathered(np.concatenate([np.zeros(0, np.int64), *parts]), start, number), number

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.words.gather_cut(split_chunks(chunks, self.special, self._pieces))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        if self.by_chunk:
            return text_ids(texts, self.chunks)
        # other files' words may hold line feeds: one text at a time
        got = [self.words.gather(self.words.places(self._pieces(t or "")))[0] for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)

    # -- decoding ------------------------------------------------------------------
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of every token in a row, with start and size by id; an id
        that is no token has none.  Without a decoder each ends with a space."""
        name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        part = [b""] * (max(name) + 2)
        for i, t in name.items():
            if not self.byte_level:
                part[i] = t.encode() + b" "
            elif all(ord(c) in self.to_bytes for c in t):
                part[i] = bytes(self.to_bytes[ord(c)] for c in t)
            else:
                part[i] = t.encode()
        size = np.fromiter(map(len, part), np.int64, len(part))
        return np.frombuffer(b"".join(part), np.uint8), np.cumsum(size) - size, size


class Encoder:
    """Streaming transducer for one word: feed its bytes in any portions; the
    tokens that can no longer change come out, the rest at the end.  Between
    calls it holds at most four times the lookahead."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, b""
        self.room = None if vocab.lookahead is None else 4 * vocab.lookahead + WIDE

    def feed(self, more: bytes) -> Iterator[int]:
        if self.room is None:  # no bound: the word is kept whole
            self.held += more
            return
        at = 0
        while at < len(more):
            take = self.room - len(self.held)
            self.held += more[at:at + take]
            at += take
            if len(self.held) >= self.room:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        # the last byte is not merged yet: it may turn out to end the word
        done, limit = 0, len(self.held) - 1 - self.vocab.lookahead
        for token, size in self.vocab.merges.merge(self.vocab.inner[np.frombuffer(self.held[:-1], np.uint8)].tolist()):
            if done + size > limit:
                break
            done += size
            yield token
        self.held = self.held[done:]

    def end(self) -> Iterator[int]:
        if self.held:
            b = np.frombuffer(self.held, np.uint8)
            symbols = self.vocab.inner[b].tolist()
            symbols[-1] = int(self.vocab.last[b[-1]])
            yield from (t for t, _ in self.vocab.merges.merge(symbols))
        self.held = b""


class Utf8:
    """State machine from bytes to text, in any portions.  A sequence that
    breaks off becomes one U+FFFD per maximal part, like the library's."""

    #: First byte -> number of further bytes, and the second byte's range; fixed values of UTF-8.
    LEAD = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, 0xE0: (2, 0xA0, 0xBF), **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}, 0xED: (2, 0x80, 0x9F),
            0xF0: (3, 0x90, 0xBF), **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}, 0xF4: (3, 0x80, 0x8F)}

    def __init__(self):
        self.held = b""      # a sequence that has begun
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, more: bytes) -> str:
        if not self.held:
            try:
                return more.decode()  # nothing begun and nothing broken
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for b in more:
            if self.need:
                if self.low <= b <= self.high:
                    self.held += bytes([b])
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held = b""
                    continue
                out.append("�")
                self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif b in self.LEAD:
                self.need, self.low, self.high = self.LEAD[b]
                self.held = bytes([b])
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        broken = "�" if self.held else ""
        self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
        return broken


class Decoder:
    """Streaming transducer from ids to text."""

    def __init__(self, vocab: Vocabulary):
        self.pool, self.start, self.size = vocab.pieces()
        self.byte_level = vocab.byte_level

    def parts(self, ids: np.ndarray) -> Iterator[str]:
        """Text of the ids, at most DECODE_TOKENS tokens at a time."""
        machine = Utf8()
        ids = np.minimum(ids.astype(np.int64), len(self.size) - 1)
        space = ""
        for k in range(0, len(ids), DECODE_TOKENS):
            some = ids[k:k + DECODE_TOKENS]
            text = machine.feed(gathered(self.pool, self.start[some], self.size[some]).tobytes())
            if not self.byte_level and text:  # spaces stand between tokens, not after the last
                text, space = space + text[:-1], " "
            yield text
        yield machine.end()


_VOCAB: dict[str, Vocabulary] = {}
_DECODER: dict[str, Decoder] = {}
holds("bpe_stream", _VOCAB, _DECODER)


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCAB:
        _VOCAB[path] = Vocabulary(path)
    return _VOCAB[path]


def _free(docs: DataFrame, name: str) -> None:
    if name in docs.columns:
        raise ValueError(f"column {name!r} is made here")


def encode(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``ids`` (array of int) of every row.

    A null or empty text has no ids.  Rows are independent: ties and repeated
    rows each give their own, null ids stay, an empty table gives an empty
    result, columns not kept are not read (a kept column named ``ids`` is an
    error).  A very long text is held once, with its ids; its long words
    stream through a buffer of constant size.
    """
    ship(docs.sparkSession)
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    _free(docs.select(*keep), "ids")

    def run(it):
        only("bpe_stream")
        vocab = vocabulary(tokenizer_path)
        for b in batches(it, STEP_BYTES, "__text"):
            ids, at = vocab.ids(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))],
                                             names=[*keep, "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, *, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The ``keep`` columns and ``decoded``: the text of each row's ids, added
    tokens included.  Null or no ids give an empty text; ids that are no token are passed over."""
    ship(encoded.sparkSession)
    source = encoded.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))
    _free(encoded.select(*keep), "decoded")

    def run(it):
        only("bpe_stream")
        if tokenizer_path not in _DECODER:
            _DECODER[tokenizer_path] = Decoder(vocabulary(tokenizer_path))
        coder = _DECODER[tokenizer_path]
        for b in it:
            ids = b.column(b.num_columns - 1)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            out = ["".join(coder.parts(flat[lo:hi])) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*keep, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, decoded string")

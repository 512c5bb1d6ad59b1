"""Token ids of whole texts from the distinct white-space chunks of a batch.

For vocabularies that drop white space and never join what it separates, a
text's ids are its chunks' ids one after the other.  Arrow splits a batch and
codes its distinct chunks; only chunks not met before are encoded; the ids of
all texts are then gathered from one flat pool.
"""
from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A file that drops white space and splits by this pattern; both fixed values, compared when a file is opened.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
         {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Characters (and the line feed) for which lower-casing and composition act on each alone; words of chunks with a line feed after each.
PLAIN = regex.compile(r"[\n\x21-\x7e¡-¬®-įı-ſ‐-‧€]*")
SPLIT = regex.compile(WORDS + r"|\n")


def by_chunk(spec: dict) -> bool:
    """Does a tokenizer file (as JSON) give a text's ids chunk by chunk?"""
    added = spec.get("added_tokens") or []
    return (spec.get("normalizer") or {}).get("normalizers") == NORMAL and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == STEPS and \
        not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added)


def split_chunks(chunks: list[str], special: regex.Pattern | None, other: Callable[[str], list]) -> list:
    """Words of white-space chunks, with a line feed after each chunk's.
    Plain chunks are split all at once; ``other`` splits those with other
    characters or an added token."""
    whole = "\n".join(chunks) + "\n"
    if PLAIN.fullmatch(whole) and not (special and special.search(whole)):
        return SPLIT.findall(whole.lower())
    odd = [not PLAIN.fullmatch(c) or bool(special and special.search(c)) for c in chunks]
    plain, cut = iter(SPLIT.findall("".join([c + "\n" for c, o in zip(chunks, odd) if not o]).lower())), []
    for c, o in zip(chunks, odd):
        if o:
            cut += [*other(c), "\n"]
        else:
            for w in plain:
                cut.append(w)
                if w == "\n":
                    break
    return cut


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pool's stretches ``start`` to ``start + size``, one after the other."""
    shift = start - (np.cumsum(size) - size)
    return pool[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Pool:
    """Ids of every key met, in one array.  ``encode`` gives the ids of new
    keys in a row and their number per key.  The pool starts anew, without
    effect on results, at the first call after it has outgrown ``most`` keys."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[Hashable, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, keys: Sequence) -> np.ndarray:
        """Place of each key; the places hold until the next call."""
        if len(self.known) > self.most or len(self.ids) > 8 * self.most:
            self.clear()
        known = self.known
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            flat, size = self.encode(new)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, flat.astype(np.uint32, copy=False))
            known.update(zip(new, range(len(known), len(known) + len(new))))
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these places in a row, and their number per place."""
        size = self.size[places]
        return gathered(self.ids, self.start[places], size), size


    def gather_cut(self, cut: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``split_chunks`` in a row, and their number per chunk."""
        end = np.fromiter((w == "\n" for w in cut), bool, len(cut))
        ids, size = self.gather(self.places([w for w in cut if w != "\n"]))
        whole = np.zeros(len(cut), np.int64)
        whole[~end] = size
        return ids, np.diff(np.cumsum(whole)[end], prepend=0)


def text_ids(texts: pa.Array, pool: Pool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin (one entry more
    than texts); a null text counts as empty."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = parts.flatten().dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    flat, size = pool.gather(pool.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
    return flat, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]

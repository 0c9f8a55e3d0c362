"""Splitting text into the words of a byte-level tokenizer, vectorised over whole chunks.

The splitting rule is that of the public byte-level pattern: contractions, runs of letters, of digits or of other signs
with one leading space, and white space, whose last character before a word stands apart. Which class a character is in
is asked of the tokenizer's own pre-tokenizer, once for each character that occurs.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from . import _text as T

SPACE, LETTER, DIGIT, SIGN, UNKNOWN = 0, 1, 2, 3, 255


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def description(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=1)
def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next of U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(extra)
            extra += 1
    return [signs[b] for b in range(256)]


class Splitter:
    def __init__(self, path: str):
        self.pre = library(path).pre_tokenizer
        self.special = {t["content"].encode(): t["id"] for t in description(path)["added_tokens"]}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _classify(self, char: str) -> int:
        for sign, kind in (("a", LETTER), ("0", DIGIT), ("!", SIGN)):
            if len(self.pre.pre_tokenize_str(sign + char)) == 1:
                return kind
        return SPACE

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Byte positions at which words begin; words tile the chunk and don't cross documents."""
        if not len(data):
            return np.zeros(0, np.int64)
        raw = data.tobytes()
        bounds, inner = offs, []
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                # only where it lies in one document
                if np.searchsorted(offs, at, "right") == np.searchsorted(offs, at + len(text) - 1, "right"):
                    inner.append((at, at + len(text)))
                at = raw.find(text, at + len(text))
        if inner:
            bounds = np.unique(np.concatenate([offs, np.array(inner).ravel()]))
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[cp]
        if (kind == UNKNOWN).any():
            for c in np.unique(cp[kind == UNKNOWN]):
                self.classes[c] = self._classify(chr(c))
            kind = self.classes[cp]
        n = len(cp)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(place, bounds)] = True
        edge[n] = True
        change = edge.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        start = change[:n].copy()
        space = kind == SPACE
        # the last white space before a word begins a token of its own, or leads the word if it is a plain space
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
        start[last] = True
        lead = last[cp[last] == 0x20]
        start[lead + 1] = False
        # contractions
        quote = np.flatnonzero((cp[:-1] == 0x27) & (kind[1:] == LETTER) & start[:-1] & ~edge[1:n])
        if len(quote):
            one, two = cp[quote + 1], cp[np.minimum(quote + 2, n - 1)]
            whole = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
            short = np.isin(one, [115, 116, 109, 100])
            long = whole & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
            size = np.where(short, 2, np.where(long, 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            after = quote + size
            inside = after < n
            start[after[inside]] = True
        for a, b in inner:
            start[np.searchsorted(place, a) + 1 : np.searchsorted(place, b)] = False
        return place[start]


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at begins, end to end."""
    total = np.cumsum(sizes)
    return flat[np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]


class LibraryWords:
    """Ids of words by the tokenizers library, many words to a call: parted by line ends, which are tokens of their own."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8") for w in words]
        alone = np.fromiter((t.isspace() or "\n" in t for t in texts), bool, len(texts))
        parts = [t for t, single in zip(texts, alone.tolist()) if not single]
        ids = np.array(self.tokenizer.encode("\n".join(parts), add_special_tokens=False).ids, np.uint32)
        cut = np.flatnonzero(ids == self.line)
        if len(cut) != max(len(parts) - 1, 0):  # a word with a line end inside: not with this splitting
            alone[:] = True
        rest = [e.ids for e in self.tokenizer.encode_batch([t for t, single in zip(texts, alone.tolist()) if single], add_special_tokens=False)]
        sizes, begins = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if not alone.all():
            begins[~alone] = np.concatenate([[0], cut + 1])
            sizes[~alone] = np.concatenate([cut, [len(ids)]]) - begins[~alone]
        sizes[alone] = [len(x) for x in rest]
        begins[alone] = len(ids) + np.cumsum(sizes[alone]) - sizes[alone]
        flat = np.concatenate([ids, *[np.array(x, np.uint32) for x in rest]])
        return gather(flat, begins, sizes), sizes


class WordCoder:
    """Ids of whole texts by way of their distinct words, which are encoded once and kept in a bounded table.

    `encode` takes a list of words and returns (all their ids end to end, number of ids of each).
    """

    def __init__(self, path: str, encode, most: int = 600_000):
        self.split, self.encode, self.most = Splitter(path), encode, most
        self._clear()

    def _clear(self):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lengths, self.begins, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunk, number of ids before each document and in all)."""
        starts = self.split(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = T.span_hashes(data, starts, ends, lower=False)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            made, sizes = self.encode([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            where = np.arange(len(self.lengths), len(self.lengths) + len(new))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.ids = np.concatenate([self.ids, made])
            self.keys, self.slot = np.insert(self.keys, at[new], keys[new]), np.insert(self.slot, at[new], where)
            at = np.searchsorted(self.keys, keys)
        slot = self.slot[at][inverse]
        sizes = self.lengths[slot]
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.begins[slot] - (total - sizes), sizes) + np.arange(total[-1])]
        counted = np.concatenate([[0], total])
        return ids, counted[np.searchsorted(starts, offs)]

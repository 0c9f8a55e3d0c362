"""Byte-pair encoding and decoding by a deterministic automaton over tokens (operator 9).

The automaton begins with one state and a loop for every byte: it accepts all byte sequences. Each merge a+b -> ab, in the
order of the vocabulary, is one gadget: the state after `a` is copied (if others share it), the copy gives up its arc `b`,
and every state with an arc `a` gets an arc `ab` that leads where `b` led. In the end exactly the sequences that the merges
produce are accepted, so each prefix of a word has one accepted segmentation. The arcs into a state depend on the token
alone, so the table holds a state for each token and one bit for each (token, state): whether the arc is there.

A word is encoded by walking a byte trie of the labels from each of its bytes and running the automaton over the arcs
that this gives, by end position, for all distinct words of a batch at once. Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text as T
from ._pretoken import WordCoder, byte_signs, description, gather, vocabulary_path
from ._shared import texts


class MergeAutomaton:
    """Compiled from a byte-level BPE description (ids of byte signs, merges in order, added tokens)."""

    def __init__(self, path: str):
        made = description(path)
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        code = {sign: b for b, sign in enumerate(byte_signs())}
        self.special = {t["content"].encode(): t["id"] for t in made["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.labels[i] = bytes(code[c] for c in text)
        for text, i in self.special.items():
            self.labels[i] = text
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self._compile(size, [vocab[s] for s in byte_signs()], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self._trie()
        description.cache_clear()

    def _compile(self, size: int, single: list[int], merges: list[tuple[int, int, int]]) -> None:
        # the number of states follows from who shares a state; with it the table is made once, at its final size
        state, sharing = np.zeros(size, np.int32), [len(single) + 1]  # the entry shares state 0
        for a, b, ab in merges:
            old = state[b]
            if sharing[state[a]] > 1 or a == b:
                sharing[state[a]] -= 1
                sharing.append(1)
                state[a] = len(sharing) - 1
            state[ab] = old
            sharing[old] += 1
        arcs = np.zeros((size, (len(sharing) + 7) // 8), np.uint8)  # bit s of row t: state s has an arc t
        state, sharing, states = np.zeros(size, np.int32), [len(single) + 1], 1
        arcs[single, 0] = 1
        for a, b, ab in merges:
            q, old = state[a], state[b]
            if sharing[q] > 1 or a == b:  # for a+a, `old` must keep its arc a: it is where aa leads
                has = (arcs[:ab, q >> 3] >> np.uint8(q & 7)) & np.uint8(1)
                arcs[:ab, states >> 3] |= has << np.uint8(states & 7)
                sharing[q] -= 1
                sharing.append(1)
                q = state[a] = states
                states += 1
            arcs[b, q >> 3] &= np.uint8(255 ^ (1 << (q & 7)))
            arcs[ab] = arcs[a]
            state[ab] = old
            sharing[old] += 1
        # tokens that may stand after the same states share a row
        rows: dict[bytes, int] = {}
        self.row = np.array([rows.setdefault(r.tobytes(), len(rows)) for r in arcs], np.int32)
        self.arcs = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        self.state, self.states = state, states

    def _trie(self) -> None:
        """The byte trie of the labels: nodes of several children, with a row each in the table, then those of one, then leaves."""
        children, token = [{}], [-1]
        for i, label in enumerate(self.labels):
            if not label or label in self.special:
                continue
            at = 0
            for byte in label:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    token.append(-1)
                at = children[at][byte]
            token[at] = i
        order = sorted(range(len(children)), key=lambda k: -min(len(children[k]), 2))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.wide = sum(len(c) > 1 for c in children)
        self.inner = sum(map(bool, children))
        self.next = np.zeros((self.wide, 256), np.int32)
        self.only = np.zeros((2, self.inner), np.int32)  # byte and child of nodes with one child
        for k in order[: self.inner]:
            for byte, to in children[k].items():
                if place[k] < self.wide:
                    self.next[place[k], byte] = place[to]
                else:
                    self.only[:, place[k]] = byte, place[to]
        self.token = np.array([token[k] for k in order], np.int32)
        self.sizes = np.fromiter(map(len, self.labels), np.int64, len(self.labels))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words end to end, number of ids of each)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        special = np.fromiter((w in self.special for w in words), bool, len(words))
        sizes, begins, flat, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)], 0
        # words of like length together, so that short ones don't wait for a long one
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.searchsorted(lengths[order], [17, 65, 1025])):
            group = group[~special[group] & (lengths[group] > 0)]
            for k in range(0, len(group), 50_000):
                part = group[k : k + 50_000]
                ids, sizes[part] = self._run([words[i] for i in part.tolist()])
                begins[part] = n + np.cumsum(sizes[part]) - sizes[part]
                flat.append(ids)
                n += len(ids)
        for i in np.flatnonzero(special).tolist():
            flat.append(np.array([self.special[words[i]]], np.uint32))
            begins[i], sizes[i] = n, 1
            n += 1
        return gather(np.concatenate(flat), begins, sizes), sizes

    def _run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        # cells: one before each word, and one after each byte; a cell holds the token that leads to it
        word = np.repeat(np.arange(len(words)), lengths)
        cell = np.arange(len(data)) + word  # before the byte
        limit = ends[word] - np.arange(len(data))  # bytes from here to the word's end
        node, live, depth = np.zeros(len(data), np.int32), np.arange(len(data)), 0
        at, tokens, target = [], [], []
        while len(live):
            byte, few = data[live + depth], node >= self.wide
            to = np.where(self.only[0, node] == byte, self.only[1, node], 0)
            to[~few] = self.next[node[~few], byte[~few]]
            node = to
            depth += 1
            going = node > 0
            live, node = live[going], node[going]
            found = self.token[node] >= 0
            at.append(cell[live[found]])
            tokens.append(self.token[node[found]])
            target.append(cell[live[found]] + depth)
            more = (limit[live] > depth) & (node < self.inner)
            live, node = live[more], node[more]
        at, tokens, target = np.concatenate(at), np.concatenate(tokens), np.concatenate(target)
        first = ends - lengths + np.arange(len(words))  # each word's first cell
        step = target - first[np.searchsorted(first, target, "right") - 1]  # end position in the word
        order = np.argsort(step, kind="stable")
        at, tokens, target, step = at[order], tokens[order], target[order], step[order]
        state = np.full(len(data) + len(words), -1, np.int32)
        token = np.full(len(data) + len(words), -1, np.int32)
        state[first] = 0
        bounds = np.searchsorted(step, np.arange(1, (lengths.max() if len(lengths) else 0) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, t = state[at[a:b]], tokens[a:b]
            ok = (s >= 0) & (((self.arcs[self.row[t], s >> 3] >> (s & 7).astype(np.uint8)) & 1) == 1)
            token[target[a:b][ok]] = t[ok]
            state[target[a:b][ok]] = self.state[t[ok]]
        # back along the accepted arcs
        spot, alive, back = first + lengths, np.arange(len(words)), []
        while len(alive):
            t = token[spot[alive]]
            back.append((alive, t))
            spot[alive] -= self.sizes[t]
            alive = alive[spot[alive] > first[alive]]
        w, t = np.concatenate([x[0] for x in back]), np.concatenate([x[1] for x in back])
        round_ = np.repeat(np.arange(len(back)), [len(x[0]) for x in back])
        order = np.lexsort((-round_, w))
        return t[order].astype(np.uint32), np.bincount(w, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, end to end, as bytes."""
        if not hasattr(self, "flat"):
            self.flat = np.frombuffer(b"".join(self.labels), np.uint8)
            self.flat_at = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        if not len(total):
            return b""
        return self.flat[np.repeat(self.flat_at[ids] - (total - sizes), sizes) + np.arange(total[-1])].tobytes()


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(path)


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    return WordCoder(path, automaton(path).encode_words)


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded text, and digests.

    A null text is an empty one: no ids, and an empty decoded text. Bytes that don't form UTF-8 decode to U+FFFD, as the
    library does. Repeated rows give repeated rows, and equal texts equal ids; rows of one doc_id are each encoded by their own
    text; rows without an id are left out. A text of any length is encoded whole. Other columns, whatever their names, are not
    read. An empty table gives an empty result. `with_ids` False leaves out ids and the decoded text.
    """
    path = path or vocabulary_path()
    kept = [("ids", pa.binary()), ("decoded", pa.string())] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *kept, ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        coder, machine = _coder(path), automaton(path)
        decimal = [b"%d" % i for i in range(len(machine.labels))]
        for batch in batches:
            for a, b, data, offs in T.chunks(batch.column(1)):
                ids, at = coder(data, offs)
                rows = [[], [], [], []]
                for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = ids[x:y]
                    back = machine.decode(own).decode("utf-8", "replace").encode("utf-8")
                    rows[2].append(hashlib.sha256(b",".join([decimal[i] for i in own.tolist()])).hexdigest())
                    rows[3].append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        rows[0].append(own.astype("<u4").tobytes())
                        rows[1].append(back.decode("utf-8"))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(at))]
                columns += [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())], schema=schema)
        T.trim()

    ddl = "doc_id long, n_tokens long, " + ("ids binary, decoded string, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(run, ddl)


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents by the public byte-level vocabulary of 50,000 merges."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)

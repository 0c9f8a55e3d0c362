"""Log-bilinear language-model scoring (operator 8).

The vocabulary has the most frequent words of the learning documents, the end of a text, and classes of all other words (by
their last two bytes); it grows with the cube root of what there is to learn from (`vocabulary_for`). A text is scored as the sum of
the log-probabilities of its symbols given the two before, plus, for a word of a class, that of the word among its class with
one count added; so probabilities of all tokens sum to one.

The model is log-bilinear: each context position has a matrix that maps the embedding of its symbol, their sum is the
predicted embedding, and a symbol's score is its product with the symbol's target embedding plus a bias. Symbols are dealt, by
descending frequency, to about as many groups as a group has members, the frequent ones to small groups; the model predicts
the group and then the symbol in it, each normalised by batched matrix products over all of its alternatives.

It is trained in numpy by noise-contrastive estimation of both predictions, with noise drawn anew for each example. A first
model comes from a bounded sample (`fit_rows`, `fit_bytes`). Every task then trains a copy of it on its learning documents (every
position of each, or every `stride`th) in the same pass that counts words, and the copies' changes are averaged
row by row, weighted by how often a copy has changed the row. So counts cover all learning documents, and what is gathered
from them grows with them. Documents are dealt to copies by a hash of their rows, and stand in its order; each copy trains in batches of
one size, whatever rows or chunks they come from, and held-out documents take no part. So a score depends on the tables alone, not on
how they are stored or dealt. The number of copies follows from the bytes to learn from and the size of the model.

Frequent words are summed within each task. All others are dealt by their hash, in blobs that name the documents of a
block (some ten thousand of a task) by number; what a part of the words tells of a block goes back to the block's other parts,
where each document's share is summed. So counts reach the documents without any table of the whole vocabulary in one place.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._shared import Stage, free_shuffles, lowest_hashes, parts_for, texts, total_bytes
from .langid import held_out

KINDS = 64  # classes that a key has bits for
CLASSES = 63
LEAST_WORDS, LEAST_BYTES = 4096, 10_000_000  # so many words of the vocabulary at so many bytes to learn from
WIDTH, NOISE, BATCH, RATE = 24, 4, 2048, 0.2
STRIDE = 1
#: Text that a copy of the model learns from, at least this and so many times the model's own bytes; examples that are shuffled at once.
COPY_BYTES, COPY_MODELS, BUFFER = 32 << 20, 16, 32 * BATCH
#: Words that a task adds up at once.
HELD_WORDS = 1 << 20
#: Documents of a part in which the names of blocks' documents travel.
BLOCK_DOCUMENTS = 2_000_000
_SLICE = 512  # rows of parameters, and four times as many words, that are summed in one task
_LOW = np.uint64((1 << 48) - 1)
_LN10 = np.log(10)


def vocabulary_for(volume: float) -> int:
    """Words of the vocabulary for so many bytes to learn from."""
    return max(256, round(LEAST_WORDS * (volume / LEAST_BYTES) ** (1 / 3)))


def chunk_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of words before each document): a key is a word's hash with its class in the low six bits."""
    starts, ends, doc = T.spans(T.NOT_SPACE[data], offs)
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    suffix = low[data[ends - 1]] + np.where(ends - starts > 1, low[data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64) * np.uint64(7)
    key = (T.span_hashes(data, starts, ends) & ~np.uint64(KINDS - 1)) | (suffix % np.uint64(CLASSES))
    return key, np.searchsorted(doc, np.arange(len(offs)), "left")


def row_keys(ids: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(ids.view(np.uint64)) + T.span_hashes(data, offs[:-1], offs[1:], lower=False)).view(np.int64)


def frequent_words(docs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts) of the most frequent words, most frequent first (least key of a tie), and the tokens of each class and all
    documents. Tasks add up their own words first. Rows of documents: (text).
    """

    def added(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64))]

    def rows_of(key, kind, n):
        return pa.RecordBatch.from_arrays([key, pa.array(kind), pa.array(n)], ["key", "kind", "n"])

    def run(batches):
        parts, size, kept, kinds, rows = [], 0, 0, np.zeros(KINDS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offs in T.chunks(batch.column(0)):
                key, n = np.unique(chunk_words(data, offs)[0], return_counts=True)
                kinds += np.bincount((key & np.uint64(KINDS - 1)).astype(np.int64), n, KINDS).astype(np.int64)
                parts.append((key, n))
                size += len(key)
                if size > 2 * kept + HELD_WORDS:
                    parts = added(parts)
                    size = kept = len(parts[0][0])
                    if kept > 2 * HELD_WORDS:
                        yield rows_of(pa.array(parts[0][0].view(np.int64)), np.full(kept, -1), parts[0][1])
                        parts, size, kept = [], 0, 0
            T.trim()
        for key, n in added(parts) if parts else []:
            yield rows_of(pa.array(key.view(np.int64)), np.full(len(key), -1), n)
        yield rows_of(pa.nulls(KINDS + 1, pa.int64()), np.arange(KINDS + 1), np.concatenate([kinds, [rows]]))

    found = docs.select("text").mapInArrow(run, "key long, kind long, n long").groupBy("key", "kind").agg(F.sum("n").alias("n")).orderBy(F.col("key").isNotNull(), F.desc("n"), "key").limit(KINDS + 1 + most).toPandas()
    kinds = np.zeros(KINDS + 1, np.int64)
    own = found["kind"].to_numpy(np.int64) >= 0
    kinds[found["kind"].to_numpy(np.int64)[own]] = found["n"].to_numpy(np.int64)[own]
    words = found[~own]
    return words["key"].to_numpy(np.int64).view(np.uint64), words["n"].to_numpy(np.int64), kinds


class Symbols:
    """Maps words to symbols: those of the vocabulary in order, then the end, then classes of the others."""

    def __init__(self, heavy: np.ndarray):
        self.order = np.argsort(heavy)
        self.keys = heavy[self.order]
        self.end = len(heavy)
        self.size = len(heavy) + 1 + CLASSES

    def __call__(self, key: np.ndarray) -> np.ndarray:
        other = self.end + 1 + (key & np.uint64(KINDS - 1)).astype(np.int64)
        if not self.end:
            return other
        at = np.minimum(np.searchsorted(self.keys, key), self.end - 1)
        return np.where(self.keys[at] == key, self.order[at], other)

    def contexts(self, symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(two before, one before, symbol, tokens before each document): every text begins after two ends and closes with one."""
        counts = np.diff(first)
        rows = len(counts)
        full = np.full(len(symbol) + rows, self.end)
        full[np.arange(len(symbol)) + np.repeat(np.arange(rows), counts)] = symbol
        begin = np.arange(rows) + first[:-1]  # first token of each document in full
        one, two = np.empty_like(full), np.empty_like(full)
        one[1:], two[2:] = full[:-1], full[:-2]
        one[begin] = self.end
        two[begin] = self.end
        two[begin[counts > 0] + 1] = self.end
        return two, one, full, np.append(begin, len(full))


class Groups(NamedTuple):
    """Symbols in descending order of frequency, in runs."""

    place: np.ndarray  # of each symbol
    group: np.ndarray  # of each place
    start: np.ndarray  # first place of each group, and the number of places
    share: np.ndarray  # frequency of each place

    @classmethod
    def of(cls, counts: np.ndarray) -> Groups:
        """Groups of equal sums of the square roots of frequencies: frequent symbols stand in small ones."""
        share = (counts + 1.0) / (counts + 1.0).sum()
        order = np.argsort(-share, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root = np.sqrt(share[order])
        groups = max(1, round(0.75 * np.sqrt(len(order))))
        group = np.minimum(((np.cumsum(root) - root / 2) * groups / root.sum()).astype(np.int64), groups - 1)
        group = np.unique(group, return_inverse=True)[1]
        return cls(place, group, np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(order)), share[order])

    @property
    def mass(self) -> np.ndarray:
        return np.add.reduceat(self.share, self.start[:-1])


class Draws:
    """np.searchsorted(ends, x, "right") for many x from 0 to about one: a table says where to begin."""

    def __init__(self, ends: np.ndarray):
        self.cells = 1 << max(10, int(4 * len(ends)).bit_length())
        self.ends = np.append(ends, np.inf)
        self.begin = np.searchsorted(ends, np.arange(self.cells + 2) / self.cells, "right")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        flat = x.ravel()
        found = self.begin[(flat * self.cells).astype(np.int64)]
        short = np.flatnonzero(self.ends[found] <= flat)
        while len(short):
            found[short] += 1
            short = short[self.ends[found[short]] <= flat[short]]
        return found.reshape(x.shape)


class LogBilinear:
    """Scores (A r_v + B r_u) . q + b of the groups and, within a group, of its places, for the places v and u before.

    All parameters are rows of one table: r of each place, q and bias of each place, q and bias of each group, A, B.
    """

    def __init__(self, groups: Groups, width: int = WIDTH, seed: int = 11):
        self.groups, self.width = groups, width
        s, g = len(groups.group), len(groups.start) - 1
        self.at = np.cumsum([0, s, s, g, width, width])
        rng = np.random.default_rng(seed)
        table = np.zeros((self.at[-1], width + 1), np.float32)
        table[: self.at[3], :width] = rng.normal(0, 0.1, (self.at[3], width))
        table[self.at[3] : self.at[4], :width] = table[self.at[4] :, :width] = np.eye(width)
        mass = groups.mass
        table[s : 2 * s, width] = np.log(groups.share / mass[groups.group])
        table[2 * s : self.at[3], width] = np.log(mass)
        self.table, self.memory = table, np.full(len(table), 1e-4, np.float32)
        self.changes = np.zeros(len(table), np.float32)
        self.draws = None  # made where the model is trained

    def train(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """Steps of noise-contrastive estimation over the examples, each with noise of its own."""
        d, at, groups = self.width, self.at, self.groups
        mass, ends = groups.mass, np.cumsum(groups.share)
        wide, begins = np.cumsum(mass), ends - groups.share
        size = np.diff(groups.start)
        log_mass = np.log(mass * NOISE).astype(np.float32)
        log_share = np.log(groups.share / mass[groups.group] * NOISE).astype(np.float32)
        self.draws = self.draws or (Draws(wide), Draws(ends))
        of_mass, of_share = self.draws
        place, held = np.empty(at[2], np.int64), np.zeros((d + 1, NOISE + 3, min(BATCH, len(w))), np.float32)
        for a in range(0, len(w), BATCH):
            x, y, z = u[a : a + BATCH], v[a : a + BATCH], w[a : a + BATCH]
            n = len(z)
            own = groups.group[z]
            bad_g = np.minimum(of_mass(rng.random((n, NOISE)) * wide[-1]), len(mass) - 1)
            low = begins[groups.start[own]][:, None]
            bad_w = of_share(low + rng.random((n, NOISE)) * mass[own][:, None])
            bad_w = np.clip(bad_w, groups.start[own][:, None], groups.start[own + 1][:, None] - 1)
            g, p = np.column_stack([own, bad_g]), np.column_stack([z, bad_w])
            near, far = self.table[at[3] : at[4], :d], self.table[at[4] :, :d]
            rv, ru = (self.table.take(k, axis=0)[:, :d] for k in (y, x))
            hat = rv @ near + ru @ far
            # groups are few: products with all of them, of which the drawn ones count
            of_groups, cell = self.table[at[2] : at[3]], np.arange(0, n * len(mass), len(mass))[:, None] + g
            score = (hat @ of_groups[:, :d].T + of_groups[:, d]).ravel()[cell] - log_mass[g]
            q = self.table.take(at[1] + p, axis=0)
            score = np.hstack([score, (q[:, :, :d] @ hat[:, :, None])[:, :, 0] + q[:, :, d] - log_share[p]])
            grad = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            grad[:, [0, NOISE + 1]] -= 1
            grad[:, NOISE + 1 :] *= (size[own] > 1)[:, None]
            grad_w = grad[:, NOISE + 1 :]
            grad_g = np.bincount(cell.ravel(), grad[:, : NOISE + 1].ravel(), n * len(mass)).reshape(n, -1).astype(np.float32)
            d_hat = grad_g @ of_groups[:, :d] + np.einsum("nk,nkd->nd", grad_w, q[:, :, :d])
            total = np.column_stack([grad_g.T @ hat, grad_g.sum(axis=0)])
            times = np.bincount(g.ravel(), minlength=len(mass))
            drawn = np.flatnonzero(times)
            # of both context places and of the words: summed by row, a column at a time
            part = held if n == held.shape[2] else np.zeros((d + 1, NOISE + 3, n), np.float32)
            part[:d, 0], part[:d, 1] = near @ d_hat.T, far @ d_hat.T
            part[d, 2:] = grad_w.T
            np.multiply(np.ascontiguousarray(hat.T)[:, None, :], part[d, 2:], out=part[:d, 2:])
            row = np.concatenate([y, x, (at[1] + p).T.ravel()])
            seen = np.zeros(at[2], bool)
            seen[row] = True
            rows = np.flatnonzero(seen)
            place[rows] = np.arange(len(rows))
            row = place[row]
            summed = np.empty((len(rows), d + 1), np.float32)
            for k in range(d + 1):
                summed[:, k] = np.bincount(row, part[k].ravel(), len(rows))
            self._step(rows, summed, np.bincount(row, minlength=len(rows)), rate)
            self._step(at[2] + drawn, total[drawn], times[drawn], rate)
            for k, r in ((3, rv), (4, ru)):
                square = np.zeros((d, d + 1), np.float32)
                square[:, :d] = r.T @ d_hat
                self._step(np.arange(at[k], at[k + 1]), square, np.full(d, n), rate / 4)

    def _step(self, rows, total, times, rate):
        mean = total / np.sqrt(times, dtype=np.float32)[:, None]
        self.memory[rows] += np.einsum("nd,nd->n", mean, mean) / mean.shape[1]
        mean *= rate
        mean /= np.sqrt(self.memory[rows])[:, None]
        self.table[rows] = self.table.take(rows, axis=0) - mean
        self.changes[rows] += times

    def ready(self) -> Ready:
        d, at, t = self.width, self.at, self.table.astype(np.float64)
        one = np.ones((at[1], 1))
        near = np.hstack([t[: at[1], :d] @ t[at[3] : at[4], :d], one])
        far = np.hstack([t[: at[1], :d] @ t[at[4] :, :d], 0 * one])
        return Ready(self.groups, near, far, t[at[2] : at[3]], t[at[1] : at[2]])


class Ready(NamedTuple):
    """What scoring needs: mapped embeddings of both context places, and the targets of groups and places, with biases last."""

    groups: Groups
    near: np.ndarray
    far: np.ndarray
    of_groups: np.ndarray
    of_places: np.ndarray

    def log10(self, two: np.ndarray, one: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after the two before it; those that occur more than once are computed once, and so are
        the sums over all groups of a context."""
        groups, place, size = self.groups, self.groups.place, len(self.groups.place)
        context, of_context = np.unique(two.astype(np.int64) * size + one, return_inverse=True)
        found, back = np.unique(of_context * size + symbol, return_inverse=True)
        at, w = found // size, place[found % size]
        hat = self.near[place[context % size]] + self.far[place[context // size]]
        of_all = np.empty(len(context))
        for a in range(0, len(context), 8192):
            of_all[a : a + 8192] = _log_sum(hat[a : a + 8192] @ self.of_groups.T)
        own = groups.group[w]
        out = np.einsum("nd,nd->n", hat[at], self.of_groups[own]).astype(np.float64) - of_all[at]
        order = np.argsort(own.astype(np.uint16), kind="stable")
        edge = np.searchsorted(own[order], np.arange(len(groups.start)))
        for g in range(len(groups.start) - 1):
            a, b = groups.start[g], groups.start[g + 1]
            if b - a < 2:
                continue
            target = np.ascontiguousarray(self.of_places[a:b].T)
            for c in range(edge[g], edge[g + 1], 16384):
                rows = order[c : min(c + 16384, edge[g + 1])]
                score = hat[at[rows]] @ target
                out[rows] += score[np.arange(len(rows)), w[rows] - a]
                out[rows] -= _log_sum(score)
        return out[back] / _LN10


def _log_sum(score: np.ndarray) -> np.ndarray:
    top = score.max(axis=1, keepdims=True)
    np.subtract(score, top, out=score)
    return np.log(np.exp(score, out=score).sum(axis=1, dtype=np.float64)) + top[:, 0]


def _chunk_examples(symbols: Symbols, groups: Groups, two, one, full, at, keep, stride: int, offset: np.ndarray):
    """(u, v, w) as places: every stride-th token of the kept documents from the offset of each on."""
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(counts)), counts)
    picked = np.flatnonzero(keep[doc] & ((np.arange(len(full)) - at[doc] + offset[doc]) % stride == 0))
    return tuple(groups.place[x[picked]] for x in (two, one, full))


def first_model(symbols: Symbols, groups: Groups, column, steps: int | None = None, seed: int = 5) -> LogBilinear:
    """A model of all tokens of some texts, read twice; `steps` batches at most."""
    net, rng = LogBilinear(groups), np.random.default_rng(seed)
    parts = []
    for a, b, data, offs in T.chunks(column):
        key, first = chunk_words(data, offs)
        two, one, full, at = symbols.contexts(symbols(key), first)
        parts.append(_chunk_examples(symbols, groups, two, one, full, at, np.ones(b - a, bool), 1, np.zeros(b - a, np.int64)))
    if parts:
        u, v, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
        for epoch in range(2):
            order = rng.permutation(len(w))[: None if steps is None else max(1, steps // 2) * BATCH]
            net.train(u[order], v[order], w[order], rng, RATE / (1 + epoch))
    net.draws = None
    return net


def _emit_counts(sent, parts, batches):
    """Blobs of (word, document, count) by part; in further parts what the task has summed of frequent words and of its copy of the model."""
    heavy, net, stride, block_parts = sent.value
    symbols = Symbols(heavy)
    first_table = net.table
    net = _copy(net)
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    rng = np.random.default_rng([13, task])
    bits = parts.bit_length() - 1
    last_part = _parts_of(parts, len(heavy), len(net.table), block_parts)[2]
    examples = [np.zeros(0, np.int64)] * 3
    counts, docs = np.zeros(len(heavy), np.int64), 0
    held, size, block = [], 0, task << 24
    names = ["part", "blob"]

    def flush():
        nonlocal block
        key, doc, n = (np.concatenate([x[k] for x in held]) for k in range(3))
        train = np.concatenate([x[4] for x in held])
        # the rows of the block
        which, blobs = [last_part + task % block_parts], [np.int64(block).tobytes() + np.concatenate([x[3] for x in held]).tobytes()]
        order = np.argsort(key, kind="stable")
        key, doc, n = key[order], doc[order], n[order]
        at = np.searchsorted(key >> np.uint64(64 - bits), np.arange(parts + 1, dtype=np.uint64))
        low = np.ascontiguousarray((key & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        learnt = np.packbits(train).tobytes()
        for p in range(parts):
            a, b = at[p], at[p + 1]
            if a < b:
                few = n[a:b].max() < 256
                head = np.array([block, b - a, len(learnt), few], np.int64).tobytes()
                blobs.append(b"".join([head, learnt, low[a:b].tobytes(), doc[a:b].astype(np.uint16).tobytes(), n[a:b].astype(np.uint8 if few else np.uint32).tobytes()]))
                which.append(p)
        block += 1
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], names)

    n_held = 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offs in T.chunks(batch.column(1)):
            key, first = chunk_words(data, offs)
            train = ~batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
            symbol = symbols(key)
            doc = np.repeat(np.arange(b - a), np.diff(first))
            rare = symbol > symbols.end
            docs += int(train.sum())
            counts += np.bincount(symbol[~rare & train[doc]], minlength=len(heavy))[: len(heavy)]
            row = row_keys(ids[a:b], data, offs)
            two, one, full, at = symbols.contexts(symbol, first)
            u, v, w = _chunk_examples(symbols, net.groups, two, one, full, at, train, stride, (row.view(np.uint64) % np.uint64(stride)).astype(np.int64))
            examples = [np.concatenate(x) for x in zip(examples, (u, v, w))]
            while len(examples[0]) >= BUFFER:
                order = rng.permutation(BUFFER)
                net.train(*(x[:BUFFER][order] for x in examples), rng, RATE / 2)
                examples = [x[BUFFER:] for x in examples]
            order = np.lexsort((key[rare], doc[rare]))
            k, d = key[rare][order], doc[rare][order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, np.int64)
            if n_held + (b - a) > 60_000 and held:
                yield flush()
                held, size, n_held = [], 0, 0
                T.trim()
            held.append((k[new], d[new] + n_held, np.diff(np.append(new, len(k))), row, train))
            n_held += b - a
            size += len(new)
            if size > 1_000_000:
                yield flush()
                held, size, n_held = [], 0, 0
                T.trim()
    if held:
        yield flush()
    order = rng.permutation(len(examples[0]))
    net.train(*(x[order] for x in examples), rng, RATE / 2)
    press = zstandard.ZstdCompressor(level=1)
    sums = [press.compress(np.append(docs if k == 0 else 0, counts[k : k + 4 * _SLICE]).tobytes()) for k in range(0, max(1, len(counts)), 4 * _SLICE)]
    slices = len(sums)
    which = list(range(parts, parts + slices))
    for k in range(0, len(net.table), _SLICE):
        rows = k + np.flatnonzero(net.changes[k : k + _SLICE])
        if len(rows):
            change = (net.table[rows] - first_table[rows]).astype(np.float32)
            sums.append(np.int64(task).tobytes() + (rows - k).astype(np.int64).tobytes() + net.changes[rows].tobytes() + change.tobytes())
            which.append(parts + slices + k // _SLICE)
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(sums, pa.binary())], names)


def _parts_of(parts: int, words: int, rows: int, block_parts: int) -> tuple[int, int, int, int]:
    """Where parts of words end, then slices of frequent words, slices of parameters, and blocks of documents."""
    slices = parts + len(range(0, max(1, words), 4 * _SLICE))
    table = slices + -(-rows // _SLICE)
    return parts, slices, table, table + block_parts


def _copy(net: LogBilinear) -> LogBilinear:
    new = object.__new__(LogBilinear)
    new.__dict__ |= net.__dict__ | {"table": net.table.copy(), "memory": net.memory.copy(), "changes": np.zeros_like(net.changes)}
    return new


def _read(buffer):
    raw = np.frombuffer(buffer, np.uint8)
    block, n, learnt, few = raw[:32].view(np.int64).tolist()
    a = 32
    train, a = np.unpackbits(raw[a : a + learnt]).view(bool), a + learnt
    key = np.zeros((n, 8), np.uint8)
    key[:, :6], a = raw[a : a + 6 * n].reshape(-1, 6), a + 6 * n
    local, a = raw[a : a + 2 * n].copy().view(np.uint16), a + 2 * n
    return key.view(np.uint64).ravel(), block, train, local, raw[a:].astype(np.int64) if few else raw[a:].copy().view(np.uint32).astype(np.int64)


def _mean_change(width: int, blobs) -> bytes:
    """Of a slice of parameter rows the copies' changes, averaged by how often each copy has changed a row; in the order of tasks."""
    total, times = np.zeros((_SLICE, width + 1)), np.zeros(_SLICE)
    for raw in sorted((x.as_buffer().to_pybytes() for x in blobs), key=lambda x: int.from_bytes(x[:8], "little")):
        n = (len(raw) - 8) // (8 + 4 + 4 * (width + 1))
        rows = np.frombuffer(raw, np.int64, n, 8)
        weight = np.frombuffer(raw, np.float32, n, 8 + 8 * n)
        change = np.frombuffer(raw, np.float32, n * (width + 1), 8 + 12 * n).reshape(n, -1)
        total[rows] += weight[:, None] * change
        times[rows] += weight
    return (total / np.maximum(times, 1)[:, None]).astype(np.float32).tobytes()


_REDUCED = "part int, block long, shares binary"


def _reduce(ends: tuple[int, int, int, int], width: int, table: pa.Table) -> pa.Table:
    """Of a part of words: for each block the shares (documents, known words, sum of logarithms); its sums without a block."""
    part = table.column("part")[0].as_py()
    blobs = table.column("blob")
    block, shares = [], []
    if part >= ends[2]:
        raw = [x.as_buffer().to_pybytes() for x in blobs]
        return pa.table({"part": pa.array([part] * len(raw), pa.int32()), "block": pa.array([int.from_bytes(x[:8], "little") for x in raw], pa.int64()), "shares": pa.array([x[8:] for x in raw], pa.binary())})
    if part >= ends[1]:
        note = _mean_change(width, blobs)
    elif part >= ends[0]:
        expand = zstandard.ZstdDecompressor()
        note = sum(np.frombuffer(expand.decompress(x.as_py()), np.int64) for x in blobs).tobytes()
    else:
        read = [_read(x.as_buffer()) for x in blobs]
        key = np.concatenate([r[0] for r in read])
        words, inverse = np.unique(key, return_inverse=True)
        n = np.concatenate([np.where(r[2][r[3]], r[4], 0) for r in read])
        c = np.bincount(inverse, n, len(words)).astype(np.int64)
        kind = (words & np.uint64(KINDS - 1)).astype(np.int64)
        note = np.concatenate([np.bincount(kind, c, KINDS), np.bincount(kind[c > 0], minlength=KINDS)]).astype(np.int64).tobytes()
        log, a = np.log10(c + 1.0), 0
        for keys, own_block, _, local, times in read:
            own = inverse[a : a + len(keys)]
            a += len(keys)
            used, doc = np.unique(local, return_inverse=True)
            known = np.bincount(doc, np.where(c[own] > 0, times, 0)).astype(np.uint32)
            block.append(own_block)
            shares.append(used.astype(np.uint16).tobytes() + known.tobytes() + np.bincount(doc, times * log[own]).tobytes())
        del read, key, inverse
    T.trim()
    return pa.table({"part": pa.array([part] * (len(block) + 1), pa.int32()), "block": pa.array([*block, None], pa.int64()), "shares": pa.array([*shares, note], pa.binary())})


def _sum_shares(first_block_part: int, table: pa.Table) -> pa.Table:
    """(row, known, slog) of the documents of a block, in the order of parts."""
    part = table.column("part").to_numpy()
    order = np.argsort(part, kind="stable")
    shares = table.column("shares")
    row = np.frombuffer(shares[int(order[-1])].as_buffer(), np.int64)
    assert part[order[-1]] >= first_block_part
    known, slog = np.zeros(len(row), np.int64), np.zeros(len(row))
    for k in order[:-1].tolist():
        raw = shares[k].as_buffer().to_pybytes()
        n = len(raw) // 14
        doc = np.frombuffer(raw, np.uint16, n)
        known[doc] += np.frombuffer(raw, np.uint32, n, 2 * n)
        slog[doc] += np.frombuffer(raw, np.float64, n, 6 * n)
    return pa.table({"row": row, "known": known, "slog": slog})


class Model(NamedTuple):
    """Keys of the vocabulary, their counts and the end's, the symbols' model, and log10 of each class's share of one count."""

    heavy: np.ndarray
    counts: np.ndarray
    ends: int
    ready: Ready
    class_log: np.ndarray
    tokens: int
    distinct: int


def _score(model, batches):
    """(doc_id, held_out, row, n_tokens, known, slog, lm): what the text and the model give without the rare words' counts."""
    m = model.value
    symbols = Symbols(m.heavy)
    log, known = np.log10(np.append(m.counts, m.ends) + 1.0), np.append(m.counts, m.ends) > 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offs in T.chunks(batch.column(1)):
            key, first = chunk_words(data, offs)
            two, one, full, at = symbols.contexts(symbols(key), first)
            doc = np.repeat(np.arange(b - a), np.diff(at))
            rare = full > symbols.end
            lm = np.bincount(doc, m.ready.log10(two, one, full), b - a) + np.bincount(doc[rare], m.class_log[full[rare] - symbols.end - 1], b - a)
            often = full[~rare]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(row_keys(ids[a:b], data, offs)), pa.array(np.diff(at)), pa.array(np.bincount(doc[~rare], known[often], b - a).astype(np.int64)), pa.array(np.bincount(doc[~rare], log[often], b - a)), pa.array(lm)],
                ["doc_id", "held_out", "row", "n_tokens", "known", "slog", "lm"],
            )
        T.trim()


def learn(spark: SparkSession, docs: DataFrame, stage: Stage, fit_rows: int, fit_bytes: int, steps: int | None, stride: int = STRIDE) -> tuple[Model, DataFrame]:
    """The model of the rows (doc_id, text, held_out) that are not held out, and (row, known, slog) of all rows for their rare words."""
    learning = docs.where("NOT held_out")
    (rows, volume), (_, learnt) = total_bytes(docs), total_bytes(learning)
    heavy, rough, kinds = frequent_words(learning, vocabulary_for(learnt))
    free_shuffles(spark)
    symbols = Symbols(heavy)
    others = kinds[:CLASSES] - np.bincount((heavy & np.uint64(KINDS - 1)).astype(np.int64), rough, KINDS)[:CLASSES].astype(np.int64)
    groups = Groups.of(np.concatenate([rough, kinds[KINDS:], np.maximum(others, 0)]))
    sample = lowest_hashes(learning, fit_rows, fit_bytes, "text").select("text").toArrow().column("text")
    net = first_model(symbols, groups, sample, steps)
    parts, width, block_parts = parts_for(volume / 14, 2_500_000, 8), net.width, parts_for(rows, BLOCK_DOCUMENTS)
    sent = spark.sparkContext.broadcast((heavy, net, stride, block_parts))
    ends_of = _parts_of(parts, len(heavy), len(net.table), block_parts)
    copies = parts_for(learnt, max(COPY_BYTES, COPY_MODELS * net.table.nbytes), 8)
    dealt = docs.repartition(copies, "doc_id", "text").sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")
    emitted = dealt.mapInArrow(lambda it: _emit_counts(sent, parts, it), "part int, blob binary")
    # a task for each part, so that no two meet in one
    counted = stage.put(emitted.repartitionById(ends_of[3], F.col("part")).groupBy("part").applyInArrow(lambda t: _reduce(ends_of, width, t), _REDUCED), "counted")
    free_shuffles(spark)
    notes = {r["part"]: bytes(r["shares"]) for r in counted.where("block IS NULL").select("part", "shares").collect()}
    whole = [np.frombuffer(notes.pop(p), np.int64) for p in range(ends_of[0], ends_of[1]) if p in notes]
    counts, ends = np.concatenate([x[1:] for x in whole]) if whole else np.zeros(len(heavy), np.int64), int(sum(x[0] for x in whole))
    for p in sorted(p for p in notes if p >= ends_of[1]):
        a = (p - ends_of[1]) * _SLICE
        change = np.frombuffer(notes.pop(p), np.float32).reshape(_SLICE, -1)[: len(net.table) - a]
        net.table[a : a + _SLICE] += change
    rare = sum((np.frombuffer(x, np.int64) for x in notes.values()), np.zeros(2 * KINDS, np.int64))
    n, v = int(rare[:KINDS].sum() + counts.sum()) + ends, int(rare[KINDS:].sum() + (counts > 0).sum()) + (ends > 0)
    class_log = -np.log10(rare[:KINDS] + rare[KINDS:] + 1.0)[:CLASSES]
    sums = counted.where("block IS NOT NULL").groupBy("block").applyInArrow(lambda t: _sum_shares(ends_of[2], t), "row long, known long, slog double")
    return Model(heavy, counts, ends, net.ready(), class_log, n, v), sums


def score_documents(spark: SparkSession, docs: DataFrame, held=None, steps: int | None = None, fit_rows: int = 2000, fit_bytes: int = 1 << 22, stride: int = STRIDE, details: list | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that `held` (a column over doc_id) doesn't hold out. A null text is empty: its only token is the
    end. Repeated rows count each and give repeated, equal rows; rows of one doc_id with different texts are documents of their own; rows
    without an id are left out. A text of any length is read whole. Columns of other names, clashing ones too, are not read. An
    empty table gives an empty result. With nothing to learn from, all counts are zero and the symbols are equally likely. The
    first model is trained on fit_rows documents and fit_bytes bytes at most (lowest hashes of the ids), in `steps` batches or two
    readings; the copies train on every position of every learning document (`stride`: on every so many). Equal texts have equal
    scores, to six digits, whatever partitions the rows come in. The model is appended to `details`.
    """
    docs = texts(docs).withColumn("held_out", held if held is not None else held_out(modulus=7, remainder=2))
    stage = Stage(spark, "lm")
    model, rare = learn(spark, docs, stage, fit_rows, fit_bytes, steps, stride)
    if details is not None:
        details.append(model)
    sent = spark.sparkContext.broadcast(model)
    own = docs.mapInArrow(lambda it: _score(sent, it), "doc_id long, held_out boolean, row long, n_tokens long, known long, slog double, lm double")
    per = own.groupBy("row").agg(F.any_value(F.struct(*[c for c in own.columns if c != "row"])).alias("x"), F.count(F.lit(1)).alias("copies"))
    sums = rare.groupBy("row").agg(F.sum("known").alias("k"), F.sum("slog").alias("s"))
    k, s = F.coalesce((F.col("k") / F.col("copies")).cast("long"), F.lit(0)), F.coalesce(F.col("s") / F.col("copies"), F.lit(0.0))
    joined = per.join(sums, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(
        "x.doc_id",
        "x.held_out",
        "x.n_tokens",
        (F.col("x.known") + k).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("x.slog") + s - F.col("x.n_tokens") * float(np.log10(model.tokens + model.distinct + 1.0))).alias("base_score"),
        F.round(F.col("x.lm") + s, 6).alias("score"),
    )


def op8_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents; those whose crc32(doc_id) mod 7 is 2 are held out."""
    return score_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

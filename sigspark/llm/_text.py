"""Vectorised text kernels shared by the operators of this subpackage.

Every function works on one *chunk*: the UTF-8 bytes of some whole documents, laid end to end, and the offsets
that part them. A null text counts as an empty one. Nothing here depends on how documents are dealt over batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_codes(lower: bool) -> np.ndarray:
    """A fixed random 64-bit code for every byte value; A-Z share the codes of a-z if lower."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse for n positions."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHUNK_BYTES + 1 if base == _BASE else 1 << 16)
        size += size // 4
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 8 * CHUNK_BYTES:  # one very long text: don't keep its tables
            return tables[0], tables[1]
        _powers[base] = tables[0], tables[1]
    return _powers[base]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(n, _BASE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans get equal values wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(lower)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX_B)


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if len(offs) else data[:0], offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about limit bytes; a longer text makes one alone."""
    data, offs = text_arrays(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows, row + 65536)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end
    if len(data) > 8 * CHUNK_BYTES:
        trim()


def trim() -> None:
    """Gives freed memory, Arrow's included, back to the system: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _class(chars: str | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes of the words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z have become a-z.
ALNUM = _class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of member bytes that don't cross documents."""
    n = len(member)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    before[offs[:-1][offs[:-1] < n]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word in order, and the number of words before each document (and in all)."""
    starts, ends, doc = spans(member[data], offs)
    return span_hashes(data, starts, ends), np.searchsorted(doc, np.arange(len(offs)), "left")


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all runs of width words; a document of fewer words, but not none, gives its whole sequence."""
    counts = np.diff(first)
    n = len(words)
    out_doc, out_hash = [], []
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total += words[k : n - width + 1 + k] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        doc = np.repeat(np.arange(len(counts)), counts)
        whole = doc[: n - width + 1] == doc[width - 1 :]
        out_doc.append(doc[: n - width + 1][whole])
        out_hash.append(mix(total[whole]))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        values = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            value = np.uint64(counts[d])
            for w in words[first[d] : first[d + 1]]:
                value = _fold(value, w)
            values[i] = value
        out_doc.append(short)
        out_hash.append(values)
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_hash)


def _fold(value: np.uint64, word: np.uint64) -> np.uint64:
    return mix(np.array([(int(value) * 31 + int(word)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def unique_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, value) pairs, by document and then value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]

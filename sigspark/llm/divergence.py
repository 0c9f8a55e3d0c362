"""Source divergence audit by sketch-prefiltered counting (operator 11).

Terms are the letter runs of whole texts. A first pass counts in how many documents of a language each term stands, in a count-min
sketch for each task; the sketches are added. As a sketch never underestimates, a term whose estimate is below the least document
frequency cannot be kept, and the second pass drops it before anything is shuffled. What survives is counted exactly, by language,
source and term, and only terms that really reach the frequency are kept.

How far a source is from the others of its language is summed over all kept terms, though only terms that both sources have are
paired: the terms of one source alone count by a histogram of its counts, and terms of neither by their number.
All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from ._shared import Stage

#: Documents of its language that a term needs.
LEAST_DOCUMENTS = 3
#: Ranks of terms that a group lists.
TOP_TERMS = 200
#: Rows and cells of the sketch, one byte a cell: 24 MiB, which every task holds, whatever the input.
DEPTH, WIDTH = 3, 1 << 23
#: Parts of the sketch that are added apart.
SLICES = 96
#: Text that is counted at once.
CHUNK = 4 << 20
#: Pairs of sources that are computed at once.
BLOCK = 1 << 20
#: What shares are multiplied by.
UNIT = 1_000_000_000

_LETTER = T._class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(data: np.ndarray, offs: np.ndarray):
    """(document, code) of every term in order, and the distinct terms that the codes name."""
    starts, ends, doc = T.spans(_LETTER[data], offs)
    ends_of = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=ends_of[1:])
    names = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_of), pa.py_buffer(_LOWER[data[_LETTER[data]]])])
    coded = names.dictionary_encode()
    return doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _codes(column) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _hashes(names: pa.Array) -> np.ndarray:
    data, offs = T.text_arrays(names)
    return T.span_hashes(data, offs[:-1], offs[1:], lower=False)


def _cells(lang: np.ndarray, term: np.ndarray, width: int, depth: int) -> list[np.ndarray]:
    """The cell of each row of the sketch for a term in a language."""
    with np.errstate(over="ignore"):
        key = T.mix(term + T.mix(lang) * np.uint64(3))
        return [(T.mix(key + np.uint64(r + 1) * T._MIX_A) & np.uint64(width - 1)).astype(np.int64) for r in range(depth)]


def document_sketch(rows: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """A count-min sketch (depth, width) of the document frequencies of the terms in each language, from (lang, source, text).

    Cells stop at 255 and never underestimate what is below. Each of a few tasks a core sends its sketch in compressed slices, which are
    added slice by slice; the sum has a fixed size and goes to the driver.
    """
    slices = min(SLICES, width)

    def count(batches):
        sketch = np.zeros((depth, width), np.uint8)
        for batch in batches:
            lang, langs = _codes(batch.column(0))
            lang_hash = _hashes(langs)
            for a, _, data, offs in T.chunks(batch.column(2), CHUNK):
                doc, code, names = _terms(data, offs)
                if not len(doc):
                    continue
                once = np.unique(doc * len(names) + code)
                key, n = np.unique(lang[a + once // len(names)] * len(names) + once % len(names), return_counts=True)
                for row, cell in zip(sketch, _cells(lang_hash[key // len(names)], _hashes(names)[key % len(names)], width, depth)):
                    where, at = np.unique(cell, return_inverse=True)
                    row[where] = np.minimum(255, row[where] + np.bincount(at, n))
        packed = zstandard.ZstdCompressor(1)
        for k, part in enumerate(np.array_split(sketch, slices, axis=1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed.compress(part.tobytes())], pa.binary())], ["slice", "cells"])
        T.trim()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.uint8)
                total[k] = np.minimum(255, total[k].astype(np.uint16) + cells).astype(np.uint8) if k in total else cells
        for k, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["slice", "cells"])

    few = 3 * rows.sparkSession.sparkContext.defaultParallelism
    summed = rows.coalesce(few).mapInArrow(count, "slice int, cells binary").repartition(slices, "slice").mapInArrow(add, "slice int, cells binary")
    found = dict(summed.collect())  # at most depth * width bytes
    sizes = [p.shape[1] for p in np.array_split(np.empty((1, width), bool), slices, axis=1)]
    return np.concatenate([np.frombuffer(found[k], np.uint8).reshape(depth, n) if k in found else np.zeros((depth, n), np.uint8) for k, n in enumerate(sizes)], axis=1)


def surviving_counts(rows: DataFrame, sketch: np.ndarray, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, df) of the terms that the sketch doesn't rule out: occurrences and documents, summed within tasks first."""
    sent = rows.sparkSession.sparkContext.broadcast(sketch)

    def count(batches):
        sketch = sent.value
        for batch in batches:
            (lang, langs), (source, sources) = _codes(batch.column(0)), _codes(batch.column(1))
            group, of = np.unique(lang * len(sources) + source, return_inverse=True)
            lang_hash = _hashes(langs)
            for a, _, data, offs in T.chunks(batch.column(2), CHUNK):
                doc, code, names = _terms(data, offs)
                if not len(doc):
                    continue
                size = len(names)
                key, at = np.unique(of[a + doc] * size + code, return_inverse=True)
                n = np.bincount(at)
                once = np.unique(doc * size + code)
                df = np.bincount(np.searchsorted(key, of[a + once // size] * size + once % size), minlength=len(key))
                own = group[key // size]
                cells = _cells(lang_hash[own // len(sources)], _hashes(names)[key % size], sketch.shape[1], len(sketch))
                alive = np.minimum.reduce([row[cell] for row, cell in zip(sketch, cells)]) >= least
                key, own = key[alive], own[alive]
                take = lambda names, at: names.take(pa.array(at)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([take(langs, own // len(sources)), take(sources, own % len(sources)), take(names, key % size), pa.array(n[alive]), pa.array(df[alive])], ["lang", "source", "term", "n", "df"])
        T.trim()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, sources): the terms in at least that many documents of a language, with their counts by source."""
    listed = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return listed.where(F.col("df") >= least).drop("df")


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), for a count not above total and at least one term, three digits at a time, so that
    it is exact and stays a long up to 10^15."""
    named = lambda c: F.col(c) if isinstance(c, str) else c
    m, rest, value = named(total) + named(terms), (named(count) + 1).cast("long"), F.lit(0)
    for _ in range(3):
        value = value * 1000 + F.call_function("div", rest * 1000, m)
        rest = F.pmod(rest * 1000, m)
    return (value + 1).cast("long")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _both(batches):
    """Sums over terms, for each pair of sources that both have a term, of the gap of their shares against what the term counts for each
    source alone and for neither."""
    ids: dict[tuple[str, str], int] = {}
    keys, values = [], []

    def fold():
        key, at = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        value = np.zeros(len(key), np.int64)
        np.add.at(value, at.ravel(), np.concatenate(values))
        keys[:], values[:] = [key], [value]

    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        size = np.diff(ends)
        lang = np.repeat(np.array(batch.column(0).to_pylist(), object), size)
        own = np.fromiter((ids.setdefault(k, len(ids)) for k in zip(lang, flat.field(0).to_pylist())), np.int64, len(flat))
        p, low = (flat.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        for s in np.unique(size[size > 1]).tolist():
            first = ends[:-1][size == s]
            rows = max(1, BLOCK // (s * s))
            for a in range(0, len(first), rows):
                at = first[a : a + rows, None] + np.arange(s)
                for b in range(0, s, max(1, BLOCK // s)):  # a term of very many sources in strips
                    left, right = at[:, b : b + max(1, BLOCK // s), None], at[:, None, :]
                    g, h, pg, ph, lg, lh = np.broadcast_arrays(own[left], own[right], p[left], p[right], low[left], low[right])
                    other = g != h
                    g, h, pg, ph, lg, lh = (x[other] for x in (g, h, pg, ph, lg, lh))
                    key, to = np.unique(g * np.int64(1 << 31) + h, return_inverse=True)
                    value = np.zeros(len(key), np.int64)
                    np.add.at(value, to, f(pg, ph) - f(pg, lh) - f(lg, ph) + f(lg, lh))
                    keys.append(np.stack([key >> 31, key & ((1 << 31) - 1)], axis=1))
                    values.append(value)
        if sum(map(len, values)) > BLOCK:
            fold()
    if keys:
        fold()
        names = list(ids)
        g, h = keys[0].T.tolist()
        yield pa.RecordBatch.from_arrays([pa.array([names[x][0] for x in g], pa.string()), pa.array([names[x][1] for x in g], pa.string()), pa.array([names[x][1] for x in h], pa.string()), pa.array(values[0])], ["lang", "source", "item", "value"])


def source_divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from every other (`pair`), and the terms it
    has more often than its language (`term`, the first `top`).

    Null texts, languages and sources count as ''; every row is a document, repeated ones and those without an id, too. A group without
    terms has its pairs; a language without kept terms gives pairs of value 0. Equal values are ranked by item. Texts of any
    length are read whole; other columns, whatever their names, are not read. An empty table gives an empty result.
    Tables it writes stay until `release`.
    """
    if not 1 <= least <= 255 or width & (width - 1):
        raise ValueError("least must be from 1 to 255, and width a power of two")
    stage = Stage(spark, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sketch = document_sketch(rows, width, depth)
    terms = stage.put(kept_terms(surviving_counts(rows, sketch, least), least), "terms")

    entries = terms.select("lang", "term", "total", F.inline("sources"))
    held = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_terms"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_all"))
    groups = rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    low = F.when(F.col("v") > 0, share(F.lit(0), "n_all", "v"))
    groups = stage.put(groups.withColumn("low", low), "groups")
    known = stage.put(
        entries.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "n_all", "v").alias("p"), "low", share("total", "lang_all", "v").alias("q")),
        "entries",
    )

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda frame, part: frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    strange = ranked(known.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value")), "term").where(F.col("rank") <= top)

    # a language of many sources is dealt by its sources' hashes, which the other side is repeated for
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(32))
    others = groups.select("lang", F.col("source").alias("item"), F.col("low").alias("other_low"), F.col("n_terms").alias("other_terms"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("slot"))
    alone = known.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")).withColumn("slot", slot("source")).join(others, ["lang", "slot"]).where("source != item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * gap("p", "other_low")).alias("own"), F.sum(F.col("k") * gap("other_low", "p")).alias("other"))
    neither = groups.withColumn("slot", slot("source")).join(others, ["lang", "slot"]).where("source != item")
    neither = neither.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("n_terms") - F.col("other_terms")) * gap("low", "other_low"), F.lit(0)).alias("value"))
    both = known.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "low")).alias("sources")).where("size(sources) > 1").select("lang", "sources").mapInArrow(_both, "lang string, source string, item string, value long")
    sums = neither.unionByName(alone.select("lang", "source", "item", F.col("own").alias("value"))).unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("other").alias("value"))).unionByName(both)
    pairs = ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
    return pairs.unionByName(strange)


def op11_sketched_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(ship(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n_all FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total, l.v, l.n_all AS lang_all, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_all
          FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + {UNIT}::HUGEINT * (n + 1) // (n_all::HUGEINT + v) AS p, 1 + {UNIT}::HUGEINT * (total + 1) // (lang_all + v) AS q FROM dense),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

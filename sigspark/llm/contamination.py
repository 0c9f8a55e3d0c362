"""Benchmark decontamination by a distributed positional inverted index (operator 5).

Words of the benchmark items are the terms. One pass counts every term over all documents. Each window of an item then names
its rarest terms, and a second pass stores the postings of those: term, document and positions. Lists are intersected after
their positions have been moved by the term's offset in the item: postings that agree on (item, document, item start)
form one alignment. An alignment that holds the rarest terms of some window is read through once on the whole document, and
gives the exact phrase matches. Near matches count distinct chosen terms of an item within a span of the document.

Benchmarks are matched in blocks of a bounded number of words, which every executor holds; long items are parted into
segments that overlap by a window less one word, so each window lies in one. A document row is known by its doc_id and a hash of its text.

Terms are compared by 64-bit hashes of the lower-cased words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._shared import Stage, texts

WINDOW = 13
#: Rarest terms of a window whose lists are intersected.
RAREST = 3
#: Most benchmark words that are sent to every executor at once: what a block of items, and twice what a segment of an item holds.
BROADCAST_TERMS = 1_000_000


def benchmark_terms(items: DataFrame, window: int, longest: int) -> DataFrame:
    """(name, segment, pos, term, n): the words of each segment of an item with their positions; n is the segment's number of words.

    A segment has `longest` words at most and begins `window - 1` words before the end of the one before.
    """
    step = max(1, longest - window + 1)

    def run(batches):
        names = ["name", "segment", "pos", "term", "n"]
        for batch in batches:
            for a, b, data, offs in T.chunks(batch.column(2)):
                words, first = T.word_hashes(data, offs, T.ALNUM)
                for k in np.flatnonzero(np.diff(first)):
                    own = words[first[k] : first[k + 1]]
                    key = np.int64(batch.column(1)[a + int(k)].as_py()).view(np.uint64)
                    for part in range(0, max(1, len(own) - window + 1), step):
                        piece = own[part : part + step + window - 1]
                        n = len(piece)
                        # of the whole item, so that segments of equal words in one item are one
                        segment = T.mix(np.array([key + np.uint64(part)]))[0].view(np.int64)
                        name = pa.array([batch.column(0)[a + int(k)].as_py()] * n, pa.string())
                        yield pa.RecordBatch.from_arrays([name, pa.array(np.full(n, segment)), pa.array(np.arange(n, dtype=np.int32)), pa.array(piece.view(np.int64)), pa.array(np.full(n, n, np.int32))], names)

    return items.mapInArrow(run, "name string, segment long, pos int, term long, n int")


def _find(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word among the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


def count_terms(docs: DataFrame, terms) -> DataFrame:
    """(term, cf): how often each known term occurs in all documents."""

    def run(batches):
        known = terms.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, data, offs in T.chunks(batch.column(1)):
                words, _ = T.word_hashes(data, offs, T.ALNUM)
                at = _find(known, words)
                total += np.bincount(at[at >= 0], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], ["term", "cf"])

    return docs.mapInArrow(run, "term long, cf long").groupBy("term").agg(F.sum("cf").alias("cf"))


def build_index(docs: DataFrame, terms) -> DataFrame:
    """The positional index of the known terms in rows (doc_id, text, key): term, doc_id, key, positions, with one row of null term per
    document row that holds its number of words as the only position."""

    def run(batches):
        schema = pa.schema([("term", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("positions", pa.list_(pa.int32()))])
        known = terms.value
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for a, b, data, offs in T.chunks(batch.column(1)):
                words, first = T.word_hashes(data, offs, T.ALNUM)
                counts = np.diff(first)
                at = _find(known, words)
                hit = np.flatnonzero(at >= 0)
                doc = np.searchsorted(first, hit, "right") - 1
                order = np.lexsort((hit, doc, at[hit]))
                hit, doc = hit[order], doc[order]
                term = at[hit]
                new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(hit) else np.zeros(0, np.int64)
                pos = (hit - first[doc]).astype(np.int32)
                ends = np.append(new, len(hit)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(known[term[new]].view(np.int64)), pa.array(ids[a:b][doc[new]]), pa.array(keys[a:b][doc[new]]), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))], schema=schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(b - a, pa.int64()), pa.array(ids[a:b]), pa.array(keys[a:b]), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32)), pa.array(counts.astype(np.int32)))], schema=schema
                )

    return docs.mapInArrow(run, "term long, doc_id long, key long, positions array<int>")


def choose_terms(words: DataFrame, counts: DataFrame, window: int, rarest: int) -> DataFrame:
    """(segment, start, pos, term): the rarest terms of each window that begins at start (whole short items: start 0)."""
    known = words.join(counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - (window - 1)), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - window)))
    each = known.withColumn("start", F.explode(starts))
    order = Window.partitionBy("segment", "start").orderBy("cf", "term", "pos")
    # a window with a term that no document has cannot occur
    least = Window.partitionBy("segment", "start")
    return each.withColumn("least", F.min("cf").over(least)).where("least > 0").withColumn("k", F.row_number().over(order)).where(F.col("k") <= rarest).select("segment", "start", "pos", "term")


def _read_alignments(items, window, batches):
    """Exact matches along the alignments of each document row (doc_id, key, text, alignments): hit words, items and spans."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32()))])
    words_of = items.value
    for batch in batches:
        for a, b, data, offs in T.chunks(batch.column(2)):
            words, first = T.word_hashes(data, offs, T.ALNUM)
            rows = [[], [], [], []]
            for k in range(a, b):
                own = words[first[k - a] : first[k - a + 1]]
                hit, found = np.zeros(len(own), bool), set()
                for al in batch.column(3)[k].as_py():
                    name, item = words_of[al["segment"]]
                    size = min(window, len(item))
                    lo, hi = max(0, -al["d"]), min(len(item), len(own) - al["d"])
                    if hi - lo < size:
                        continue
                    same = own[al["d"] + lo : al["d"] + hi] == item[lo:hi]
                    run = np.cumsum(np.concatenate([[0], same]))
                    begins = np.flatnonzero(run[size:] - run[:-size] == size)
                    if len(begins):
                        found.add(name)
                        for s in begins:
                            hit[al["d"] + lo + s : al["d"] + lo + s + size] = True
                if found:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    for row, value in zip(rows, (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), sorted(found), edge.tolist())):
                        row.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)


def benchmark_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, near_span: int | None = None, most_terms: int = BROADCAST_TERMS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids as strings of items with an occurring window, ascending), spans
    (begin and end word of each hit run, in turn), and with near_span, n_near (items of which all the rarest terms of some
    window stand within that many words, in any order).

    Null and blank texts have no words. Items without an id or words match nothing; an item of fewer than `window` words is
    one window; of items of one id each text counts, but the id once. Ids of items are of any type. Documents without an id are left
    out; of repeated ids each row is kept and judged by its own text. Texts and items of any length are read whole. Columns of other
    names are not read. Empty tables give no matches. Benchmarks of more than most_terms words give the same rows, with two scans
    of the documents for each block.
    """
    docs = texts(docs).withColumn("key", F.xxhash64("text"))
    named = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    stage = Stage(spark, "contamination")
    every = stage.put(benchmark_terms(named.distinct().select("name", F.xxhash64("name", "text").alias("segment"), "text"), window, max(2 * window, most_terms // 2)).distinct(), "words")
    blocks = max(1, -(-2 * every.count() // most_terms)) if every.count() > most_terms else 1
    found, near = [], []
    for block in range(blocks):
        words = every.where(F.pmod(F.xxhash64("segment"), F.lit(blocks)) == block)
        exact, index, chosen = _match(spark, stage, docs, words, window, rarest, block)
        found.append(exact)
        if near_span is not None:
            names = words.select("segment", "name").distinct()
            near.append(proximity(index.where("term IS NOT NULL"), chosen, names, near_span))
        if block == 0:
            lengths = stage.put(index.where("term IS NULL").select("doc_id", "key", F.col("positions")[0].cast("long").alias("n_words")), "lengths")
    hits = stage.put(_united(found), "hits")
    none = F.array().cast("array<string>"), F.array().cast("array<int>")
    out = lengths.join(hits, ["doc_id", "key"], "left")
    if near_span is not None:
        close = near[0]
        for other in near[1:]:
            close = close.union(other)
        counted = stage.put(close.groupBy("doc_id", "key").agg(F.count_distinct("name").alias("n_near")), "near")
        out = out.join(counted, ["doc_id", "key"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    stage.drop(*[k for k in stage.paths if k not in ("lengths", "hits", "near")])
    more = ["n_near"] if near_span is not None else []
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"), *more)


def _match(spark: SparkSession, stage: Stage, docs: DataFrame, words: DataFrame, window: int, rarest: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact matches, index, chosen terms) of a block of segments. What is sent to all tasks has a few rows for each of its words."""
    send = spark.sparkContext.broadcast
    table = words.orderBy("segment", "pos").toPandas()
    terms = send(np.unique(table["term"].to_numpy(np.int64).view(np.uint64)))
    chosen = stage.put(choose_terms(words, count_terms(docs, terms), window, rarest), f"chosen{block}")
    picked = chosen.select("term").distinct().toPandas()["term"].to_numpy(np.int64).view(np.uint64)
    index = stage.put(build_index(docs, send(np.sort(picked))), f"index{block}")
    offsets = chosen.select("segment", "pos", "term").distinct()
    postings = index.where("term IS NOT NULL").join(F.broadcast(offsets), "term")
    moved = postings.select("doc_id", "key", "segment", F.col("pos").alias("offset"), F.explode("positions").alias("at")).select("doc_id", "key", "segment", (F.col("at") - F.col("offset")).alias("d"), "offset")
    aligned = moved.groupBy("doc_id", "key", "segment", "d").agg(F.collect_set("offset").alias("offsets"))
    # the offsets that each window needs, by segment; an alignment must hold all of one window
    need = chosen.groupBy("segment", "start").agg(F.collect_set("pos").alias("need")).groupBy("segment").agg(F.collect_set("need").alias("needs"))
    held = aligned.join(F.broadcast(need), "segment").where(F.exists("needs", lambda x: F.size(F.array_except(x, F.col("offsets"))) == 0))
    candidates = stage.put(held.groupBy("doc_id", "key").agg(F.collect_list(F.struct("segment", "d")).alias("alignments")), f"candidates{block}")
    at = {int(segment): (group["name"].iloc[0], group["term"].to_numpy(np.int64).view(np.uint64)) for segment, group in table.groupby("segment")}
    sent = send(at)
    read = docs.join(candidates, ["doc_id", "key"]).select("doc_id", "key", "text", "alignments")
    exact = read.mapInArrow(lambda it: _read_alignments(sent, window, it), "doc_id long, key long, items array<string>, spans array<int>")
    return stage.put(exact.dropDuplicates(["doc_id", "key"]), f"exact{block}"), index, chosen


def _united(parts: list[DataFrame]) -> DataFrame:
    """(doc_id, key, items, spans, n_hit): of each document row the items of all blocks together, its hit spans merged."""
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    per = every.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(frames):
        for frame in frames:
            spans, hits = [], []
            for flat in frame["spans"]:
                out: list[int] = []
                for a, b in sorted(zip(flat[::2], flat[1::2])):
                    if out and a <= out[-1]:
                        out[-1] = max(out[-1], int(b))
                    else:
                        out += [int(a), int(b)]
                spans.append(out)
                hits.append(sum(out[1::2]) - sum(out[::2]))
            yield frame.assign(spans=spans, n_hit=hits)[["doc_id", "key", "items", "spans", "n_hit"]]

    return per.mapInPandas(merge, "doc_id long, key long, items array<string>, spans array<int>, n_hit long")


def proximity(index: DataFrame, chosen: DataFrame, names: DataFrame, span: int) -> DataFrame:
    """(doc_id, key, name): items of which all the rarest terms of some window stand within `span` words of the document.

    The joined tables have a few rows for each word of a block.
    """
    wanted = chosen.groupBy("segment", "start").agg(F.count_distinct("term").alias("need"))
    post = index.select("term", "doc_id", "key", F.explode("positions").alias("at")).join(F.broadcast(chosen.select("segment", "start", "term").distinct()), "term")
    near = Window.partitionBy("segment", "start", "doc_id", "key").orderBy("at").rangeBetween(0, span - 1)
    full = post.withColumn("seen", F.size(F.collect_set("term").over(near))).join(F.broadcast(wanted), ["segment", "start"]).where("seen = need")
    return full.join(F.broadcast(names), "segment").select("doc_id", "key", "name").distinct()


def flags(matches: DataFrame) -> DataFrame:
    """The contract's columns: one row per document with the contamination flag."""

    joined = F.array_join(F.sort_array("items"), ",")
    return matches.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents against the whole of benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return flags(benchmark_matches(spark, docs, items))

"""Substring dedup by sliding sentence spans (operator 3).

A sentence ends at `.`, `!` or `?` before white space, at a line's end, and at the end of the text; a sentence of more than
`long_words` words is cut further after the word of least hash of each `long_words + 1` consecutive words (the last of equal
ones). So no piece is longer than that, and equal passages are cut alike wherever they stand, but for that many words at
either end. Of the runs of at least `sentences` consecutive pieces and `words` words, the shortest from each piece and the
shortest to each piece are hashed over their lower-cased words. Runs are joined globally by hash; the first by (doc_id,
place) stays, and every piece that another occurrence covers is removed from its document.

By default every passage of 51 words that occurs again with the same line ends loses all but its first 9 and last 8 words: cuts
agree between those, and 34 words hold a run of three pieces of at most 9 words and 24 words together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import _text as T
from ._shared import Stage, free_shuffles, parts_for, texts, total_bytes

SENTENCES, WORDS, LONG = 3, 24, 8
_OTHER = 0xD6E8FEB86659FD93
_STOP = T._class(b".!?")
#: Runs that a task holds before it deals them, and those of a part: workers stand beside a heap and other stages' workers.
HELD_RUNS, PART_RUNS = 300_000, 400_000


def least_of_windows(hashes: np.ndarray, width: int, sentence: np.ndarray) -> np.ndarray:
    """Places of the least hash, the last of equal ones, of every width consecutive words of a sentence."""
    at, size = np.arange(len(hashes)), 1
    while size < width:
        step = min(size, width - size)
        one, two = at[:-step], at[step:]
        at, size = np.where(hashes[two] <= hashes[one], two, one), size + step
    n = len(at)
    return at[sentence[:n] == sentence[width - 1 : width - 1 + n]]


def chunk_spans(data: np.ndarray, offs: np.ndarray, sentences: int, words: int, long_words: int):
    """Of a chunk: (document of each piece, its first byte, first and last piece of each run, 64 and 32 bits of the runs' hashes)."""
    starts, ends, doc = T.spans(T.NOT_SPACE[data], offs)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    hashes = T.span_hashes(data, starts, ends)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(n, bool)
    last[:-1] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(last) - last
    last[least_of_windows(hashes, long_words + 1, sentence)] = True
    stop = np.flatnonzero(last)
    begin = np.concatenate([[0], stop[:-1] + 1])
    unit_doc = doc[begin]
    units = len(stop)
    unit = np.arange(units)
    # the shortest run from each piece, and to each piece where it is another one
    to = np.maximum(np.searchsorted(stop + 1, begin + words, "left"), unit + sentences - 1)
    inside = to < units
    inside[inside] &= unit_doc[to[inside]] == unit_doc[inside]
    back = np.minimum(np.searchsorted(begin, stop + 1 - words, "right") - 1, unit - sentences + 1)
    within = back >= 0
    within[within] &= unit_doc[back[within]] == unit_doc[within]
    within[within] = to[back[within]] != unit[within]
    one, two = np.concatenate([unit[inside], back[within]]), np.concatenate([to[inside], unit[within]])
    power, inverse = T._power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=total[1:])
    before, after = begin[one], stop[two] + 1
    run = T.mix((total[after] - total[before]) * inverse[before] + (after - before).astype(np.uint64))
    # 32 bits more, of another base
    other, back_ = T.powers(n + 1, _OTHER)
    np.cumsum(T.mix(hashes) * other[:n], out=total[1:])
    more = (T.mix((total[after] - total[before]) * back_[before]) >> np.uint64(32)).astype(np.uint32)
    return unit_doc, starts[begin], one, two, run, more


def _repeated(run, more, doc, key, place):
    """Sorted occurrences, which of them are the first of their run by (doc, key, place), and which are others, in other places."""
    order = np.lexsort((place, key, doc, more, run))
    run, more, doc, key, place = (x[order] for x in (run, more, doc, key, place))
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (more[1:] != more[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    return (run, more, doc, key, place), new, (doc != doc[first]) | (key != key[first]) | (place != place[first])


def _emit(options, parts, batches):
    """(part, blob): the first occurrence of each run among some documents, by part of the hashes; in further parts, the others."""
    context = TaskContext.get()
    marks_part = parts + (context.partitionId() if context else 0) % _mark_parts(parts)
    bits = parts.bit_length() - 1
    held, n = [], 0

    def flush():
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        (run, more, doc, key, place), new, other = _repeated(*columns)
        del columns
        rows, blobs = [marks_part], [b"".join(x[other].tobytes() for x in (doc, key, place))]
        run, more, doc, key, place = (x[new] for x in (run, more, doc, key, place))
        begin, size = (place >> 32).astype(np.uint32), ((place & 0xFFFFFFFF) - (place >> 32)).astype(np.uint16)
        at = np.searchsorted(run >> np.uint64(64 - bits), np.arange(parts + 1, dtype=np.uint64)) if bits else np.array([0, len(run)])
        for p in range(parts):
            x, y = at[p], at[p + 1]
            if x < y:
                rows.append(p)
                blobs.append(b"".join(c[x:y].tobytes() for c in (run, doc, key, begin, more, size)))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    for batch in batches:
        ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for a, b, data, offs in T.chunks(batch.column(1)):
            doc, _, one, two, run, more = chunk_spans(data, offs, *options)
            first = np.searchsorted(doc, doc[one], "left")
            # a place orders runs by their first piece: that, then the last
            place = (one - first << 32) + two - first
            held.append((run, more, ids[a:b][doc[one]], keys[a:b][doc[one]], place))
            n += len(run)
            if n > HELD_RUNS:
                yield flush()
                n = 0
                T.trim()
    if held:
        yield flush()
    T.trim()


def _mark_parts(parts: int) -> int:
    return max(1, parts // 4)


def _marks(parts: int, table: pa.Table) -> pa.Table:
    """(doc_id, key, place) of the runs of a part that are not the first of their hash."""
    raw = [x.as_buffer() for x in table.column("blob")]
    if table.column("part")[0].as_py() >= parts:
        doc, key, place = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in raw], axis=1)
        return pa.table({"doc_id": doc, "key": key, "place": place})
    columns = [[] for _ in range(6)]
    for x in raw:
        n, at = x.size // 34, 0
        for c, kind in zip(columns, (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint16)):
            c.append(np.frombuffer(x, kind, n, at))
            at += n * np.dtype(kind).itemsize
    run, doc, key, begin, more, size = (np.concatenate(c) for c in columns)
    begin = begin.astype(np.int64)
    (_, _, doc, key, place), _, other = _repeated(run, more, doc, key, (begin << 32) + begin + size)
    T.trim()
    return pa.table({"doc_id": doc[other], "key": key[other], "place": place[other]})


def _cut(options, schema, text_at, places_at, batches):
    for batch in batches:
        texts_, counts, removed = [], [], []
        for a, b, data, offs in T.chunks(batch.column(text_at)):
            doc, at, *_ = chunk_spans(data, offs, *options)
            first = np.searchsorted(doc, np.arange(b - a + 1))
            raw = data.tobytes()
            for k in range(b - a):
                lo, hi = first[k], first[k + 1]
                places = batch.column(places_at)[a + k].as_py()
                counts.append(int(hi - lo))
                if not places:
                    texts_.append(None)
                    removed.append(0)
                    continue
                gone = np.zeros(hi - lo + 1, np.int64)
                for p in places:
                    gone[p >> 32] += 1
                    gone[(p & 0xFFFFFFFF) + 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                bounds = np.append(at[lo:hi], offs[k + 1])
                bounds[0] = offs[k]
                kept = b"".join(raw[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~gone))
                texts_.append(kept.decode("utf-8", "replace"))
                removed.append(int(gone.sum()))
        new = pa.array(texts_, pa.string())
        old = batch.column(text_at)
        touched = pa.array([t is not None for t in texts_])
        columns = [c for k, c in enumerate(batch.columns) if k != places_at]
        columns[text_at] = pc.if_else(touched, new, old.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], schema=schema)


def repeated_spans(docs: DataFrame, options: tuple[int, int, int], volume: int) -> DataFrame:
    """(doc_id, key, place): the runs that are not the first of their hash, of rows (doc_id, text, key) of so many bytes.

    Of some documents of a task only the first occurrence of a run is dealt by its hash; the others are known not to be
    first. So a run that a third of all documents hold costs a few entries for each task, and no task gets them all.
    """
    if options[1] >= 1 << 16 or options[0] >= 1 << 16:
        raise ValueError("runs of fewer than 65536 pieces and words")
    parts = parts_for(volume / 25, PART_RUNS, 8)
    emitted = docs.mapInArrow(lambda it: _emit(options, parts, it), "part int, blob binary")
    return emitted.repartitionById(parts + _mark_parts(parts), F.col("part")).groupBy("part").applyInArrow(lambda t: _marks(parts, t), "doc_id long, key long, place long")


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, long_words: int = LONG) -> DataFrame:
    """All columns of docs with the repeated sentences taken out of text, then n_sentences and n_removed.

    A null text stays null; a text of which nothing is left is empty; one of any length is cut whole. Equal rows are all kept, and cut alike, as
    one document. Rows of one doc_id with different texts are documents of their own, in the order of their texts' hashes.
    Rows without an id are kept as they are. An empty table gives an empty result. Columns of docs named like the new ones are replaced.
    """
    options = (sentences, words, long_words)
    stage = Stage(spark, "spans")
    new = ("n_sentences", "n_removed", "places", "marked_id", "marked_key")
    others = [c for c in docs.columns if c not in new]
    docs = docs.select(*others)
    hashed = F.xxhash64(F.col("text").cast("string"))
    one_id = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi"))
    # told apart by text only where ids don't do it
    key = hashed if one_id.where("lo <> hi").limit(1).count() else F.lit(0).cast("long")
    found = stage.put(repeated_spans(texts(docs).withColumn("key", key), options, total_bytes(texts(docs))[1]), "found")
    free_shuffles(spark)
    marks = found.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    marks = stage.put(marks, "marks").withColumnsRenamed({"doc_id": "marked_id", "key": "marked_key"})
    stage.drop("found")
    free_shuffles(spark)
    joined = docs.join(marks, (F.col("doc_id") == F.col("marked_id")) & (key == F.col("marked_key")), "left").select(*others, "places")
    fields = [*docs.schema.fields, StructField("n_sentences", LongType()), StructField("n_removed", LongType())]
    out = StructType([StructField("text", StringType()) if f.name == "text" else f for f in fields])
    schema = to_arrow_schema(out)
    at, places = others.index("text"), len(others)
    return joined.mapInArrow(lambda it: _cut(options, schema, at, places, it), out)


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents: doc_id, text without repeated spans, n_sentences, n_removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_spans(spark, docs.select("doc_id", "text")).select("doc_id", "text", "n_sentences", "n_removed")

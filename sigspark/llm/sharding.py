"""Sharding by histogram sort (operator 2).

Documents are sorted by the key (hash of the text, doc_id) and cut into shards of near equal bytes. The cuts are found
without sorting: each round counts, over all partitions, the exact bytes and rows below candidate keys, and places the next
candidates inside the interval in which a cut must lie, until every cut is met within the tolerance. Then one exchange
sends each row to the interval between two cuts, where it is sorted and numbered; a shard of many rows is cut into several
such intervals, also through a group of equal texts, so no task holds a whole shard. Rows before each interval are known
exactly from the histogram, so slots are gapless.

Candidates prefer the edges of groups of equal texts. A group is cut only if its bytes exceed the tolerance.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Stage, texts

_TOP = 1 << 128
_LOW = (1 << 64) - 1
_SIGN = np.uint64(1 << 63)
#: Most intervals of the exchange; beyond them tasks get longer, and sort on disk.
INTERVALS = 4096


def _below(h: np.ndarray, d: np.ndarray, probes: list[int]) -> np.ndarray:
    """For each key (h, d) the number of probes that are at or below it."""
    ph = np.array([p >> 64 for p in probes], np.uint64)
    pd_ = np.array([p & _LOW for p in probes], np.uint64)
    at = np.searchsorted(ph, h, "left")
    end = np.searchsorted(ph, h, "right")
    tied = np.flatnonzero(end > at)
    if len(tied):  # a probe inside a group of equal texts
        for value in np.unique(h[tied]):
            own = tied[h[tied] == value]
            a, b = np.searchsorted(ph, value, "left"), np.searchsorted(ph, value, "right")
            at[own] = a + np.searchsorted(pd_[a:b], d[own], "right")
    return at


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    h, d = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN for k in (0, 1))
    return h, d


def _histogram(table: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe, over all rows: only one sum for each probe comes to the driver."""

    def count(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = _below(*_keys(batch), probes)
            size += np.bincount(at, batch.column(2).to_numpy(zero_copy_only=False), len(probes) + 1).astype(np.int64)
            rows += np.bincount(at, minlength=len(probes) + 1)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], ["at", "size", "rows"])

    got = table.select("h", "doc_id", "size").mapInArrow(count, "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in got:
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def _candidates(lo: int, hi: int, each: int) -> list[int]:
    """Keys inside the interval: at edges of text groups as long as it spans several hashes, then between doc_ids."""
    a, b = lo >> 64, hi >> 64
    if b - a > 1:
        n = min(each, b - a - 1)
        return [(a + (b - a) * (k + 1) // (n + 1)) << 64 for k in range(n)]
    n = min(each, hi - lo - 1)
    return [lo + (hi - lo) * (k + 1) // (n + 1) for k in range(n)]


def find_cuts(table: DataFrame, goals: list[tuple[str, float]], tolerance: dict[str, float], each: int = 64) -> list[tuple[int, int, int]]:
    """For each goal (measure, amount below) in ascending order a (key, bytes below, rows below) within the tolerance.

    Where no key is that near, it is the nearest of the two neighbours.
    """
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    kinds = {"bytes": 1, "rows": 2}
    lo = [(0, 0, 0)] * len(goals)
    hi = [(_TOP, int(total["b"]), int(total["n"]))] * len(goals)
    found: list = [None] * len(goals)
    while True:
        spans = {(lo[i][0], hi[i][0]) for i in range(len(goals)) if found[i] is None}
        if not spans:
            return found
        probes = sorted({p for a, b in spans for p in _candidates(a, b, each * max(1, len(goals) // len(spans)))})
        size, rows = _histogram(table, probes) if probes else ([], [])
        below = (probes, size, rows)
        for i, (measure, amount) in enumerate(goals):
            if found[i] is None:
                k = kinds[measure]
                # the last probe with no more than the amount below it, and the next one
                at = bisect_right(below[k], amount)
                if at and probes[at - 1] > lo[i][0]:
                    lo[i] = tuple(x[at - 1] for x in below)
                if at < len(probes) and probes[at] < hi[i][0]:
                    hi[i] = tuple(x[at] for x in below)
                best = min(lo[i], hi[i], key=lambda x: abs(x[k] - amount))
                if abs(best[k] - amount) <= tolerance[measure] or hi[i][0] - lo[i][0] <= 1 or not probes:
                    found[i] = best


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 16, tolerance: float = 0.002, rows_each: int = 50_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: the bytes of the shards (UTF-8 length of the text, none for null, plus 1 for each document) differ from
    their mean by at most 2 * tolerance of it, plus the longest document. Slots run from 0 without gaps in the order of the
    key. A null text has size 1 and the checksum 0, like an empty one. Rows without an id are left out; rows of one id each
    get a slot, in the order of their texts' hashes; equal rows are interchangeable. Columns of other names, clashing ones too, are not
    read. A text of any length is one row. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stage = Stage(spark, "shards")
    table = stage.put(
        texts(docs).select(F.xxhash64(text).alias("h"), "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32")), "keys"
    )
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n_bytes, n_rows = int(total["b"]), int(total["n"])
    cuts = find_cuts(table, [("bytes", n_bytes * s / shards) for s in range(1, shards)], {"bytes": tolerance * n_bytes / shards})
    cuts = sorted(cuts)
    finer = min(INTERVALS, max(1, round(n_rows / rows_each)))
    inner = find_cuts(table, [("rows", n_rows * k / finer) for k in range(1, finer)], {"rows": 0.25 * n_rows / finer}) if finer > 1 else []
    bounds = sorted({*cuts, *inner})
    probes = [c[0] for c in bounds]
    shard_of, first = [0], [0]  # of each interval: its shard, and the slot of its first row
    starts = [c[0] for c in cuts]
    rows_before = [0, *[c[2] for c in cuts]]
    for key, _, rows in bounds:
        s = bisect_right(starts, key)
        shard_of.append(s)
        first.append(rows - rows_before[s])

    def deal(batches):
        shard, slot = np.array(shard_of, np.int32), np.array(first, np.int64)
        for batch in batches:
            at = _below(*_keys(batch), probes) if probes else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(shard[at]), pa.array(slot[at])], [*batch.schema.names, "part", "shard", "first"])

    dealt = table.mapInArrow(deal, "h long, doc_id long, size long, text_crc32 long, part int, shard int, first long")
    order = Window.partitionBy("part").orderBy("h", "doc_id", "size")
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents in 16 shards of near equal bytes."""
    return shard_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Pairwise time warping: pairs as a join of ids, payloads joined after, warped in batches of like length."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .spread import spread, tasks_for

#: Cells of the pairs of one batch, of which a column of rows is held at once.
BATCH_CELLS = 2_000_000
#: Cells of cost of two blocks of traces, a task's unit of work: some seconds.
TILE_CELLS = 50_000_000
#: The same where a tile leaves sums only: blocks of some 500 traces of 64 steps, some 20 seconds.
SUM_CELLS = 1 << 30


def unordered_pairs(traces: DataFrame, *group: str) -> DataFrame:
    """(group, a, b) with a < b inside each group: an equi-join with an inequality, not a product."""
    left = traces.select(*group, F.col("trace_id").alias("a"))
    right = traces.select(*group, F.col("trace_id").alias("b"))
    if not group:
        raise ValueError("name the group within which traces are paired")
    return left.join(right, list(group)).where("a < b")


def mirrored(edges: DataFrame, *group: str) -> DataFrame:
    """Both directions of an edge list (a, b, d), from one reading of it."""
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    return edges.select(*group, both, "d").select(*group, "x.a", "x.b", "d")


def _znorm(x):
    m, s = K.robust(x)
    s = s or 1.0
    return (x - m) / s, s


def batches_of(rows: np.ndarray, columns: np.ndarray, cells: int = 0):
    """Indices of pairs of so many steps in batches of like shapes, each of `cells` cells at most (BATCH_CELLS) or one pair.

    A batch costs its longest sides for every pair: so pairs are sorted by both, first into as many ranges of rows as give squares.
    """
    cells = cells or BATCH_CELLS
    if not len(rows):
        return
    by_rows = np.argsort(rows, kind="stable")
    ranges = max(1, round(math.sqrt(len(rows) * float(rows.mean() * columns.mean()) / cells)))
    place = np.empty(len(rows), np.int64)
    place[by_rows] = np.arange(len(rows)) * ranges // len(rows)
    order = np.lexsort((columns, place))
    most = np.maximum.accumulate
    for first in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        k = 0
        while k < len(first):
            rest = first[k : k + cells // int(max(1, rows[first[k]] * columns[first[k]])) + 1]
            fits = np.arange(1, len(rest) + 1) * most(rows[rest]) * most(columns[rest]) <= cells
            n = max(1, int(np.argmin(fits)) if not fits.all() else len(rest))
            yield first[k : k + n]
            k += n


def warp(pairs: DataFrame, left: DataFrame, right: DataFrame, *keys: str, cost: str = "gaussian", normalise: bool = True, **options) -> DataFrame:
    """keys, a, b, dist, norm_dist, length, j_start, j_end of each pair (a, b); inadmissible pairs have distance infinity.

    left and right are nested tables with trace_id, mean and std. With normalise each trace is scaled robustly
    (scale 0 counts as 1).
    """
    ready = pairs.join(left.select(F.col("trace_id").alias("a"), F.col("mean").alias("am"), F.col("std").alias("asd")), "a")
    ready = ready.join(right.select(F.col("trace_id").alias("b"), F.col("mean").alias("bm"), F.col("std").alias("bsd")), "b")
    ready = spread(ready.select(*keys, "a", "b", "am", "asd", "bm", "bsd"), "a", "b")
    first = len(keys) + 2

    def run(batches):
        for batch in batches:
            columns = []
            for k in range(first, first + 4):
                col = batch.column(k)
                values, offsets = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
                columns.append([values[x:y] for x, y in zip(offsets[:-1], offsets[1:])])
            am, asd, bm, bsd = columns
            if normalise:
                for m, s in ((am, asd), (bm, bsd)):
                    for i in range(len(m)):
                        m[i], scale = _znorm(m[i])
                        s[i] = s[i] / scale
            size = np.array([len(x) for x in am]), np.array([len(x) for x in bm])
            out = [np.empty(batch.num_rows) for _ in range(2)] + [np.empty(batch.num_rows, np.int64) for _ in range(3)]
            for own in batches_of(*size):
                w = K.warp_pairs(cost, *([c[i] for i in own] for c in (am, asd, bm, bsd)), **options)
                for target, value in zip(out, (w.dist, w.norm, w.length, w.j_start, w.j_end)):
                    target[own] = value
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], *map(pa.array, out)], [*batch.schema.names[:first], "dist", "norm_dist", "length", "j_start", "j_end"])

    kinds = dict(ready.dtypes)
    ddl = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "a", "b")) + ", dist double, norm_dist double, length long, j_start long, j_end long"
    return ready.mapInArrow(run, ddl)


def pairwise(traces: DataFrame, *group: str, **options) -> DataFrame:
    """Edge list (group, a, b, d) of normalised warping distances inside groups, of any size (`warped`)."""
    return warped(traces, *group, **options).drop("dist").withColumnRenamed("norm_dist", "d")


def warped(traces: DataFrame, *group: str, cost: str = "gaussian", normalise: bool = True, cells: int = TILE_CELLS, **options) -> DataFrame:
    """(group, a, b, dist, norm_dist), a < b: warping distances of all pairs inside groups, of any size (`tiled`)."""

    return tiled(traces, _distances(cost, options), *group, ready=_scaled if normalise else None, cells=cells, names=("dist", "norm_dist"))


def searched(queries: DataFrame, traces: DataFrame, *group: str, cost: str = "gaussian", normalise: bool = True, cells: int = TILE_CELLS, **options) -> DataFrame:
    """(group, a, b, dist, norm_dist): warping distances of each query a to all traces b of its group but the one of its own id.

    Queries and traces of a group are dealt to blocks by hashes of their ids. A block of each is a tile, about `cells` cells of cost: so a
    trace moves once for each block of queries and a query once for each block of traces, not with each pair.
    """
    if not group:
        raise ValueError("name the group within which traces are paired")
    size = lambda frame, x: frame.groupBy(*group).agg((F.count(F.lit(1)) * F.max(F.size("mean"))).cast("double").alias(x))
    sizes = size(queries, "_pa").join(size(traces, "_pb"), list(group))
    # blocks of queries as long as a tile's side at most, and blocks of traces that make the rest of it
    sizes = sizes.withColumn("_na", F.ceil(F.col("_pa") / math.sqrt(cells))).withColumn("_nb", F.ceil(F.col("_pa") / F.col("_na") * F.col("_pb") / cells))
    sizes = sizes.select(*group, F.greatest("_na", F.lit(1)).cast("long").alias("_na"), F.greatest("_nb", F.lit(1)).cast("long").alias("_nb"), (F.col("_pa") * F.col("_pb")).alias("_cells"))
    volume = sizes.agg(F.sum("_cells")).first()[0] or 0.0
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("trace_id"), F.col(n))
    columns = ["trace_id", "mean", "std"]
    asked = queries.join(sizes, list(group)).select(*group, *columns, F.lit(True).alias("_asked"), block("_na").alias("_i"), number("_nb").alias("_j"))
    every = traces.join(sizes, list(group)).select(*group, *columns, F.lit(False).alias("_asked"), block("_nb").alias("_j"), number("_na").alias("_i"))
    kinds, named, distances = dict(traces.dtypes), [*group, "_i", "_j"], _distances(cost, options)

    def tile(key, frame):
        frame = frame.sort_values("trace_id", kind="stable")
        ids, first = frame["trace_id"].to_numpy(), frame["_asked"].to_numpy(bool)
        ready = [(np.asarray(m, float), np.asarray(s, float)) for m, s in zip(frame["mean"], frame["std"])]
        means, stds = map(list, zip(*(_scaled(*x) if normalise else x for x in ready)))
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
        wanted = ids[a] != ids[b]
        a, b = a[wanted], b[wanted]
        d = distances(means, stds, a, b)
        return pd.DataFrame({**{g: [v] * len(a) for g, v in zip(group, key)}, "a": ids[a], "b": ids[b], "dist": d[:, 0], "norm_dist": d[:, 1]})

    ddl = ", ".join(f"{g} {kinds[g]}" for g in group) + f", a {kinds['trace_id']}, b {kinds['trace_id']}, dist double, norm_dist double"
    return asked.unionByName(every).repartition(tasks_for(traces.sparkSession, volume, cells), *named).groupBy(*named).applyInPandas(tile, ddl)


def row_sums(traces: DataFrame, *group: str, cost: str = "gaussian", normalise: bool = True, cells: int = SUM_CELLS, **options) -> DataFrame:
    """(group, trace_id, row_sum): of each trace the sum of its normalised warping distances to all others of its group, of any size.

    Traces of equal steps have equal sums: they are one row, that of their least id, and are warped once. Tiles (`dealt_blocks`) leave
    a row for each of their traces, no pairs.
    """
    kinds, distances = dict(traces.dtypes), _distances(cost, options)
    once = traces.groupBy(*group, "mean", "std").agg(F.min("trace_id").alias("trace_id"), F.count(F.lit(1)).alias("_copies"))
    dealt, named, tasks = dealt_blocks(once, *group, cells=cells, columns=("mean", "std", "_copies"))

    def tile(key, frame):
        frame = frame.sort_values("trace_id", kind="stable")
        ids, copies, block = (frame[c].to_numpy() for c in ("trace_id", "_copies", "_block"))
        means, stds = ([np.asarray(x, float) for x in frame[c]] for c in ("mean", "std"))
        if normalise:
            means, stds = map(list, zip(*map(_scaled, means, stds)))
        same = key[-2] == key[-1]
        a, b = np.triu_indices(len(ids), 0 if same else 1)
        wanted = (a < b) | (copies[a] > 1) if same else block[a] != block[b]
        a, b = a[wanted], b[wanted]
        d = distances(means, stds, a, b)[:, 1]
        sums = np.bincount(a, d * (copies[b] - (a == b)), len(ids)) + np.bincount(b, np.where(a < b, d * copies[a], 0.0), len(ids))
        return pd.DataFrame({**{g: [v] * len(ids) for g, v in zip(group, key)}, "trace_id": ids, "row_sum": sums})

    ddl = ", ".join(f"{g} {kinds[g]}" for g in group) + f", trace_id {kinds['trace_id']}, row_sum double"
    found = dealt.repartition(tasks, *named).groupBy(*named).applyInPandas(tile, ddl)
    return found.groupBy(*group, "trace_id").agg(F.sum("row_sum").alias("row_sum"))


def central(traces: DataFrame, *group: str, top: int, **options) -> DataFrame:
    """(group, trace_id, row_sum, rank): what `clusters.medoid_ranking` gives of all pairs, from `row_sums`, up to a rank."""
    best = lambda frame: frame.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("row_sum", "trace_id")).cast("long")).where(F.col("rank") <= top)
    own = traces.select(*group, "trace_id", "mean", "std")
    several = own.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group)
    # the steps of the first ranks of each group, which copies share
    steps = best(row_sums(traces, *group, **options)).join(own, [*group, "trace_id"]).select(*group, "mean", "std", "row_sum").join(several, list(group))
    return best(own.join(steps, [*group, "mean", "std"]).select(*group, "trace_id", "row_sum"))


def _distances(cost, options: dict):
    def distances(means, stds, a, b):
        size = np.array([len(m) for m in means], np.int64)
        d = np.empty((len(a), 2))
        for part in batches_of(size[a], size[b]):
            w = K.warp_pairs(cost, [means[x] for x in a[part]], [stds[x] for x in a[part]], [means[x] for x in b[part]], [stds[x] for x in b[part]], **options)
            d[part, 0], d[part, 1] = w.dist, w.norm
        return d

    return distances


def _scaled(mean, std):
    m, scale = _znorm(mean)
    return m, std / scale


def squared_distances(traces: DataFrame, *group: str, cells: int = TILE_CELLS) -> DataFrame:
    """Edge list (group, a, b, d) of the squared distances of traces of one length inside groups, of any size (`tiled`)."""

    def distances(means, stds, a, b):
        x = np.stack(means)
        return np.concatenate([((x[a[k : k + 4096]] - x[b[k : k + 4096]]) ** 2).sum(axis=1) for k in range(0, len(a), 4096)])

    return tiled(traces, distances, *group, cells=cells)


def dealt_blocks(traces: DataFrame, *group: str, cells: int, columns: tuple[str, ...] = ("mean", "std")) -> tuple[DataFrame, list[str], int]:
    """(rows of group, trace_id, the columns, _block and the tile's blocks _i <= _j; names of a tile's key; number of tasks): every trace once
    for each block of its group."""
    if not group:
        raise ValueError("name the group within which traces are paired")
    side = math.sqrt(cells)
    sizes = traces.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("mean")).alias("_longest"))
    sizes = sizes.select(*group, F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("_longest") / side)).cast("long").alias("_blocks"), (F.col("_n") * F.col("_longest").cast("double")).alias("_points"))
    own = traces.join(sizes, list(group)).withColumn("_block", F.pmod(F.xxhash64("trace_id"), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = own.select(*group, "trace_id", *columns, "_block", other.alias("_other"))
    dealt = dealt.select(*group, "trace_id", *columns, "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
    volume = sizes.agg(F.sum(F.col("_points") * F.col("_points")) / 2).first()[0] or 0.0
    return dealt, [*group, "_i", "_j"], tasks_for(traces.sparkSession, volume, cells)


def tiled(traces: DataFrame, distances: Callable, *group: str, ready: Callable | None = None, cells: int = TILE_CELLS, names: tuple[str, ...] = ("d",)) -> DataFrame:
    """Edge list (group, a, b, d), a < b, of all pairs inside groups, of any size; `names` of further columns of distances.

    The traces of a group are dealt to blocks by a hash of their ids, so that two blocks have about `cells` cells of cost at most. A
    tile, two blocks of one group, is the unit of work: a trace moves once for each block, not for each pair, and is made
    `ready` (mean, std) once in a tile. distances(means, stds, a, b) gives those of index pairs. There are as many
    tasks as all cells need, `cells` each.
    """
    dealt, named, tasks = dealt_blocks(traces, *group, cells=cells)
    kinds = dict(traces.dtypes)

    def tile(key, frame):
        frame = frame.sort_values("trace_id", kind="stable")
        ids, block = frame["trace_id"].to_numpy(), frame["_block"].to_numpy()
        means, stds = ([np.asarray(x, float) for x in frame[c]] for c in ("mean", "std"))
        if ready is not None:
            means, stds = map(list, zip(*map(ready, means, stds)))
        a, b = np.triu_indices(len(ids), 1)
        wanted = ids[a] < ids[b]
        if key[-2] != key[-1]:
            wanted &= block[a] != block[b]
        a, b = a[wanted], b[wanted]
        d = (distances(means, stds, a, b) if len(a) else np.zeros(0)).reshape(len(a), len(names))
        return pd.DataFrame({**{g: [v] * len(a) for g, v in zip(group, key)}, "a": ids[a], "b": ids[b], **{c: d[:, k] for k, c in enumerate(names)}})

    ddl = ", ".join(f"{g} {kinds[g]}" for g in group) + f", a {kinds['trace_id']}, b {kinds['trace_id']}, " + ", ".join(f"{c} double" for c in names)
    return dealt.repartition(tasks, *named).groupBy(*named).applyInPandas(tile, ddl)


# --- closed forms ------------------------------------------------------------------------------------------------------


def gaussian_cost(x: Column, xs: Column, e: Column, es: Column) -> Column:
    v = xs * xs + es * es
    return 0.5 * (F.lit(K.LOG_2PI) + F.ln(v) + (x - e) * (x - e) / v)


def cost_cells(pairs: DataFrame, left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """The cost grid of each pair as rows (a, b, i, j, cost): for inspection of few pairs."""
    x = left.select(F.col("trace_id").alias("a"), F.posexplode(F.arrays_zip("mean", "std")).alias("i", "x"))
    y = right.select(F.col("trace_id").alias("b"), F.posexplode(F.arrays_zip("mean", "std")).alias("j", "y"))
    d = F.col("x.mean") - F.col("y.mean")
    cost = {"gaussian": gaussian_cost(F.col("x.mean"), F.col("x.std"), F.col("y.mean"), F.col("y.std")), "l2": d * d, "abs": F.abs(d)}[kind]
    return pairs.join(x, "a").join(y, "b").select("a", "b", F.col("i").cast("long"), F.col("j").cast("long"), cost.alias("cost"))


def uncapped_distance(a: Column, b: Column) -> Column:
    """Warping distance without run cap under absolute cost, symmetric1 and closed ends, as a fold over two arrays."""
    big = F.lit(1e300)

    def row(prev, x, first):
        # prev: costs of the row above; the state of the inner fold is (costs so far, value left of the cell)
        step = F.aggregate(
            F.sequence(F.lit(0), F.size(b) - 1),
            F.struct(F.array().cast("array<double>").alias("row"), big.alias("left")),
            lambda s, j: F.struct(
                F.concat(s["row"], F.array(_cell(prev, x, s, j, first, b))).alias("row"),
                _cell(prev, x, s, j, first, b).alias("left"),
            ),
        )
        return step["row"]

    def _cell(prev, x, s, j, first, b):
        c = F.abs(x - F.get(b, j))
        diagonal = F.when(j > 0, F.get(prev, j - 1)).otherwise(big)
        start = F.when(first & (j == 0), F.lit(0.0)).otherwise(F.least(diagonal, F.when(first, big).otherwise(F.get(prev, j)), s["left"]))
        return start + c

    seed = F.struct(F.transform(b, lambda _: big).alias("row"), F.lit(True).alias("first"))
    end = F.aggregate(a, seed, lambda s, x: F.struct(row(s["row"], x, s["first"]).alias("row"), F.lit(False).alias("first")))
    return F.element_at(end["row"], -1)

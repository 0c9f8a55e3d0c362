"""What studies check and report beside their fits: tasks, controls, pairs of classes, gates, tallies and audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import profile_hmm as H
from ..sources.io import cut
from . import metrics
from .consensus import prepare
from .spread import spread

INF = float("inf")
CHANNELS = ("mean", "std", "dwell")


# --- traces and cohorts ------------------------------------------------------------------------------------------------


def reversed_traces(traces: DataFrame, *channels: str) -> DataFrame:
    """Traces with their channels from the last step to the first."""
    return traces.withColumns({c: F.reverse(c) for c in channels or CHANNELS})


def shuffled_traces(traces: DataFrame, seed: int, *channels: str) -> DataFrame:
    """Traces with their steps in the order of a hash of seed, trace and position; all channels alike."""
    channels = channels or CHANNELS
    key = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trace_id").cast("string"), i.cast("string")))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(channels[0]) - 1), lambda i: F.struct(key(i).alias("h"), i.alias("i"))))
    keyed = traces.withColumn("_order", F.when(F.size(channels[0]) > 0, order).otherwise(F.array().cast("array<struct<h:string,i:int>>")))
    dealt = lambda c: F.transform("_order", lambda x: F.get(F.col(c), x["i"]))
    return keyed.withColumns({c: dealt(c) for c in channels}).drop("_order")


def task_table(spark, tasks: dict[str, list]) -> DataFrame:
    """(task, label) of named lists of labels; a label twice in a task is an error."""
    for name, labels in tasks.items():
        if not labels or len(set(labels)) != len(labels):
            raise ValueError(f"task {name!r} has no labels or one of them twice")
    return spark.createDataFrame([(t, label) for t, labels in tasks.items() for label in labels], "task string, label long")


def task_grid(grid: DataFrame, tasks: DataFrame) -> DataFrame:
    """A score grid (event_id, truth, label, score) once for each task: its labels and the events that are truly of them."""
    own = grid.join(F.broadcast(tasks), "label")  # the labels of all tasks, a small table
    return own.join(F.broadcast(tasks.select("task", F.col("label").alias("truth"))), ["task", "truth"], "left_semi")


def task_classification(grid: DataFrame, tasks: DataFrame, lower: bool = True) -> DataFrame:
    """(task, events, accuracy, balanced_accuracy, macro_f1): the metrics of every task, balanced over its labels that occur."""
    s = F.col("score") if lower else -F.col("score")
    best = task_grid(grid, tasks).groupBy("task", "event_id", "truth").agg(F.min_by("label", F.struct(s, F.col("label"))).alias("predicted"))
    cells = best.groupBy("task", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    true = cells.groupBy("task", F.col("truth").alias("label")).agg(hit.alias("hit"), F.sum("n").alias("count"))
    called = cells.groupBy("task", F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    each = true.join(called, ["task", "label"], "left").withColumn("f1", metrics.ratio(2 * F.col("hit"), F.col("count") + F.coalesce("called", F.lit(0))))
    return each.groupBy("task").agg(F.sum("count").alias("events"), (F.sum("hit") / F.sum("count")).alias("accuracy"), F.avg(F.col("hit") / F.col("count")).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def pair_events(grid: DataFrame) -> DataFrame:
    """(a, b, event_id, truth, own, other, margin, positive, hit) of all pairs of labels a < b, over the events of either: the scores under
    the event's own and the other label, that of a less that of b, whether the event is of b, and whether the margin says so."""
    x = grid.select("event_id", "truth", F.col("label").alias("a"), F.col("score").alias("sa"))
    y = grid.select("event_id", F.col("label").alias("b"), F.col("score").alias("sb"))
    both = x.join(y, "event_id").where("a < b AND (truth = a OR truth = b)").withColumn("margin", F.col("sa") - F.col("sb"))
    first = F.col("truth") == F.col("a")
    own, other = (F.when(first, F.col(p)).otherwise(F.col(q)) for p, q in (("sa", "sb"), ("sb", "sa")))
    hit = F.when(first, F.col("margin") <= 0).otherwise(F.col("margin") > 0).cast("double")
    return both.select("a", "b", "event_id", "truth", own.alias("own"), other.alias("other"), "margin", (~first).cast("double").alias("positive"), hit.alias("hit"))


def pair_table(grid: DataFrame, draws: DataFrame | None = None, confidence: float = 0.95) -> DataFrame:
    """(a, b, events, accuracy, balanced_accuracy, auroc, average_precision, median_margin, separation) of all pairs of labels a < b, over the
    events of either; with draws (replicate, event_id) of a stratified bootstrap also low and high of the balanced accuracy.

    The score is that of a less that of b; AUROC and average precision take b as positive, ties by half and by event; the median is
    of the margin by which the chosen label wins; separation is the mean score under the other label over that under the own one.
    """
    both = cut(pair_events(grid))
    sides = (F.avg(F.when(F.col("positive") == k, F.col("hit"))) for k in (0, 1))
    facts = both.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("events"),
        F.avg("hit").alias("accuracy"),
        (sum(sides, F.lit(0.0)) / 2).alias("balanced_accuracy"),
        F.median(F.abs("margin")).alias("median_margin"),
        metrics.separation_ratio(F.avg("other"), F.avg("own")).alias("separation"),
    )
    out = facts.join(metrics.rank_metrics(both, "positive", "margin", "event_id", "a", "b"), ["a", "b"], "left")
    columns = ["a", "b", "events", "accuracy", "balanced_accuracy", "auroc", "average_precision", "median_margin", "separation"]
    if draws is None:
        return out.select(*columns)
    recall = draws.select("replicate", "event_id").join(both, "event_id").groupBy("a", "b", "replicate", "truth").agg(F.avg("hit").alias("r"))
    replicates = recall.groupBy("a", "b", "replicate").agg(F.avg("r").alias("v"))
    return out.join(metrics.percentile_interval(replicates, "v", confidence, "a", "b"), ["a", "b"], "left").select(*columns, "low", "high")


# --- grids and gates ---------------------------------------------------------------------------------------------------


def grid_faults(grid: DataFrame, lower: bool = True) -> DataFrame:
    """(fault, n): scores that are missing or NaN, infinities of the wrong side, and events without an admissible score."""
    wrong = F.lit(-INF if lower else INF)
    nan = F.col("score").isNull() | F.isnan("score")
    kinds = grid.agg(F.count_if(nan).alias("nan"), F.count_if(F.col("score") == wrong).alias("wrong infinity"))
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < INF)
    none = grid.groupBy("event_id").agg(F.count_if(fine).alias("k")).agg(F.count_if(F.col("k") == 0).alias("no admissible score"))
    every = kinds.crossJoin(F.broadcast(none))  # one row each
    return every.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(c).alias("n")) for c in every.columns])).alias("x")).select("x.*")


def checked_grid(grid: DataFrame, lower: bool = True) -> DataFrame:
    """The grid, if it has no faults; else an error that names them."""
    found = [f"{r['n']} x {r['fault']}" for r in grid_faults(grid, lower).where("n > 0").collect()]  # three rows at most
    if found:
        raise ValueError(f"a score grid has faults: {', '.join(found)}")
    return grid


def gate_rows(frame: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(check, passed, detail): one row for each check, a boolean aggregate of the frame and an aggregate that tells more."""
    parts = [F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), detail.cast("string").alias("detail")) for name, (ok, detail) in checks.items()]
    return frame.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("x")).select("x.*")


def require(gates: DataFrame) -> None:
    """Fails unless all gates passed."""
    failed = [f"{r['check']} ({r['detail']})" for r in gates.where("NOT passed").collect()]  # a row for each check
    if failed:
        raise ValueError(f"gates failed: {'; '.join(failed)}")


def checked_join(tables: list[DataFrame], keys: list[str], expected: int | None = None) -> DataFrame:
    """The tables joined by keys, of which each table must hold every one, and once; `expected` rows, if given.

    Keys are checked before the join: inside it, filters that the optimiser infers could hide the faulty ones.
    """
    every = None
    for i, t in enumerate(tables):
        own = t.select(*keys, F.lit(i).alias("_t"))
        every = own if every is None else every.union(own)
    held = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_t").alias("_k"))
    bad = held.where((F.col("_n") != len(tables)) | (F.col("_k") != len(tables))).limit(5).collect()
    if bad:
        raise ValueError(f"repeated or missing keys, such as {[tuple(r[k] for k in keys) for r in bad]}")
    out = tables[0].select(*keys)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} keys, not {expected}")
    for t in tables:
        out = out.join(t, keys)
    return out


def tallies(rows: DataFrame, retained: Column, *keys: str) -> DataFrame:
    """(keys, total, retained, excluded), and the same over all with null keys."""
    from functools import reduce

    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(retained).alias("retained"), F.count_if(~F.coalesce(retained, F.lit(False))).alias("excluded")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.groupBy(*keys).agg(*aggs), rows.agg(*aggs)]).select(*keys, "total", "retained", "excluded")


def perturbation_summary(rows: DataFrame, value: str, key: str) -> DataFrame:
    """(key, n, mean, max, min) of what perturbations did to a value."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))


def with_audit_fields(rows: DataFrame, audit: DataFrame, *keys: str) -> DataFrame:
    """Rows with the audit's other columns by key; rows that it doesn't hold keep nulls."""
    return rows.join(audit, list(keys), "left")


def published_text(column: Column, digits: int = 1) -> Column:
    """A share as percent text; missing stays missing."""
    return F.when(column.isNotNull(), F.format_string(f"%.{digits}f %%", 100 * column))


# --- curves, clusters, profiles ----------------------------------------------------------------------------------------


def on_axis(column: Column | str, points: int) -> Column:
    """An array interpolated linearly at `points` places from its first element to its last."""
    a = F.col(column) if isinstance(column, str) else column
    last = F.size(a) - 1

    def at(i):
        x = i * last / F.lit(float(points - 1))
        lo = F.least(F.floor(x).cast("int"), last)
        return F.get(a, lo) + (F.get(a, F.least(lo + 1, last)) - F.get(a, lo)) * (x - lo)

    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def compare_curves(pairs: DataFrame, x: str, y: str, *keys: str, points: int = 401) -> DataFrame:
    """(keys, rmse, mae, max_abs, r) of two array columns of any lengths on a common relative axis."""
    both = pairs.select(*keys, F.explode(F.arrays_zip(on_axis(x, points).alias("x"), on_axis(y, points).alias("y"))).alias("p")).select(*keys, "p.x", "p.y")
    return metrics.curve_metrics(both, "x", "y", *keys)


def cluster_members(edges: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    """(group, label, n_reads, members, medoid, medoid_position): members ascending, the one of least sum of distances inside the
    cluster (ties: the first), and its place among them."""
    from .clusters import medoid_ranking

    la = labels.select(group, F.col("trace_id").alias("a"), "label")
    lb = labels.select(group, F.col("trace_id").alias("b"), F.col("label").alias("lb"))
    inside = edges.join(la, [group, "a"]).join(lb, [group, "b"]).where("label = lb").select(group, "label", "a", "b", "d")
    return _members(labels, medoid_ranking(inside, group, "label", top=1), group)


def grid_cluster_members(traces: DataFrame, labels: DataFrame, group: str, **options) -> DataFrame:
    """What `cluster_members` gives of the squared distances of traces of one length, never kept as pairs (`squares`)."""
    from . import squares

    inside = traces.select(group, "trace_id", "mean").join(labels.select(group, "trace_id", "label"), [group, "trace_id"])
    ranks = squares.ranked(squares.neighbours(inside, group, "label", k=1, **options), group, "label")
    return _members(labels, ranks.where("rank = 1"), group)


def _members(labels: DataFrame, medoids: DataFrame, group: str) -> DataFrame:
    first = medoids.select(group, "label", F.col("trace_id").alias("medoid"))
    own = labels.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n_reads"), F.sort_array(F.collect_list("trace_id")).alias("members"))
    out = own.join(first, [group, "label"], "left").withColumn("medoid", F.coalesce("medoid", F.get("members", F.lit(0))))
    return out.withColumn("medoid_position", F.array_position("members", F.col("medoid")) - 1)


def cluster_reads(traces: DataFrame, group: str, method: str = "average", n_clusters: int | None = None, threshold: float | None = None, min_size: int = 1, **options) -> DataFrame:
    """Reads to clusters to medoids: warping distances inside groups, hierarchical clusters, their members and medoids."""
    from ..sources.io import cut
    from . import clusters, pairs

    edges = cut(pairs.pairwise(traces, group, **options))
    labels = cut(clusters.cluster(edges, group, method, n_clusters, threshold, min_size))
    return cluster_members(edges, labels.where("label >= 0"), group)


def warp_to_axis(traces: DataFrame, profiles: DataFrame, label: str, *, normalise: bool = True, min_std: float = 1e-3, **options) -> DataFrame:
    """(trace_id, label, pos, value): each trace averaged along its warp onto the axis of its label's profile; null where no step falls.

    Profiles join traces by the label, so none goes to all tasks.
    """
    kind = dict(traces.dtypes)[label]
    ready = traces.select("trace_id", label, "mean", "std").join(profiles.select(label, F.col("mean").alias("pm"), F.col("std").alias("ps")), label)

    def run(frames):
        for frame in frames:
            rows = []
            for i, own, m, s, pm, ps in zip(*(frame[c] for c in ("trace_id", label, "mean", "std", "pm", "ps"))):
                m, s = prepare(m, s, normalise, min_std)
                pm, ps = np.asarray(pm, float), np.asarray(ps, float)
                w = K.Warp(K.cost_grid("gaussian", m, s, pm, ps)[None], path=True, **options)
                if np.isfinite(w.dist[0]):
                    value = K.warp_to(w.path(0), m, len(pm))
                    rows += [(i, own, k, None if np.isnan(v) else float(v)) for k, v in enumerate(value)]
            yield pd.DataFrame(rows, columns=["trace_id", label, "pos", "value"])

    return spread(ready.select("trace_id", label, "mean", "std", "pm", "ps")).mapInPandas(run, f"trace_id long, {label} {kind}, pos long, value double")


def aligned_rmse(pairs: DataFrame, profiles: DataFrame, label: str) -> DataFrame:
    """(a, b, rmse) of pairs of profiles along their squared-difference warp."""
    from .alignment import align_profiles

    return align_profiles(pairs, profiles, label).select("a", "b", "rmse")


#: Cells of posteriors (steps times states) that a task holds before it hands them on: a cell is a Python float, some 32 bytes.
POSTERIOR_CELLS = 200_000


def posterior_frames(frames, label: str, normalise: bool, min_std: float, most: int = POSTERIOR_CELLS):
    """Frames of (trace_id, label, log_likelihood, posterior), none with many more cells than `most`."""
    names = ["trace_id", label, "log_likelihood", "posterior"]
    for frame in frames:
        rows, cells = [], 0
        for r in frame.to_dict("records"):
            m, s = prepare(r["mean"], r["std"], normalise, min_std)
            like, gamma = H.score_read(m, s, np.asarray(r["pm"], float), np.asarray(r["ps"], float), r["offsets"], r["weights"], posterior=True)
            rows.append((r["trace_id"], r[label], like, gamma.tolist()))
            cells += gamma.size
            if cells > most:
                yield pd.DataFrame(rows, columns=names)
                rows, cells = [], 0
        yield pd.DataFrame(rows, columns=names)


def hmm_posteriors(traces: DataFrame, profiles: DataFrame, label: str, *, normalise: bool = True, min_std: float = 1e-3) -> DataFrame:
    """(trace_id, label, log_likelihood, posterior): traces under their label's frozen profile HMM; a row of the posterior for each step."""
    kind = dict(traces.dtypes)[label]
    own = profiles.select(label, F.col("mean").alias("pm"), F.col("std").alias("ps"), "offsets", "weights")
    ready = traces.select("trace_id", label, "mean", "std").join(own, label)
    run = lambda frames: posterior_frames(frames, label, normalise, min_std)
    return spread(ready.select("trace_id", label, "mean", "std", "pm", "ps", "offsets", "weights")).mapInPandas(run, f"trace_id long, {label} {kind}, log_likelihood double, posterior array<array<double>>")


def profile_summary(profiles: DataFrame, label: str, least: float = 0.8) -> DataFrame:
    """(label, length, iterations, converged, supported_share, median_depth, monotone, quality): quality asks for convergence and support."""
    share = F.size(F.filter("supported", lambda s: s)) / F.size("supported")
    falls = F.forall(F.sequence(F.lit(1), F.size("objective") - 1), lambda k: F.get("objective", k) - F.get("objective", k - 1) <= 1e-8)
    order = F.sort_array("depth")
    n = F.size("depth")
    median = (F.get(order, F.floor((n - 1) / 2).cast("int")) + F.get(order, F.floor(n / 2).cast("int"))) / 2
    rows = profiles.withColumn("supported_share", share)
    return rows.select(label, F.size("mean").cast("long").alias("length"), "iterations", "converged", "supported_share", median.alias("median_depth"), F.when(F.size("objective") > 1, falls).otherwise(True).alias("monotone"), (F.col("converged") & (F.col("supported_share") >= least)).alias("quality"))

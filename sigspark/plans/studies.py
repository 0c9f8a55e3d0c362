"""Composite studies: preprocessing, screening, fits, classification, ablation, boundary transfer and medoid robustness.

Each takes and returns DataFrames. Profiles, one for each class or candidate, are small and become local tables after a
check of their number; everything by event or by pair stays distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import alignment, clusters, consensus, em, metrics, pairs, refits, regions, resample, robust
from ..operators.spread import spread
from ..sources.fixtures import nest
from ..sources.io import cut
from ..sources.synthetic import synthetic_traces, template


def local(profiles: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of at most `most` rows as a local one, so that its fits run once."""
    rows = profiles.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} profiles")
    return profiles.sparkSession.createDataFrame(rows, profiles.schema)


def preprocess(steps: DataFrame, bounds: DataFrame, target_shift: float, target_scale: float, least_steps: int = 5, tail_threshold: float | None = None, tail: int = 5, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(prepared, manifest) of long steps and interval bounds per trace: calibration by the DNA steps, the peptide part, its
    tail, the last DNA steps and the reason of each exclusion."""
    dna = regions.in_interval(steps, bounds, "d_start", "d_end", "trace_id")
    scaled = robust.affine_calibrate(steps, dna, target_shift, target_scale, "trace_id").withColumn("mean", F.col("cal_mean")).withColumn("std", F.col("cal_std")).drop("cal_mean", "cal_std")
    peptide = nest(regions.in_interval(scaled, bounds, "p_start", "p_end", "trace_id"), "construct")
    if tail_threshold is not None:
        peptide = regions.tail_trim(peptide, tail_threshold, tail)
        peptide = peptide.withColumn("std", F.slice("std", F.lit(1), F.col("keep"))).withColumn("dwell", F.slice("dwell", F.lit(1), F.col("keep")))
    flank = nest(regions.in_interval(scaled, bounds, "d_start", "d_end", "trace_id")).select("trace_id", regions.last_window("mean", window).alias("dna_window"))
    manifest = regions.length_manifest(peptide, least_steps)
    kept = manifest.where("exclusion_reason IS NULL").select("trace_id")
    return peptide.join(flank, "trace_id", "left").join(kept, "trace_id", "left_semi"), manifest


def screen(traces: DataFrame, group: str, threshold: float = 3.5, k: int = 5, scope: str = "upstream", choose: bool = True) -> DataFrame:
    """(group, trace_id, label, score, retained): outliers by the larger positive robust z of medoid and neighbour distances.

    Scope `training` screens training traces only and keeps all others; a group that would keep fewer than two is an error.
    """
    if scope not in ("upstream", "training"):
        raise ValueError(f"scope {scope!r}")
    own = traces if scope == "upstream" else traces.where("is_training")
    edges = cut(pairs.pairwise(own, group).withColumnRenamed(group, "grp"))
    if choose:
        labels = cut(clusters.choose_clusters(edges, "grp").select("grp", "trace_id", "label"))
    else:
        labels = own.select(F.col(group).alias("grp"), "trace_id", F.lit(0).cast("long").alias("label"))
    scores = clusters.outlier_scores(edges, labels, "grp", k=k).select(F.col("grp").alias(group), "trace_id", "label", "score").withColumn("retained", F.col("score") < threshold)
    out = traces.select(group, "trace_id").join(scores, [group, "trace_id"], "left").na.fill(0.0, ["score"]).na.fill(True, ["retained"])
    kept = out.groupBy(group).agg(F.count_if("retained").alias("_kept"))
    checked = kept.withColumn("_ok", F.when(F.col("_kept") >= 2, True).otherwise(F.raise_error(F.concat(F.lit("too few traces kept in "), F.col(group).cast("string"))).cast("boolean")))
    return out.join(checked.where("_ok").select(group), group)


def classify(train: DataFrame, held: DataFrame, group: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, predictions, summary row) of barycentres of the training traces and Gaussian warping scores of the held ones."""
    profiles = local(consensus.fit_barycentres(train, group, min_depth=None, **options))
    truth = held.select("trace_id", F.col(group).alias("truth"))
    grid = alignment.score_against(held, profiles, group).join(truth, "trace_id").select(F.col("trace_id").alias("event_id"), "truth", "label", "score")
    pred = cut(metrics.predictions(grid))
    cells = metrics.confusion(pred, profiles.select(F.col(group).alias("label")))
    return profiles, pred, metrics.summary(metrics.per_class(cells))


def compare_representations(train: DataFrame, held: DataFrame, group: str, fixed: int = 100, replicates: int = 50, seed: int = 11, **options) -> DataFrame:
    """One row per representation (native, p95, fixed): accuracies and their bootstrap interval over shared draws."""
    lengths = train.select(group, F.size("mean").alias("n"))
    target = resample.target_length(lengths, group).first()["target"]
    out = []
    for name, t in (("native", None), ("p95", int(target)), ("fixed", fixed)):
        a, b = (train, held) if t is None else (resample.resample(train, t), resample.resample(held, t))
        _, pred, row = classify(a, b, group, **options)
        draws = metrics.bootstrap_draws(pred, replicates, seed, "truth", "event_id")
        interval = metrics.percentile_interval(metrics.bootstrap_accuracy(pred, draws.select("replicate", "event_id")), "balanced_accuracy", 0.95)
        # one row each, computed before the next representation, so that the driver holds the broadcasts of one at a time
        out.append(local(row.crossJoin(F.broadcast(interval)).withColumn("representation", F.lit(name)).withColumn("target", F.lit(t).cast("long"))))
    return out[0].unionByName(out[1]).unionByName(out[2])


METRICS = ("accuracy", "balanced_accuracy", "macro_f1")


def contrasts(fixed: int) -> list[tuple[str, str]]:
    """The pairs of conditions that an ablation compares."""
    f = f"fixed_{fixed}"
    return [("TO", "T"), ("TN_p95", "T"), (f"TN_{f}", "T"), ("TON_p95", "TO"), (f"TON_{f}", "TO"), ("TNO_p95", "TON_p95"), (f"TNO_{f}", f"TON_{f}")]


def ablation(traces: DataFrame, group: str, fixed: int = 100, least: int = 10, threshold: float = 3.5, replicates: int = 1000, seed: int = 20260810, **options) -> tuple[DataFrame, DataFrame]:
    """(one row per condition, one row per contrast and metric), with bootstrap intervals over shared draws.

    Conditions are trimmed (T), with outlier screening (O), length normalisation (N) to a fixed length or to the 95th
    percentile (p95) of training lengths, before or after screening. They are scored on the held-out traces that all retain.
    """
    spark = traces.sparkSession
    base = cut(traces.where(F.size("mean") >= least))

    def p95(rows: DataFrame) -> int:
        return int(resample.target_length(rows.where("is_training").select(group, F.size("mean").alias("n")), group).first()["target"])

    def screened(rows: DataFrame) -> DataFrame:
        return rows.join(cut(screen(rows, group, threshold).where("retained").select("trace_id")), "trace_id", "left_semi")

    native = screened(base)
    before, after = p95(base), p95(native)
    normal = {"p95": cut(resample.resample(base, before)), f"fixed_{fixed}": cut(resample.resample(base, fixed))}
    targets = {"p95": after, f"fixed_{fixed}": fixed}
    cohorts = {"T": (base, None), "TO": (native, None)}
    cohorts |= {f"TN_{k}": (rows, before if k == "p95" else fixed) for k, rows in normal.items()}
    cohorts |= {f"TON_{k}": (resample.resample(native, t), t) for k, t in targets.items()}
    cohorts |= {f"TNO_{k}": (screened(rows), before if k == "p95" else fixed) for k, rows in normal.items()}
    keys = None
    for name, (c, _) in cohorts.items():
        own = c.where("NOT is_training").select("trace_id", F.lit(name).alias("condition"))
        keys = own if keys is None else keys.union(own)
    common = cut(regions.common_keys(keys, "trace_id", "condition"))
    rows, every = None, None
    for name, (c, target) in cohorts.items():
        held = c.where("NOT is_training").join(common, "trace_id", "left_semi")
        profiles, pred, _ = classify(c.where("is_training"), held, group, **options)
        cells = metrics.confusion(pred, profiles.select(F.col(group).alias("label")))
        row = local(metrics.summary(metrics.per_class(cells)).withColumn("condition", F.lit(name)).withColumn("target", F.lit(target).cast("long")))
        rows = row if rows is None else rows.unionByName(row)
        pred = pred.select("event_id", "truth", "predicted", F.lit(name).alias("condition"))
        every = pred if every is None else every.unionByName(pred)
    rows = local(rows)
    draws = metrics.bootstrap_draws(common.join(base.select("trace_id", F.col(group).alias("truth")), "trace_id"), replicates, seed, "truth", "trace_id")
    boot = metrics.bootstrap_classification(every, draws.withColumnRenamed("trace_id", "event_id"), "condition")
    boot = cut(boot.select("condition", "replicate", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")).select("condition", "replicate", "x.*"))
    bounds = metrics.percentile_interval(boot, "v", 0.95, "condition", "metric")
    wide = bounds.groupBy("condition").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in ("low", "high")])
    pairs_ = spark.createDataFrame(contrasts(fixed), "condition_a string, condition_b string")
    side = lambda frame, x: frame.select(F.col("condition").alias(f"condition_{x}"), *[F.col(c).alias(c if c in ("metric", "replicate") else f"{c}_{x}") for c in frame.columns if c != "condition"])
    differ = F.broadcast(pairs_).join(side(boot, "a"), "condition_a").join(side(boot, "b"), ["condition_b", "metric", "replicate"]).withColumn("difference", F.col("v_a") - F.col("v_b"))
    differ = metrics.percentile_interval(differ, "difference", 0.95, "condition_a", "condition_b", "metric")
    points = rows.select("condition", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")).select("condition", "x.*")
    points = side(points, "a").join(side(points, "b"), "metric").withColumn("estimate", F.col("v_a") - F.col("v_b"))
    return rows.join(wide, "condition"), differ.join(points.select("condition_a", "condition_b", "metric", "estimate"), ["condition_a", "condition_b", "metric"])


def medoid_robustness(train: DataFrame, held: DataFrame, group: str, top: int = 3, **options) -> DataFrame:
    """(group, rank, trace_id, row_sum, distance, rmse, accuracy, changed): the best candidates for a medoid, the profile that
    each starts, its distance to that of the first, and the effect of putting it into the score grid of all classes.
    """
    spark = train.sparkSession
    ranks = local(pairs.central(train, group, top=top))
    starts = {(r[group], r["trace_id"]): r["rank"] for r in ranks.collect()}
    kind = dict(train.dtypes)[group]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trace_id").reset_index(drop=True)
        ready = [consensus.prepare(m, s, True, 1e-3) for m, s in zip(frame["mean"], frame["std"])]
        rows = []
        for i, trace in enumerate(frame["trace_id"]):
            rank = starts.get((frame[group].iloc[0], trace))
            if rank is not None:
                b = consensus.barycentre([r[0] for r in ready], [r[1] for r in ready], [np.asarray(d, float) for d in frame["dwell"]], medoid=i, min_depth=max(2, -(-len(ready) // 2)), **options)
                rows.append({group: frame[group].iloc[0], "rank": rank, "mean": b["mean"].tolist(), "std": b["std"].tolist(), "supported": b["supported"].tolist()})
        return pd.DataFrame(rows)

    fits = local(spread(train.select(group, "trace_id", "mean", "std", "dwell"), group).groupBy(group).applyInPandas(fit, f"{group} {kind}, rank long, mean array<double>, std array<double>, supported array<boolean>"))
    named = local(fits.withColumn("key", F.concat_ws("#", F.col(group).cast("string"), F.col("rank").cast("string"))))
    first = named.where("rank = 1").select(F.col("key").alias("b"), F.col(group))
    links = named.where("rank > 1").select(F.col("key").alias("a"), group).join(first, group).select("a", "b")
    near = alignment.align_profiles(links, named, "key").select(F.col("a").alias("key"), "distance", "rmse")
    truth = held.select("trace_id", F.col(group).alias("truth"))
    grid = alignment.score_against(held, named, "key").withColumnRenamed("label", "key").join(named.select("key", group, "rank"), "key").join(truth, "trace_id")
    grid = grid.select(F.col("trace_id").alias("event_id"), "truth", F.col(group).alias("label"), "rank", "score")
    base = grid.where("rank = 1").drop("rank")
    before = metrics.predictions(base).select("event_id", F.col("predicted").alias("before"))
    # every substitution at once: candidate (label, rank) replaces one column of the base grid
    swaps = grid.where("rank > 1").select("event_id", F.col("label").alias("swap"), "rank", F.col("score").alias("new"))
    tried = base.join(swaps, "event_id").select("event_id", "truth", "label", F.when(F.col("label") == F.col("swap"), F.col("new")).otherwise(F.col("score")).alias("score"), "swap", "rank")
    chosen = tried.groupBy("swap", "rank", "event_id", "truth").agg(F.min_by("label", F.struct("score", "label")).alias("after")).join(before, "event_id")
    effect = chosen.groupBy("swap", "rank").agg(F.avg((F.col("after") == F.col("truth")).cast("double")).alias("accuracy"), F.count_if(F.col("after") != F.col("before")).alias("changed"))
    out = ranks.join(named.select(group, "rank", "key"), [group, "rank"]).join(near, "key", "left").drop("key")
    return out.join(effect.withColumnRenamed("swap", group), [group, "rank"], "left").select(group, "rank", "trace_id", "row_sum", "distance", "rmse", "accuracy", "changed")


def demonstration(spark, seed: int = 42, points: int = 64) -> dict:
    """The consensus of the synthetic set on a common grid, and how near it is to the template."""
    fixed = resample.resample(synthetic_traces(spark, seed), points).orderBy("trace_id").collect()
    means, stds = [np.array(r["mean"]) for r in fixed], [np.array(r["std"]) for r in fixed]
    b = consensus.barycentre(means, stds, [np.ones(points)] * len(means), max_iter=50, tol=1e-6)
    x = np.linspace(0.0, 1.0, points)
    rmse = lambda v: float(np.sqrt(np.mean((v - template(x)) ** 2)))
    return {**b, "position": x, "truth": template(x), "consensus_rmse": rmse(b["mean"]), "medoid_rmse": rmse(means[b["medoid"]])}


def recording_segments(channels: DataFrame, annotations: DataFrame, **options) -> DataFrame:
    """Steps of annotated events in calibrated channels: each event's samples are cut out, then parted at change points.

    channels: dataset, sample_rate, pa; annotations: dataset, index and bounds in samples. Bounds of steps are global.
    """
    cut = F.slice("pa", F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx"))
    events = annotations.join(channels, "dataset").select("dataset", "index", "start_idx", cut.alias("samples"))
    steps = alignment.change_point_steps(events, "dataset", "index", **options)
    moved = steps.join(annotations.select("dataset", "index", "start_idx"), ["dataset", "index"])
    return moved.withColumns({"start_sample": F.col("start_sample") + F.col("start_idx"), "end_sample": F.col("end_sample") + F.col("start_idx")}).drop("start_idx")


def boundary_transfer(events: DataFrame, anchors: DataFrame, steps: DataFrame, truth: DataFrame, source: str, folds: int = 5, **options) -> DataFrame:
    """Boundary errors per construct under models of the construct's other folds (`oof`) and of one source construct (`transfer`).

    events carry construct and fold; steps have region, construct and fold; truth: trace_id, truth (a step).
    """
    out = None
    for name in ("oof", "transfer"):
        if name == "oof":
            models = regions.fit_levels(regions.leave_fold_out(steps, "fold", folds), "held_fold", "region")
        else:
            models = regions.fit_levels(steps.where(F.col("construct") == source), "region")
        found = alignment.decode_boundaries(events, anchors, models, "trace_id", "construct", **options).join(truth, "trace_id")
        rows = found.select("construct", "status", (F.col("boundary_step") - F.col("truth")).cast("double").alias("error"))
        part = metrics.boundary_summary(rows, "construct").withColumn("analysis", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("*", *metrics.percent("acceptance", "exact", "within_one"))


def aligned_rmse(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square difference of two levels along their warp."""
    w = K.Warp(K.cost_grid("l2", a, a, b, b)[None], path=True)
    p = w.path(0)
    return float(np.sqrt(((a[p[:, 0]] - b[p[:, 1]]) ** 2).mean()))


def refit_stability(traces: DataFrame, group: str, replicates: int = 10, seed: int = 0, min_std: float = 1e-3, **options) -> DataFrame:
    """(group, replicate, traces, iterations, converged, objective, rmse, r): refits of each group's barycentre under resampling of its
    traces, against the plain fit (replicate 0), position by position: all begin from the same trace, so they have one axis."""
    found = refits.fit_rounds(em.prepared(traces, group, True, min_std), group, replicates=replicates, seed=seed, min_std=min_std, **options)
    rows = []
    for (g, k), m in sorted(found.items()):
        x, y = m["mean"], found[g, 0]["mean"]
        r = float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else None
        rows.append((g, k, m["reads"], m["iterations"], m["converged"], m["objective"][-1], float(np.sqrt(((x - y) ** 2).mean())), r))
    return traces.sparkSession.createDataFrame(rows, f"{group} {dict(traces.dtypes)[group]}, replicate long, traces long, iterations long, converged boolean, objective double, rmse double, r double")

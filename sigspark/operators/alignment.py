"""Hidden-Markov alignment, boundary decoding, change points and profile fits as DataFrame operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import kernels as K
from ..functions import profile_hmm as H
from ..functions.boundary import BoundaryOptions, segment
from . import em
from .consensus import medoid_of, pair_matrix, prepare
from .spread import spread

PROFILE_HMM = (
    "mean array<double>, std array<double>, dwell array<double>, stderr array<double>, depth array<double>, supported array<boolean>, offsets array<long>, weights array<double>, "
    "medoid_id long, n_iter long, converged boolean, cap_hit boolean, stop_reason string, log_likelihood array<double>, final_log_likelihood double, min_std double, tol double, max_iter long, min_depth long, pseudocount double, normalise boolean, "
    "history array<struct<mean_delta:double,std_delta:double,transition_delta:double,delta:double,transition_before:double,transition_after:double,gradient:double,emission_before:double,emission_after:double,mean:array<double>,std:array<double>,dwell:array<double>,weights:array<double>>>"
)
BOUNDARY = (
    "status string, boundary_step long, boundary_sample long, dna_start_step long, dna_end_step long, ref_start long, ref_end long, coverage double, observed double, total double, `null` double, "
    "margin double, emission_margin double, labels array<string>, dna_path array<long>, error_message string"
)


def change_point_steps(channels: DataFrame, *keys: str, sensitivity: float = 1.0, least: int = 2) -> DataFrame:
    """(keys, pos, mean, std, dwell, start_sample, end_sample): the levels of each signal array, one task row at a time."""
    kinds = dict(channels.dtypes)

    def run(frames):
        for frame in frames:
            rows = []
            for values, *own in zip(frame["samples"], *(frame[k] for k in keys)):
                x = np.asarray(values, float)
                rows += [(*own, pos, *level) for pos, level in enumerate(K.levels(x, K.change_points(x, sensitivity, least)))]
            yield pd.DataFrame(rows, columns=[*keys, "pos", "mean", "std", "dwell", "start_sample", "end_sample"])

    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pos long, mean double, std double, dwell long, start_sample long, end_sample long"
    return spread(channels.select(*keys, "samples")).mapInPandas(run, ddl)


def step_statistics(steps: DataFrame, channels: DataFrame, *keys: str, statistic: str = "median", sample_rate: float = 1.0, floor: float = 0.0) -> DataFrame:
    """Levels restated on the samples: median or mean, population std (floored), dwell in seconds."""
    if statistic not in ("median", "mean"):
        raise ValueError(f"statistic {statistic!r}")
    own = F.filter(F.slice("samples", F.col("start_sample") + 1, F.col("end_sample") - F.col("start_sample")), lambda x: ~F.isnan(x))
    parts = steps.select(*keys, "pos", "start_sample", "end_sample").join(channels.select(*keys, "samples"), list(keys)).select(*keys, "pos", "start_sample", "end_sample", F.explode(own).alias("x"))
    level = F.median("x") if statistic == "median" else F.avg("x")
    out = parts.groupBy(*keys, "pos", "start_sample", "end_sample").agg(level.alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"))
    return out.withColumn("dwell", (F.col("end_sample") - F.col("start_sample")) / F.lit(sample_rate))


#: Cells (steps times states) of the traces that are aligned at once.
ALIGNED_CELLS = 200_000


def align_to_profile(traces: DataFrame, profile_mean, profile_std, **params) -> DataFrame:
    """(trace_id, path, total_score, log_likelihood, posterior_peak): Viterbi and forward-backward against one known profile."""
    em, es = np.asarray(profile_mean, float), np.asarray(profile_std, float)

    def run(frames):
        with np.errstate(divide="ignore"):
            jump = np.log(K.jump_pmf(**params))
        for frame in frames:
            reads = [(np.asarray(m, float), np.asarray(s, float)) for m, s in zip(frame["mean"], frame["std"])]
            ids = frame["trace_id"].to_numpy()
            for own in H.by_length(reads):
                step = max(1, ALIGNED_CELLS // max(1, len(reads[own[0]][0]) * len(em)))
                for k in range(0, len(own), step):
                    part = own[k : k + step]
                    score = K.emission(*(np.stack([reads[i][c] for i in part]) for c in range(2)), em, es)
                    path, total = K.viterbi_band(score, jump)
                    like, w = K.forward_backward_band(score, jump)
                    yield pd.DataFrame({"trace_id": ids[part], "path": list(path), "total_score": total, "log_likelihood": like, "posterior_peak": list(w.max(axis=2))})

    return spread(traces.select("trace_id", "mean", "std")).mapInPandas(run, "trace_id long, path array<long>, total_score double, log_likelihood double, posterior_peak array<double>")


def decode_boundaries(events: DataFrame, anchors: DataFrame, models: DataFrame, *keys: str, options: BoundaryOptions = BoundaryOptions()) -> DataFrame:
    """keys and the boundary of each event. events: keys, anchor_id and arrays mean, std, start_sample, end_sample, and
    where models has a held_fold, the event's fold. anchors: anchor_id, mean, std, ref_pos arrays. models: region, level, spread.

    Anchors and region models are joined to events by their keys; an event that can't be decoded keeps its error.
    """
    regions = models.groupBy(*(["held_fold"] if "held_fold" in models.columns else [])).agg(F.map_from_entries(F.collect_list(F.struct("region", F.array("level", "spread")))).alias("models"))
    joined = events.join(anchors.select("anchor_id", F.col("mean").alias("am"), F.col("std").alias("asd"), "ref_pos"), "anchor_id")
    joined = joined.join(regions, F.col("fold") == F.col("held_fold")) if "held_fold" in models.columns else joined.crossJoin(F.broadcast(regions))  # one row
    kinds = dict(events.dtypes)

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                own = {k: getattr(r, k) for k in keys}
                try:
                    arrays = (np.asarray(getattr(r, c), float) for c in ("mean", "std", "start_sample", "end_sample", "am", "asd"))
                    found = segment(*arrays, np.asarray(r.ref_pos), {k: tuple(v) for k, v in dict(r.models).items()}, options)
                    rows.append(own | found | {"error_message": None})
                except ValueError as e:
                    rows.append(own | {"status": "error", "error_message": str(e)})
            names = [*keys, *(part.split(" ")[0].strip("`") for part in BOUNDARY.split(", "))]
            yield pd.DataFrame(rows, columns=names)

    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + BOUNDARY
    return spread(joined.select(*keys, "mean", "std", "start_sample", "end_sample", "am", "asd", "ref_pos", "models")).mapInPandas(run, ddl)


#: Cells (steps of all traces times states) from which the fit of a group is dealt over tasks.
GROUP_CELLS = 1 << 18


def fit_profile_hmms(traces: DataFrame, group: str, *, normalise: bool = True, min_std: float = 1e-3, tol: float = 1e-4, max_iter: int = 20, group_cells: int = GROUP_CELLS, **options) -> DataFrame:
    """One profile HMM for each group, from the medoid of Gaussian warping distances on, with the settings of the fit.

    A task fits a group of up to `group_cells` cells; larger groups are fitted together, each round over all their traces (`em`), with the
    same result but for rounding.
    """
    for name, value in (("max_iter", max_iter), *((k, options[k]) for k in ("min_depth",) if k in options)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} is a positive whole number")
    kind = dict(traces.dtypes)[group]
    settings = {"min_std": min_std, "tol": tol, "max_iter": max_iter, "min_depth": options.get("min_depth", 2), "pseudocount": float(options.get("pseudocount", 1.0)), "normalise": normalise}

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trace_id")
        ready = [(*prepare(m, s, normalise, min_std), np.asarray(d, float)) for m, s, d in zip(frame["mean"], frame["std"], frame["dwell"])]
        medoid = medoid_of(pair_matrix([r[0] for r in ready], [r[1] for r in ready]))
        p = H.fit(ready, medoid, min_std=min_std, tol=tol, max_iter=max_iter, **options)
        return pd.DataFrame([{group: frame[group].iloc[0], **_hmm_row(p, int(frame["trace_id"].iloc[medoid]), settings)}])

    rows = traces.select(group, "trace_id", "mean", "std", "dwell")
    size = F.size("mean").cast("double")
    large = rows.groupBy(group).agg((F.sum(size) * F.max(size)).alias("cells")).where(F.col("cells") > group_cells).select(group)
    named = [r[0] for r in large.limit(em.MOST_GROUPS + 1).collect()]
    ddl = f"{group} {kind}, {PROFILE_HMM}"
    if not named or len(named) > em.MOST_GROUPS:  # so many groups keep all tasks busy by themselves
        return spread(rows, group).groupBy(group).applyInPandas(fit, ddl)
    names = F.broadcast(traces.sparkSession.createDataFrame([(g,) for g in named], f"{group} {kind}"))
    found = em.fit_large(em.prepared(rows.join(names, group, "left_semi"), group, normalise, min_std), group, min_std=min_std, tol=tol, max_iter=max_iter, **options)
    fitted = profile_rows(traces.sparkSession, found, group, kind, settings)
    return fitted.unionByName(spread(rows.join(names, group, "left_anti"), group).groupBy(group).applyInPandas(fit, ddl))


def _hmm_row(p: H.Profile, medoid_id: int, settings: dict) -> dict:
    row = {c: getattr(p, c).tolist() for c in ("mean", "std", "dwell", "stderr", "depth", "supported", "offsets", "weights")}
    return row | settings | {"medoid_id": medoid_id, "n_iter": p.n_iter, "converged": p.converged, "cap_hit": not p.converged, "stop_reason": p.stop_reason, "log_likelihood": p.log_likelihood, "final_log_likelihood": p.log_likelihood[-1], "history": p.history}


def fits_of(profiles: DataFrame, group: str, most: int = em.MOST_GROUPS) -> dict:
    """{group: (medoid's id, Profile)} of a table of fits, as `em` takes them to go on or to go back; `most` groups at most."""
    rows = profiles.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many fits for one table: take them in parts")
    out = {}
    for r in rows:
        arrays = {c: np.array(r[c]) for c in ("mean", "std", "dwell", "offsets", "weights", "stderr", "depth", "supported")}
        history = [{k: list(v) if isinstance(v, (list, tuple)) else v for k, v in h.asDict().items()} for h in r["history"]]
        out[r[group]] = r["medoid_id"], H.Profile(**arrays, medoid=-1, n_iter=r["n_iter"], converged=r["converged"], log_likelihood=list(r["log_likelihood"]), history=history)
    return out


def profile_rows(spark: SparkSession, fits: dict, group: str, kind: str, settings: dict) -> DataFrame:
    """A table of fits: the group and the columns of PROFILE_HMM."""
    schema = StructType.fromDDL(f"{group} {kind}, {PROFILE_HMM}")
    rows = [{group: g, **_hmm_row(p, int(m), settings)} for g, (m, p) in fits.items()]
    return spark.createDataFrame([tuple(row[c] for c in schema.names) for row in rows], schema)


def _settings(profiles: DataFrame) -> dict:
    names = ("min_std", "tol", "max_iter", "min_depth", "pseudocount", "normalise")
    found = profiles.select(*names).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("fits of one table have the same settings")
    return found[0].asDict()


def resume_profile_hmms(traces: DataFrame, profiles: DataFrame, group: str, max_iter: int) -> DataFrame:
    """Fits that go on from where they stopped, until max_iter rounds in all: the same as if they had not stopped."""
    settings = _settings(profiles) | {"max_iter": max_iter}
    fits = fits_of(profiles, group)
    ready = em.prepared(traces, group, settings["normalise"], settings["min_std"])
    offsets = next((p.offsets for _, p in fits.values()), H.OFFSETS)
    more = em.fit_large(ready, group, fits=fits, offsets=offsets, **{k: settings[k] for k in ("min_std", "tol", "max_iter", "min_depth", "pseudocount")})
    return profile_rows(traces.sparkSession, more, group, dict(traces.dtypes)[group], settings)


def snapshot_profile_hmms(traces: DataFrame, profiles: DataFrame, group: str, k: int) -> DataFrame:
    """Fits as they were after exactly k updates; their likelihoods are found again from the traces, and must be those of the fits."""
    settings = _settings(profiles)
    ready = em.prepared(traces, group, settings["normalise"], settings["min_std"])
    back = em.snapshots(ready, group, fits_of(profiles, group), k, settings["min_depth"], settings["min_std"])
    return profile_rows(traces.sparkSession, back, group, dict(traces.dtypes)[group], settings)


def hmm_iterations(profiles: DataFrame, group: str) -> DataFrame:
    """(group, iter, log_likelihood, deltas, objectives and parameters): the history of fits as rows."""
    rows = profiles.select(group, F.posexplode("history").alias("k", "h"), "log_likelihood")
    return rows.select(group, (F.col("k") + 1).cast("long").alias("iter"), F.get("log_likelihood", F.col("k") + 1).alias("log_likelihood"), "h.*")


def score_against(traces: DataFrame, profiles: DataFrame, label: str, kind: str = "warp", *, normalise: bool = True, min_std: float = 1e-3, cost: str = "gaussian", most: int = 100_000, **options) -> DataFrame:
    """(trace_id, label, score) of every trace against every profile: warping distance (lower is better, infinity where no
    path is admissible) or the profile HMM's log-likelihood (higher is better).

    Profiles are a small table; their number is checked before they go to every task.
    """
    if kind not in ("warp", "hmm"):
        raise ValueError(f"score {kind!r}")
    rows = profiles.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("too many profiles for one table: score them in parts")
    sent = traces.sparkSession.sparkContext.broadcast(rows)
    label_type = dict(profiles.dtypes)[label]

    def run(frames):
        table = sent.value
        models = []
        for p in table.itertuples(index=False):
            m, s = np.asarray(p.mean, float), np.asarray(p.std, float)
            if kind == "warp" and hasattr(p, "supported"):
                ok = np.asarray(p.supported, bool) & np.isfinite(m) & np.isfinite(s)
                m, s = m[ok], s[ok]
            models.append((getattr(p, label), m, s, p))
        for frame in frames:
            ready = [prepare(m, s, normalise, min_std) for m, s in zip(frame["mean"], frame["std"])]
            out = []
            for name, m, s, p in models:
                if kind == "hmm":
                    score = H.score_reads(ready, m, s, p.offsets, p.weights)
                else:
                    score = np.full(len(ready), np.inf)
                    step = max(1, 2_000_000 // (max(len(m), 1) * max((len(r[0]) for r in ready), default=1)))
                    for k in range(0, len(ready) if len(m) else 0, step):
                        part = ready[k : k + step]
                        w = K.warp_pairs(cost, [r[0] for r in part], [r[1] for r in part], [m] * len(part), [s] * len(part), **options)
                        score[k : k + step] = w.norm
                out.append(pd.DataFrame({"trace_id": frame["trace_id"], "label": name, "score": score}))
            yield pd.concat(out) if out else pd.DataFrame({"trace_id": [], "label": [], "score": []})

    return spread(traces.select("trace_id", "mean", "std")).mapInPandas(run, f"trace_id long, label {label_type}, score double")


def align_profiles(pairs: DataFrame, profiles: DataFrame, label: str) -> DataFrame:
    """Of pairs (a, b) of profiles: distance, rmse, mae, r and warp deviation along the squared-difference warp."""
    x = profiles.select(F.col(label).alias("a"), F.col("mean").alias("am"))
    y = profiles.select(F.col(label).alias("b"), F.col("mean").alias("bm"))
    kind = dict(profiles.dtypes)[label]

    def run(frames):
        for frame in frames:
            rows = []
            for a, b, am, bm in zip(frame["a"], frame["b"], frame["am"], frame["bm"]):
                am, bm = np.asarray(am, float), np.asarray(bm, float)
                w = K.Warp(K.cost_grid("l2", am, am, bm, bm)[None], path=True)
                if not np.isfinite(w.dist[0]):
                    rows.append((a, b, np.inf, None, None, None, None))
                    continue
                p = w.path(0)
                u, v = am[p[:, 0]], bm[p[:, 1]]
                r = float(np.corrcoef(u, v)[0, 1]) if u.std() > 0 and v.std() > 0 else None
                shift = np.abs(p[:, 0] / max(len(am) - 1, 1) - p[:, 1] / max(len(bm) - 1, 1))
                rows.append((a, b, float(np.sqrt(w.norm[0])), float(np.sqrt(((u - v) ** 2).mean())), float(np.abs(u - v).mean()), r, float(shift.mean())))
            yield pd.DataFrame(rows, columns=["a", "b", "distance", "rmse", "mae", "r", "warp_deviation"])

    return spread(pairs.join(x, "a").join(y, "b").select("a", "b", "am", "bm")).mapInPandas(run, f"a {kind}, b {kind}, distance double, rmse double, mae double, r double, warp_deviation double")


def hmm_gates(profiles: DataFrame, group: str, n_reads: DataFrame) -> DataFrame:
    """(group, accepted, reasons): a fit is accepted if it converged to its tolerance, its trace is whole and hardly ever fell, all is finite,
    its weights are within bounds and sum to one and every state has a move, enough positions are supported without long gaps,
    and the stds (against the floor of the fit) and dwells of supported positions are sane."""
    p = profiles.join(n_reads, group)
    depth_needed = F.greatest(F.lit(2), F.ceil(F.col("n_reads") / 2))
    n = F.size("mean")
    supported = F.transform("depth", lambda d: d >= depth_needed)
    share = F.size(F.filter(supported, lambda s: s)) / n
    gaps = F.split(F.concat_ws("", F.transform(supported, lambda s: F.when(s, "1").otherwise("0"))), "1", -1)
    inner = F.coalesce(F.array_max(F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps) - 2, F.lit(0))), F.length)), F.lit(0))
    terminal = F.greatest(F.length(F.element_at(gaps, 1)), F.length(F.element_at(gaps, -1)))
    fell = F.exists(F.sequence(F.lit(1), F.size("log_likelihood") - 1), lambda k: (F.get("log_likelihood", k - 1) - F.get("log_likelihood", k)) / F.greatest(F.lit(1.0), F.abs(F.get("log_likelihood", k - 1))) > 1e-3)
    floor = F.size(F.filter("std", lambda s: s <= F.col("min_std") * (1 + 1e-9))) / n
    wild = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    last = F.element_at("history", -1)
    dwells = F.transform(F.filter(F.arrays_zip("dwell", supported.alias("ok")), lambda x: x["ok"]), lambda x: x["dwell"])
    legal = lambda i: F.exists(F.arrays_zip("offsets", "weights"), lambda m: (i + m["offsets"] >= 0) & (i + m["offsets"] < n) & (m["weights"] > 0))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    checks = {
        "not converged": ~F.col("converged"),
        "the last change is above the tolerance": F.col("converged") & (last["delta"] > F.col("tol")),
        "the trace has not a likelihood for each update": (F.size("log_likelihood") != F.col("n_iter") + 1) | (F.size("history") != F.col("n_iter")),
        "a parameter is not finite": wild("mean") | wild("std") | wild("dwell") | wild("weights"),
        "a likelihood is not finite": wild("log_likelihood"),
        "a change is not finite": F.exists("history", lambda h: h["delta"].isNull() | F.isnan(h["delta"]) | (h["delta"] == float("inf"))),
        "an objective fell": F.exists("history", lambda h: (h["emission_after"] < h["emission_before"] - 1e-6 * F.abs(h["emission_before"])) | (h["gradient"] > 1e-8)),
        "channels of different lengths": (F.size("std") != n) | (F.size("dwell") != n) | (F.size("depth") != n) | (F.size("supported") != n),
        "a state without a move": ~F.forall(F.sequence(F.lit(0), n - 1), legal),
        "likelihood fell": fell,
        "a weight is out of bounds": F.exists("weights", lambda w: (w < 1e-3) | (w > 0.995)),
        "weights don't sum to one": F.abs(total - 1) > 1e-10,
        "too few positions supported": share < 0.8,
        "a gap inside": inner > 3,
        "a gap at an end": terminal > F.ceil(0.1 * n),
        "stds at their floor": floor > 0.25,
        "dwells too uneven": F.coalesce(F.array_max(dwells) > 100 * F.array_min(dwells), F.lit(False)),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return p.select(group, (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))

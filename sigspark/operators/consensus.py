"""Consensus profiles of trace groups: weighted warping barycentres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import kernels as K
from .spread import spread

PROFILE = "mean array<double>, std array<double>, dwell array<double>, depth array<long>, supported array<boolean>, iterations long, converged boolean, objective array<double>, medoid_id long"


def prepare(mean, std, normalise: bool, floor: float):
    """Robust scaling (scale <= 0 or not finite counts as 1) and a floor under the std."""
    mean, std = np.asarray(mean, float), np.asarray(std, float)
    if normalise:
        m, s = K.robust(mean)
        s = s if np.isfinite(s) and s > 0 else 1.0
        mean, std = (mean - m) / s, std / s
    return mean, np.maximum(std, floor)


def pair_matrix(means, stds, **options) -> np.ndarray:
    """Symmetric matrix of normalised Gaussian warping distances of prepared reads."""
    n = len(means)
    d = np.zeros((n, n))
    i, j = np.triu_indices(n, 1)
    step = max(1, 2_000_000 // max(1, max(map(len, means)) ** 2))
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        w = K.warp_pairs("gaussian", [means[x] for x in a], [stds[x] for x in a], [means[x] for x in b], [stds[x] for x in b], **options)
        d[a, b] = d[b, a] = w.norm
    return d


def medoid_of(distances: np.ndarray) -> int:
    """The read of the least sum of distances, the first of a tie: sums are exact, so that equal reads tie."""
    return int(np.argmin([math.fsum(row) for row in distances]))


def barycentre(means, stds, dwells, *, medoid: int | None = None, distances=None, max_iter=10, tol=1e-4, min_depth=2, min_std=1e-3, counts=None, **options) -> dict:
    """Iterated weighted averages of the reads along their warps onto the profile, from the medoid on.

    The cost is the squared difference times the read's precision 1 / max(std^2, min_std^2); a position's mean and dwell are
    precision-weighted, its std adds the spread of the reads to the error of the mean. Positions without a read stay. A read
    counts as if it stood `counts` times among the reads.
    """
    from .refits import position_sums

    if medoid is None:
        medoid = medoid_of(pair_matrix(means, stds) if distances is None else distances)
    if not 0 <= medoid < len(means):
        raise ValueError("the medoid is one of the reads")
    mean, std, dwell = means[medoid].copy(), np.maximum(stds[medoid], min_std), dwells[medoid].copy()
    size = len(mean)
    weight = [1 / np.maximum(s * s, min_std * min_std) for s in stds]
    times = np.ones(len(means), np.int64) if counts is None else np.asarray(counts)
    objective, converged, depth = [], False, np.zeros(size, np.int64)
    lengths = np.array([len(m) for m in means])
    wide = K.pad(means, 0.0)
    wide_w = K.pad(weight, 1.0)
    wide_d = K.pad(dwells, 0.0)
    for round_ in range(max_iter):
        warp = K.Warp(K.CostRows("weighted", wide, wide_w, np.broadcast_to(mean, (len(wide), size))), lengths, path=True, **options)
        if not np.isfinite(warp.dist).all():
            raise ValueError("a read has no admissible warp onto the profile")
        objective.append(float(warp.norm @ times))
        sw, sx, sxx, sd, depth = position_sums(warp, wide, wide_w, wide_d, times, size)
        depth = depth.astype(np.int64)
        seen = sw > 0
        new = np.where(seen, sx / np.where(seen, sw, 1), mean)
        spread = np.maximum(sxx / np.where(seen, sw, 1) - new * new, 0) + 1 / np.where(seen, sw, 1)
        std = np.where(seen, np.maximum(np.sqrt(spread), min_std), std)
        dwell = np.where(seen, sd / np.where(seen, sw, 1), dwell)
        delta = float(np.abs(new - mean).max())
        mean = new
        if delta <= tol:
            converged = True
            break
    return {"mean": mean, "std": std, "dwell": dwell, "depth": depth, "supported": depth >= min_depth, "iterations": len(objective), "converged": converged, "objective": objective, "medoid": medoid}


#: Cells (steps of all traces times positions) from which the fit of a group is dealt over tasks.
GROUP_CELLS = 1 << 18


def fit_barycentres(traces: DataFrame, group: str, *, normalise: bool = True, min_std: float = 1e-3, min_depth: int | None = 2, group_cells: int = GROUP_CELLS, **options) -> DataFrame:
    """One profile per group: group and the PROFILE columns. min_depth None asks for half of the reads.

    A task fits a group of up to `group_cells` cells; larger groups are fitted together, each round over all their traces (`refits`), with
    the same result but for rounding.
    """
    from . import em, refits

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trace_id")
        ready = [prepare(m, s, normalise, min_std) for m, s in zip(frame["mean"], frame["std"])]
        depth = max(2, -(-len(ready) // 2)) if min_depth is None else min_depth
        b = barycentre([r[0] for r in ready], [r[1] for r in ready], [np.asarray(d, float) for d in frame["dwell"]], min_depth=depth, min_std=min_std, **options)
        b["medoid_id"] = int(frame["trace_id"].iloc[b.pop("medoid")])
        return pd.DataFrame([{group: frame[group].iloc[0], **{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in b.items()}}])

    kind = dict(traces.dtypes)[group]
    rows, ddl = traces.select(group, "trace_id", "mean", "std", "dwell"), f"{group} {kind}, {PROFILE}"
    size = F.size("mean").cast("double")
    large = rows.groupBy(group).agg((F.sum(size) * F.max(size)).alias("cells")).where(F.col("cells") > group_cells).select(group)
    named = [r[0] for r in large.limit(em.MOST_GROUPS + 1).collect()] if "medoid" not in options else []
    if not named or len(named) > em.MOST_GROUPS:  # so many groups keep all tasks busy by themselves
        return spread(rows, group).groupBy(group).applyInPandas(fit, ddl)
    names = F.broadcast(traces.sparkSession.createDataFrame([(g,) for g in named], f"{group} {kind}"))
    found = refits.fit_rounds(em.prepared(rows.join(names, group, "left_semi"), group, normalise, min_std), group, min_std=min_std, min_depth=min_depth, **options)
    schema = StructType.fromDDL(ddl)
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    fitted = traces.sparkSession.createDataFrame([(g, *(plain(m[c]) for c in schema.names[1:])) for (g, _), m in found.items()], schema)
    return fitted.unionByName(spread(rows.join(names, group, "left_anti"), group).groupBy(group).applyInPandas(fit, ddl))

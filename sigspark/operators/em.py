"""Profile HMM fits of groups of any size: expectation where the traces are, maximisation by state.

A round is one job over the traces of all groups that still change. Its tasks run forward-backward on their traces and add up, for each
group and state, the occupancy, dwell, precision, depth and moves. What the emission step needs is the squared difference of every
step from the state, weighted by the posterior, for each variance of a step: steps of one variance count by three sums. So
tasks emit (group, state, variance) with those sums, Spark adds them, and the new levels and variances of a block of states are found from
their own rows. No task holds a group, and a round brings back one row for each state.

A step counts at the NODES Chebyshev nodes of the range that its variance is in, by the weights of interpolation: what the emission step
sums is smooth in the variance, so this is as exact as rounding (some 1e-13), and the rows of a state are some 44 for each doubling of the
variance, however many traces there are. Fits do so whatever their size. Without nodes, variances are told apart by their exponent and
KEY_BITS bits of their fraction, and sums carry their weighted mean; only steps that share those bits are not exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profile_hmm as H
from ..sources.io import cut
from .consensus import prepare
from .pairs import row_sums
from .spread import spread, tasks_for

#: Bits of a variance's fraction that are kept apart.
KEY_BITS = 16
#: Nodes of a range of variances, and ranges of a doubling as a power of two.
NODES, RANGE_BITS = 11, 2
#: Cells (steps times states) of posteriors that are held at once, and those of a task.
BATCH_CELLS, TASK_CELLS = 300_000, 20_000_000
#: Rows of sums of all groups that a task holds before it hands them on.
HELD_ROWS = 300_000
#: States of a group that are maximised at once.
STATES = 64
#: Groups that are fitted together at most: their profiles are held on the driver and sent to tasks.
MOST_GROUPS = 1000

_SUMS = ("v0", "v1", "v2", "v3")


def prepared(traces: DataFrame, group: str, normalise: bool, min_std: float) -> DataFrame:
    """(group, trace_id, mean, std, dwell, n): scaled traces with floored stds, kept for all rounds."""

    def run(frames):
        for frame in frames:
            ready = [prepare(m, s, normalise, min_std) for m, s in zip(frame["mean"], frame["std"])]
            yield frame.assign(mean=[r[0] for r in ready], std=[r[1] for r in ready], n=[len(r[0]) for r in ready])

    kinds = dict(traces.dtypes)
    rows = traces.select(group, "trace_id", "mean", "std", "dwell")
    return cut(rows.mapInPandas(run, f"{group} {kinds[group]}, trace_id {kinds['trace_id']}, mean array<double>, std array<double>, dwell array<double>, n long"))


def _ranges(v: np.ndarray, bits: int) -> np.ndarray:
    """The ranges that variances are in: exponent and so many bits of the fraction."""
    return np.ascontiguousarray(v, np.float64).view(np.int64) >> (52 - bits)


def _ends(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((np.asarray(ranges, np.int64) + k << 52 - RANGE_BITS).view(np.float64) for k in (0, 1))


def node_variances(keys: np.ndarray) -> np.ndarray:
    """The variances of keys (range times NODES plus node)."""
    lo, hi = _ends(keys // NODES)
    return lo + (hi - lo) * (1 + np.cos((keys % NODES + 0.5) * np.pi / NODES)) / 2


def node_weights(v: np.ndarray) -> np.ndarray:
    """[variance, node]: the weights by which values at the nodes of each variance's range give that at the variance."""
    lo, hi = _ends(_ranges(v, RANGE_BITS))
    terms = np.polynomial.chebyshev.chebvander(2 * (v - lo) / (hi - lo) - 1, NODES - 1)
    at_nodes = np.cos(np.outer(np.arange(NODES), (np.arange(NODES) + 0.5) * np.pi / NODES))
    at_nodes[0] /= 2
    return terms @ at_nodes * (2 / NODES)


class _Sums:
    """What a task adds up of one group; of the emission step, by ranges of variances: [node, sum, state], a range without nodes having one."""

    def __init__(self, size: int, moves: int, nodes: bool = False):
        self.likelihood, self.steps, self.nodes = 0.0, 0, nodes
        self.states = np.zeros((size, 4 + moves))  # occupancy, dwell, precision, depth, moves
        self.parts: dict[int, np.ndarray] = {}

    def add(self, x, xs, dwell, mean, std, moves, offsets) -> None:
        e = H.expectation(x, xs, mean, std, moves, offsets)
        self.likelihood += float(e["log_likelihood"].sum())
        self.steps += x.size
        gamma, counted = e["gamma"], np.stack([np.ones_like(x), x, x * x, dwell], axis=1)
        if (xs == xs[:, :1]).all():  # steps of one variance are added up first
            v, sums = xs[:, 0] ** 2, counted @ gamma
        else:
            v = xs.ravel() ** 2
            sums = np.moveaxis(counted, 1, 2).reshape(-1, 4, 1) * gamma.reshape(-1, 1, len(mean))
        s0, s1, s2, times = np.moveaxis(sums, 1, 0)
        precision = (s0 / (v[:, None] + std**2)).sum(axis=0)
        depth = np.minimum(gamma.sum(axis=1), 1.0).sum(axis=0)
        self.states += np.column_stack([s0.sum(axis=0), times.sum(axis=0), precision, depth, e["counts"]])
        sums = np.stack([s0, s1 - mean * s0, s2 - 2 * mean * s1 + mean * mean * s0, v[:, None] * s0], axis=1)
        ranges = _ranges(v, RANGE_BITS if self.nodes else KEY_BITS)
        order = np.argsort(ranges, kind="stable")
        sums, ranges = sums[order].reshape(len(v), -1), ranges[order]
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        if self.nodes:
            weights = node_weights(v[order]).T
            added = [weights[:, a:b] @ sums[a:b] for a, b in zip(first, [*first[1:], len(v)])]
        else:
            added = np.add.reduceat(sums, first, axis=0)
        for key, own in zip(ranges[first].tolist(), added):
            held = self.parts.get(key)
            self.parts[key] = own.reshape(-1, 4, len(mean)) if held is None else held + own.reshape(held.shape)

    @property
    def held(self) -> int:
        return len(self.parts) * len(self.states) * (NODES if self.nodes else 1)

    def taken(self) -> np.ndarray:
        """The rows (state, key, four sums) by variance, which are held no longer."""
        if not self.parts:
            return np.zeros((0, 6))
        keys = np.array(list(self.parts))
        if self.nodes:
            keys = (keys[:, None] * NODES + np.arange(NODES)).ravel()
        sums, self.parts = np.concatenate(list(self.parts.values())), {}
        k, state = np.nonzero(sums[:, 0] != 0)
        return np.column_stack([state, keys[k], sums[k, :, state]])

    def rows(self) -> np.ndarray:
        size, nothing = len(self.states), np.zeros((len(self.states), 3))
        state = np.arange(size)
        out = [np.array([[-1.0, -1.0, self.likelihood, self.steps, 0.0, 0.0]]), np.column_stack([state, np.full(size, -1.0), self.states[:, :4]])]
        out += [np.column_stack([state, np.full(size, -2.0 - k), column, nothing]) for k, column in enumerate(self.states[:, 4:].T)]
        return np.concatenate([*out, self.taken()])


def _expect(models: dict, offsets: np.ndarray, group: str, nodes: bool = False):
    """Rows (group, state, key, v0..v3). Keys from 0 on are variances, or nodes of their ranges: sums of the posterior, of its products with the difference and the
    squared difference from the state's level, and with the variance. Key -1: occupancy, dwell, precision, depth; -2 - k: moves by the
    k-th offset; state -1: likelihood and number of steps. Rows of one group, state and key can come several times."""

    def framed(name, rows):
        return pd.DataFrame({group: [name] * len(rows), "state": rows[:, 0].astype(np.int64), "key": rows[:, 1].astype(np.int64)} | {c: rows[:, 2 + k] for k, c in enumerate(_SUMS)})

    def run(frames):
        totals: dict = {}
        for frame in frames:
            for name, own in frame.groupby(group, sort=True):
                mean, std, weights = models[name]
                sums = totals.setdefault(name, _Sums(len(mean), len(offsets), nodes))
                moves = H.band(len(mean), offsets, weights)
                reads = [tuple(np.asarray(x, float) for x in r) for r in zip(own["mean"], own["std"], own["dwell"])]
                for same in H.by_length(reads):
                    step = max(1, BATCH_CELLS // (len(mean) * len(reads[same[0]][0])))
                    for k in range(0, len(same), step):
                        sums.add(*(np.stack([reads[i][c] for i in same[k : k + step]]) for c in range(3)), mean, std, moves, offsets)
                        if sum(x.held for x in totals.values()) > HELD_ROWS:
                            yield from (framed(g, x.taken()) for g, x in totals.items() if x.held)
        for name, sums in totals.items():
            yield framed(name, sums.rows())

    return run


def _maximise(models: dict, offsets: np.ndarray, floor: float, group: str, nodes: bool = False):
    """Of the rows of a block of states, a row for each: its sums, its moves, its new level and variance, and the objective before and after;
    of state -1 the likelihood and the number of steps, as the first two sums."""

    def run(key, frame):
        own, place = np.unique(frame["state"].to_numpy(), return_inverse=True)
        at, v = frame["key"].to_numpy(), frame[list(_SUMS)].to_numpy()
        sums, moves, new = np.zeros((len(own), 4)), np.zeros((len(own), len(offsets))), np.zeros((len(own), 4))
        sums[place[at == -1]] = v[at == -1]
        moves[place[at < -1], -2 - at[at < -1]] = v[at < -1, 0]
        level, std = (np.where(own < 0, 1.0, m[np.maximum(own, 0)]) for m in models[key[0]][:2])
        new[:, 0], new[:, 1] = level, std**2
        keys, row = np.unique(at[at >= 0], return_inverse=True)
        grid = np.zeros((4, len(keys), len(own)))
        grid[:, row, place[at >= 0]] = v[at >= 0].T
        if len(keys):
            seen = np.unique(place[at >= 0])
            s0, s1, s2, sv = grid[:, :, seen]
            xv = np.broadcast_to(node_variances(keys)[:, None], s0.shape) if nodes else np.where(s0 > 0, sv, 1) / np.where(s0 > 0, s0, 1)
            new[seen] = np.column_stack(emission_step(s0, s1, s2, xv, level[seen], std[seen] ** 2, floor))
        return pd.DataFrame({group: [key[0]] * len(own), "state": own, "sums": list(sums), "moves": list(moves), "new": list(new)})

    return run


def emission_step(s0, s1, s2, xv, level, var, floor: float) -> tuple:
    """(level, variance, objective before, objective after) of a state from sums by the steps' variance xv: of the posterior (s0) and of
    its products with the difference from the level and its square (s1, s2); of many states from sums [variance, state]. Candidates and
    search as in `fit_emissions`."""

    def at(v, m=None):
        total = xv + v
        if m is None:
            m = (s1 / total).sum(axis=0) / (s0 / total).sum(axis=0)
        return -0.5 * (s0 * (np.log(2 * np.pi) + np.log(total)) + (s2 - 2 * m * s1 + m * m * s0) / total).sum(axis=0), m

    def slope(u):
        total = xv + np.exp(u)
        m = (s1 / total).sum(axis=0) / (s0 / total).sum(axis=0)
        return (((s2 - 2 * m * s1 + m * m * s0) / total - s0) / total).sum(axis=0)

    before = at(var, 0.0)[0]
    occupancy = s0.sum(axis=0)
    centre = s1.sum(axis=0) / occupancy
    wide = np.maximum(0.0, s2.sum(axis=0) / occupancy - centre * centre)
    hi = np.log(np.maximum(np.maximum(16 * floor, 4 * var), 4 * wide)) + np.log(4)
    lo = np.full_like(hi, np.log(floor))
    ratio = (np.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    at_a, at_b = at(np.exp(a))[0], at(np.exp(b))[0]
    for _ in range(H.SECTIONS):
        left = at_a >= at_b
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        kept, at_kept = np.where(left, a, b), np.where(left, at_a, at_b)
        new = np.where(left, hi - ratio * (hi - lo), lo + ratio * (hi - lo))
        at_new = at(np.exp(new))[0]
        a, at_a = np.where(left, new, kept), np.where(left, at_new, at_kept)
        b, at_b = np.where(left, kept, new), np.where(left, at_kept, at_new)
    variances = np.stack([np.full_like(hi, floor), np.broadcast_to(var, hi.shape), np.exp(H.polished(slope, (lo + hi) / 2))])
    values, levels = (np.stack(x) for x in zip(*map(at, variances)))
    best = values.argmax(axis=0)[None]
    value, new, var = (np.take_along_axis(x, best, 0)[0] for x in (values, levels, variances))
    return level + new, var, before, value


def medoids(ready: DataFrame, group: str) -> DataFrame:
    """(group, trace_id): of each group the trace with the least sum of Gaussian warping distances to all others, the least id of a tie.

    All pairs of a group are warped, in tiles that leave sums, so work grows with the square of a group.
    """
    sums = row_sums(ready, group, normalise=False)
    return sums.groupBy(group).agg(F.min_by("trace_id", F.struct("row_sum", "trace_id")).alias("trace_id"))


def fit_large(ready: DataFrame, group: str, *, max_iter: int = 20, tol: float = 1e-4, min_depth: int = 2, min_std: float = 1e-3, offsets=H.OFFSETS, weights=None, pseudocount: float = 1.0, start: DataFrame | None = None, fits: dict | None = None, most: int = MOST_GROUPS) -> dict:
    """{group: (medoid's id, Profile)} of a table of `prepared` traces, the same as `profile_hmm.fit` of each group.

    start (group, trace_id) names the traces to begin from, else the medoids; fits, a result of this function, goes on where that stopped
    (with its moves and offsets), until max_iter rounds in all. The groups' profiles (at most `most` of them) are all that
    is held on the driver and sent to tasks. A group that has converged takes no part in later rounds.
    """
    H.check_options(max_iter, min_depth, tol, min_std, pseudocount)
    offsets = H.check_offsets(offsets)
    now, out, medoid, trace, history = {}, {}, {}, {}, {}
    if fits is None:
        chosen = (medoids(ready, group) if start is None else start).select(group, "trace_id")
        rows = ready.join(chosen, [group, "trace_id"]).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("too many groups for fits of large groups: fit them a group a task")
        for r in rows:
            mean, std, dwell = (np.array(r[c], float) for c in ("mean", "std", "dwell"))
            w = H.start_weights(len(mean), offsets, pseudocount) if weights is None else np.asarray(weights, float) / np.sum(weights)
            H.legal(len(mean), offsets)
            g = r[group]
            now[g], medoid[g], trace[g], history[g] = (mean, np.maximum(std, min_std), dwell, w), r["trace_id"], [], []
    else:
        for g, (trace_id, p) in fits.items():
            if p.converged or p.n_iter >= max_iter:
                out[g] = trace_id, p
                continue
            if not np.array_equal(p.offsets, offsets):
                raise ValueError("a fit goes on with its own offsets")
            # the last likelihood is found again in the next round
            now[g], medoid[g], trace[g], history[g] = (p.mean, p.std, p.dwell, p.weights), trace_id, list(p.log_likelihood[:-1]), list(p.history)
    longest = max((len(p[0]) for p in now.values()), default=1)
    steps = ready.agg(F.sum("n")).first()[0] or 0
    dealt = cut(ready.repartition(tasks_for(ready.sparkSession, steps * longest, TASK_CELLS)))
    while now:
        models = {g: (p[0], p[1], p[3]) for g, p in now.items()}
        found = expect_and_maximise(dealt, models, offsets, min_std * min_std, group, True)
        for g in list(now):
            mean, std, dwell, w = now[g]
            e = found[g]
            trace[g].append(e["log_likelihood"])
            if not np.isfinite(e["log_likelihood"]):
                raise FloatingPointError("an update is not finite")
            done = bool(history[g]) and history[g][-1]["delta"] <= tol
            if done or len(history[g]) == max_iter:
                with np.errstate(divide="ignore"):
                    stderr = np.where(e["precision"] > 0, 1 / np.sqrt(e["precision"]), np.inf)
                out[g] = medoid[g], H.Profile(mean, std, dwell, offsets, w, stderr, e["depth"], e["depth"] >= min_depth, -1, len(history[g]), done, trace[g], history[g])
                del now[g]
                continue
            moved = H.fit_moves(e["moves"], H.legal(len(mean), offsets).T, w, pseudocount)
            if not moved["success"]:
                raise FloatingPointError("the move weights did not converge")
            active = e["occupancy"] > np.finfo(float).eps * max(1, e["steps"])
            new_mean, new_std = np.where(active, e["mean"], mean), np.where(active, np.sqrt(e["var"]), std)
            record = {
                "mean_delta": float(np.abs(new_mean - mean).max()),
                "std_delta": float(np.abs(new_std - std).max()),
                "transition_delta": float(np.abs(moved["weights"] - w).max()),
                "transition_before": moved["before"][0],
                "transition_after": moved["after"][0],
                "gradient": moved["gradient"],
                "emission_before": float(e["before"].sum()),
                "emission_after": float(np.where(active, e["after"], e["before"]).sum()),
            }
            record["delta"] = max(record["mean_delta"], record["std_delta"], record["transition_delta"])
            new_dwell = np.where(e["occupancy"] > 0, e["dwell"] / np.where(e["occupancy"] > 0, e["occupancy"], 1), dwell)
            now[g] = new_mean, new_std, new_dwell, moved["weights"]
            history[g].append(record | {"mean": new_mean.tolist(), "std": new_std.tolist(), "dwell": new_dwell.tolist(), "weights": moved["weights"].tolist()})
            if not np.isfinite(record["delta"]):
                raise FloatingPointError("an update is not finite")
    return out


def snapshots(ready: DataFrame, group: str, fits: dict, k: int, min_depth: int = 2, min_std: float = 1e-3) -> dict:
    """{group: (medoid's id, Profile)}: each fit as it was after exactly k updates, with its own depth, errors and support, from one round
    over the traces. A fit of fewer updates, or a likelihood that isn't the one the fit has noted, is an error."""
    models, offsets = {}, None
    for g, (_, p) in fits.items():
        if not 1 <= k <= len(p.history):
            raise ValueError(f"group {g} has no update {k}")
        models[g] = tuple(np.array(p.history[k - 1][c]) for c in ("mean", "std", "weights"))
        offsets = p.offsets
    found, out = expect_and_maximise(ready, models, offsets, min_std * min_std, group, True), {}
    for g, (trace_id, p) in fits.items():
        e, r = found[g], p.history[k - 1]
        if not np.isclose(e["log_likelihood"], p.log_likelihood[k], rtol=1e-10, atol=1e-8):
            raise FloatingPointError(f"the likelihood of group {g} is not that of its fit")
        with np.errstate(divide="ignore"):
            stderr = np.where(e["precision"] > 0, 1 / np.sqrt(e["precision"]), np.inf)
        mean, std, weights = models[g]
        out[g] = trace_id, H.Profile(mean, std, np.array(r["dwell"]), p.offsets, weights, stderr, e["depth"], e["depth"] >= min_depth, -1, k, p.converged and k == p.n_iter, p.log_likelihood[: k + 1], p.history[:k])
    return out


def expect_and_maximise(dealt: DataFrame, models: dict, offsets: np.ndarray, floor: float, group: str, nodes: bool = False) -> dict:
    """One round over the traces of the groups that models (group: level, std, weights) names: the likelihood, the sums of each state and
    what they make of it. A row for each state comes back."""
    kind = dict(dealt.dtypes)[group]
    names = dealt.sparkSession.createDataFrame([(g,) for g in models], f"{group} {kind}")
    rows = dealt.join(F.broadcast(names), group).select(group, "mean", "std", "dwell").mapInPandas(_expect(models, offsets, group, nodes), f"{group} {kind}, state long, key long, v0 double, v1 double, v2 double, v3 double")
    added = rows.groupBy(group, "state", "key").agg(*(F.sum(c).alias(c) for c in _SUMS))
    block = F.floor(F.greatest("state", F.lit(0)) / STATES).alias("block")
    states = spread(added.select("*", block), group, "block").groupBy(group, "block").applyInPandas(_maximise(models, offsets, floor, group, nodes), f"{group} {kind}, state long, sums array<double>, moves array<double>, new array<double>")
    found: dict = {}
    for r in sorted(states.collect(), key=lambda r: r["state"]):
        found.setdefault(r[group], []).append(r)
    out = {}
    for g, (head, *rest) in found.items():
        sums, new = np.array([r["sums"] for r in rest]).T, np.array([r["new"] for r in rest]).T
        out[g] = dict(zip(("occupancy", "dwell", "precision", "depth"), sums)) | dict(zip(("mean", "var", "before", "after"), new))
        out[g] |= {"log_likelihood": head["sums"][0], "steps": head["sums"][1], "moves": np.array([r["moves"] for r in rest])}
    return out

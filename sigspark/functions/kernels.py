"""Vectorised numpy kernels over batches: costs, run-capped time warping, Viterbi and forward-backward, change points, linkage."""

from __future__ import annotations

from math import comb

import numpy as np

LOG_2PI = float(np.log(2 * np.pi))
NEG = -np.inf


# --- costs -------------------------------------------------------------------------------------------------------------


def emission(xm, xs, em, es):
    """Gaussian log-density of observed levels under expected ones, with both variances: [..., N, L]."""
    v = xs[..., :, None] ** 2 + es[..., None, :] ** 2
    return -0.5 * (LOG_2PI + np.log(v) + (xm[..., :, None] - em[..., None, :]) ** 2 / v)


def cost_grid(kind, am, as_, bm, bs):
    """Costs [..., N, M] of a named kind, or of a function of batches of levels and stds (am, as, bm, bs) that gives them."""
    if callable(kind):
        grid = np.asarray(kind(am, as_, bm, bs), float)
        shape = (*am.shape, bm.shape[-1])
        if grid.shape != shape:
            raise ValueError(f"a cost has shape {grid.shape}, not {shape}")
        if not np.isfinite(grid).all():
            raise ValueError("a cost is not finite")
        return grid
    if kind == "gaussian":
        return -emission(am, as_, bm, bs)
    d = am[..., :, None] - bm[..., None, :]
    if kind == "l2":
        return d * d
    if kind == "abs":
        return np.abs(d)
    raise ValueError(f"cost {kind!r}")


class CostRows:
    """The costs of a batch of pairs, made a row at a time: levels and stds [pair, step] of both sides. Of kind `weighted` they are squared
    differences times what stands in the place of the first stds."""

    def __init__(self, kind: str, am, as_, bm, bs=None):
        if kind not in ("gaussian", "l2", "abs", "weighted"):
            raise ValueError(f"cost {kind!r}")
        self.kind, self.shape = kind, (*am.shape, bm.shape[1])
        self.am, self.bm = np.ascontiguousarray(am.T), np.ascontiguousarray(bm.T)
        self.scale = np.ascontiguousarray(as_.T) if kind in ("gaussian", "weighted") else None
        self.flat = None
        if kind == "gaussian":
            self.scale, self.square = self.scale**2, np.ascontiguousarray(bs.T) ** 2
            if (self.scale == self.scale[0]).all() and (self.square == self.square[0]).all():
                # a pair of one variance each has one logarithm, which is most of a cost
                v = self.scale[0] + self.square[0]
                self.flat = v, np.log(v) + LOG_2PI

    def row(self, i: int, lo: int, hi: int) -> np.ndarray:
        """[column, pair]: of step i the costs of columns lo to hi."""
        d = self.am[i] - self.bm[lo:hi]
        if self.kind == "abs":
            return np.abs(d, out=d)
        np.multiply(d, d, out=d)
        if self.kind == "weighted":
            d *= self.scale[i]
        elif self.flat:
            d /= self.flat[0]
            d += self.flat[1]
            d *= 0.5
        elif self.kind == "gaussian":
            v = self.scale[i] + self.square[lo:hi]
            d /= v
            np.log(v, out=v)
            v += LOG_2PI
            d += v
            d *= 0.5
        return d

    def diagonal(self, k: int, lo: int, hi: int) -> np.ndarray:
        """[step, pair]: of steps lo to hi the costs of the columns that make k with them."""
        own, other = slice(lo, hi), slice(k - hi + 1, k - lo + 1)
        d = self.am[own] - self.bm[other][::-1]
        if self.kind == "abs":
            return np.abs(d, out=d)
        np.multiply(d, d, out=d)
        if self.kind == "weighted":
            d *= self.scale[own]
        elif self.flat:
            d /= self.flat[0]
            d += self.flat[1]
            d *= 0.5
        elif self.kind == "gaussian":
            v = self.scale[own] + self.square[other][::-1]
            d /= v
            np.log(v, out=v)
            v += LOG_2PI
            d += v
            d *= 0.5
        return d


def robust(x: np.ndarray) -> tuple[float, float]:
    m = float(np.median(x))
    return m, 1.4826 * float(np.median(np.abs(x - m)))


# --- time warping ------------------------------------------------------------------------------------------------------


class Warp:
    """Distances of a batch of pairs from their costs, [pair, row, column] or `CostRows`, and on request the pointers of their paths."""

    def __init__(self, cost, na=None, nb=None, *, step="symmetric1", max_run=3, open_begin=False, open_end=False, path=False):
        if step not in ("symmetric1", "symmetric2"):
            raise ValueError(f"step pattern {step!r}")
        if max_run is not None and max_run < 0:
            raise ValueError("max_run is None or not negative")
        b, n, m = cost.shape
        if n == 0 or m == 0:
            raise ValueError("an empty cost grid")
        self.na = np.full(b, n) if na is None else np.asarray(na)
        self.nb = np.full(b, m) if nb is None else np.asarray(nb)
        self.runs = runs = int(max_run or 0)
        weight = 1 if step == "symmetric1" else 2
        self.open_begin = open_begin
        self.dist, self.length, self.j_start, self.j_end, self.state = np.full(b, np.inf), np.zeros(b, np.int64), np.zeros(b, np.int64), np.zeros(b, np.int64), np.zeros(b, np.int64)
        if runs:
            self._capped(cost, weight, open_begin, open_end, path)
        else:
            self._uncapped(cost, weight, open_begin, open_end, path)
        self._normalise(weight)

    def _uncapped(self, cost, weight: int, open_begin: bool, open_end: bool, path: bool) -> None:
        """The form without a cap, by diagonals: no cell of one needs another of it. Arrays are (row + 1, pair), a row of infinity before the first;
        beside its cost a cell has a note as in the capped form. With `path` the moves chosen are kept: 0 diagonal, 1 down, 2 right, -1 none.
        """
        b, n, m = cost.shape
        most = m * m - 1 if open_begin else m - 1
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        self.pointers = np.full((n + m - 1, n, b), -1, np.int8) if path else None
        # a cell beyond the grid is never written, so it stays infinite
        now, last, before = ((np.full((n + 1, b), np.inf), np.zeros((n + 1, b), kind)) for _ in range(3))
        spaces, r = (np.empty((n, b)), np.empty((n, b), bool), np.empty((n, b), kind), np.empty((n, b), kind)), np.arange(b)
        for k in range(n + m - 1):
            lo, hi = max(0, k - m + 1), min(n, k + 1)
            c = cost.diagonal(k, lo, hi) if isinstance(cost, CostRows) else cost[:, np.arange(lo, hi), k - np.arange(lo, hi)].T
            value, less, other, mask = (x[: hi - lo] for x in spaces)
            up, own = slice(lo, hi), slice(lo + 1, hi + 1)
            d, note = now[0][own], now[1][own]
            np.add(before[0][up], c if weight == 1 else weight * c, out=d)
            note[:] = before[1][up]
            if path:
                point = self.pointers[k, lo:hi]
                point[np.isfinite(d)] = 0
            for code, source, step in ((1, (last[0][up], last[1][up]), 0), (2, (last[0][own], last[1][own]), 1)):
                np.add(source[0], c, out=value)
                if step and open_begin and lo == 0:
                    value[0] = np.inf  # a path begins in any column of the first row, and doesn't go along it
                np.less(value, d, out=less)
                np.copyto(mask, less)
                np.minimum(value, d, out=d)
                np.subtract(source[1], note, out=other)
                if step:
                    other += 1
                np.multiply(other, mask, out=other)
                note += other
                if path:
                    point[less] = code
            if lo == 0 and (k == 0 or open_begin):
                d[0], note[0] = weight * c[0], k * m if open_begin else 0
            j = k - (self.na - 1)
            at = (j >= 0) & (j < self.nb) if open_end else j == self.nb - 1
            at &= (self.na > lo) & (self.na <= hi)
            if at.any():
                found = now[0][self.na, r]
                at &= found < self.dist
                self.dist[at], self.j_end[at] = found[at], j[at]
                notes = now[1][self.na[at], r[at]].astype(np.int64)
                self.j_start[at], steps = (notes // m, notes % m) if open_begin else (0, notes)
                self.length[at] = self.na[at] + steps
            now, last, before = before, now, last

    def _normalise(self, weight: int) -> None:
        span = self.j_end - self.j_start + 1
        with np.errstate(invalid="ignore"):
            self.norm = self.dist / np.where(np.isfinite(self.dist), self.length if weight == 1 else self.na + span, 1)

    def _capped(self, cost, weight: int, open_begin: bool, open_end: bool, path: bool) -> None:
        """The capped form: each state of a row has one kind of source, so rows are plain array sums. Only three states choose among sources
        (the diagonal, and the first of a vertical and of a horizontal run); with `path` these choices are kept in place of lengths.

        Arrays are (column, pair), so that a step to the right is the next row of an array. Beside its cost each state has a note:
        with `path` the code of the state chosen, else the steps to the right, plus m times the first column if the begin is open.
        Capped runs let a path reach some columns of a row only (`_reach`), and others are left out.
        """
        b, n, m = cost.shape
        runs = self.runs
        self.choice = np.zeros((n, 3, m, b), np.int8) if path else None
        most = 2 * runs if path else m * m - 1 if open_begin else m - 1
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        spaces = np.empty((m, b), bool), np.empty((m, b), kind), np.empty((m, b), kind)
        lows, highs = self._reach(n, m, open_begin, open_end)

        def nothing():
            return np.full((m, b), np.inf), np.zeros((m, b), kind)

        def better(x, y, out):
            """The lesser of two states with its note, the first of a tie; `out` may be the first."""
            np.less(y[0][own], x[0][own], out=less)
            np.minimum(x[0][own], y[0][own], out=out[0][own])
            np.copyto(mask, less)
            np.subtract(y[1][own], x[1][own], out=other)
            np.multiply(other, mask, out=other)
            np.add(x[1][own], other, out=out[1][own])

        def right(x, c, out, step: int, open_left: bool):
            """A state one column on, from the columns of this row or with an open left from the one before them, too."""
            a = lo if open_left else lo + 1
            if not open_left:
                out[0][lo] = np.inf
            np.add(x[0][a - 1 : hi - 1], c[a - lo :], out=out[0][a:hi])
            if not path:
                if not open_left:
                    out[1][lo] = 0
                np.add(x[1][a - 1 : hi - 1], step, out=out[1][a:hi])

        # the diagonal, vertical and horizontal runs; the least of the diagonal and the vertical runs, of the horizontal ones, of all, and of
        # the diagonal and the horizontal ones. Columns to the right of a row's own are infinite in all of them.
        slant, *runs_down = (nothing() for _ in range(1 + runs))
        runs_across = [nothing() for _ in range(runs)]
        least, level, best, below = (nothing() for _ in range(4))
        before = 0
        for i in range(n):
            lo, hi = int(lows[i]), int(highs[i])
            if hi <= lo:
                break  # no path of any pair gets further
            own = slice(lo, hi)
            less, other, mask = (x[own] for x in spaces)
            c = cost.row(i, lo, hi) if isinstance(cost, CostRows) else np.ascontiguousarray(cost[:, i, own].T)
            if i == 0:
                at = slice(None) if open_begin else slice(0, 1)
                np.multiply(c[at], weight, out=slant[0][own][at])
                if open_begin and not path:
                    slant[1][own] = (np.arange(lo, hi) * m)[:, None]
            else:
                if path:
                    first = max(lo, 1)
                    self.choice[i, 0, first:hi], self.choice[i, 1, own] = best[1][first - 1 : hi - 1], below[1][own]
                right(best, c if weight == 1 else weight * c, slant, 0, lo > before)
                # a vertical run grows by a step, and the first of one takes what was chosen for it
                runs_down, below = [below, *runs_down[:-1]], runs_down[-1]
                for x in runs_down:
                    np.add(x[0][own], c, out=x[0][own])
            if path:
                for code, x in enumerate((slant, *runs_down, *runs_across)):
                    x[1][own] = code
            source = slant
            for x in runs_down:
                better(source, x, least)
                source = least
            if i or not open_begin:
                source = least
                for x in runs_across:
                    right(source, c, x, 1, False)
                    source = x
                if path:
                    self.choice[i, 2, lo + 1 : hi] = least[1][lo : hi - 1]
            source = runs_across[0]
            for x in runs_across[1:]:
                better(source, x, level)
                source = level
            better(least, source, best)
            better(slant, source, below)
            before = lo
            done = np.flatnonzero(self.na - 1 == i)
            if len(done):
                value = best[0][own][:, done]
                if open_end:
                    j = lo + np.argmin(np.where(np.arange(lo, hi)[:, None] < self.nb[done], value, np.inf), axis=0)
                else:
                    j = self.nb[done] - 1
                inside = (j >= lo) & (j < np.minimum(hi, self.nb[done]))
                done, j = done[inside], j[inside]
                self.dist[done], self.j_end[done] = best[0][j, done], j
                note = best[1][j, done].astype(np.int64)
                if path:
                    self.state[done] = note
                else:
                    self.j_start[done], steps = (note // m, note % m) if open_begin else (0, note)
                    self.length[done] = np.where(np.isfinite(self.dist[done]), i + 1 + steps, 0)
        if path:
            self._trace()

    def _reach(self, n: int, m: int, open_begin: bool, open_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the columns, from low to high, that a path of any of the pairs can have there: between two diagonal steps it takes
        `runs` steps of one direction at most, so that neither side gets on more than runs + 1 steps in one of the other's."""
        each, i = self.runs + 1, np.arange(n)
        high = np.full(n, m) if open_begin else np.minimum(m, each * i + each)
        low = i // each
        left = np.maximum(self.na.max() - 1 - i, 0), np.maximum(self.na.min() - 1 - i, 0)
        high = np.minimum(high, self.nb.max() - left[1] // each)
        if not open_end:
            low = np.maximum(low, self.nb.min() - each * (left[0] + 1))
        return np.minimum(low, m), high

    def _trace(self) -> None:
        """All paths at once, from their ends: cells (step, pair), -1 beyond a path's begin."""
        runs, r = self.runs, np.arange(len(self.na))
        i, j, s = self.na.astype(np.int64) - 1, self.j_end.copy(), self.state.copy()
        live = np.isfinite(self.dist)
        rows, columns = [], []
        while live.any():
            rows.append(np.where(live, i, -1))
            columns.append(np.where(live, j, -1))
            self.length += live
            self.j_start = np.where(live, j, self.j_start)
            live = live & ((i > 0) | (s > 0))
            chooser = np.where(s == 0, 0, np.where(s == 1, 1, 2))
            source = np.where((s == 0) | (s == 1) | (s == runs + 1), self.choice[i, chooser, j, r], s - 1)
            i = np.where(live & (s <= runs), i - 1, i)
            j = np.where(live & ((s == 0) | (s > runs)), j - 1, j)
            s = np.where(live, source, s)
        self.rows, self.columns = (np.array(x).reshape(len(x), len(r)) for x in (rows, columns))

    def path(self, b: int) -> np.ndarray:
        """The (n, 2) cells of pair b, first to last."""
        if self.runs:
            n = int(self.length[b])
            return np.column_stack([self.rows[:n, b], self.columns[:n, b]])[::-1]
        i, j = int(self.na[b]) - 1, int(self.j_end[b])
        out = [(i, j)]
        while True:
            p = int(self.pointers[i + j, i, b])
            if p < 0:
                return np.array(out[::-1])
            if p == 0:
                i, j = i - 1, j - 1
            elif p == 1:
                i -= 1
            else:
                j -= 1
            out.append((i, j))


def pad(arrays: list[np.ndarray], fill: float) -> np.ndarray:
    out = np.full((len(arrays), max(map(len, arrays))), fill)
    for k, a in enumerate(arrays):
        out[k, : len(a)] = a
    return out


def warp_pairs(kind, am, as_, bm, bs, **options) -> Warp:
    """Warps lists of pairs of any lengths; padding cells cannot be reached from a pair's own cells."""
    na, nb = np.array([len(x) for x in am]), np.array([len(x) for x in bm])
    costs = cost_grid if callable(kind) else CostRows
    return Warp(costs(kind, pad(am, 0.0), pad(as_, 1.0), pad(bm, 0.0), pad(bs, 1.0)), na, nb, **options)


def warp_to(path: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Averages values over the path onto the target axis; NaN where no cell falls."""
    total, count = np.bincount(path[:, 1], values[path[:, 0]], n), np.bincount(path[:, 1], minlength=n)
    with np.errstate(invalid="ignore"):
        return np.where(count > 0, total / np.maximum(count, 1), np.nan)


# --- hidden Markov models ----------------------------------------------------------------------------------------------


def jump_pmf(pstep=0.9, phold=0.05, pmiss=0.1, kmax=10, tol=1e-12) -> np.ndarray:
    """P(net jump = k), k from -kmax to kmax: one observed step and a geometric number of missed ones, each forward
    with pstep or else backward, mixed with a hold; a jump of nothing takes two steps at least. Scaled to one."""
    p = np.zeros(2 * kmax + 1)
    # the chance of n steps falls by pmiss with each: those of tol and more
    most = 1
    while pmiss > 0 and pmiss**most >= tol:
        most += 1
        if pmiss >= 1:
            raise ValueError("pmiss is under one")
    for k in range(-kmax, kmax + 1):
        for n in range(abs(k) or 2, most + 1, 2):
            f = (n + k) // 2
            p[k + kmax] += pmiss ** (n - 1) * (1 - pmiss) * comb(n, f) * pstep**f * (1 - pstep) ** (n - f)
    p *= 1 - phold
    p[kmax] += phold
    return p / p.sum()


def log_transition(length: int, **params) -> np.ndarray:
    pmf = jump_pmf(**params)
    kmax = len(pmf) // 2
    with np.errstate(divide="ignore"):
        log = np.log(pmf)
    k = np.arange(length)[None, :] - np.arange(length)[:, None]
    return np.where(np.abs(k) <= kmax, log[np.clip(k + kmax, 0, 2 * kmax)], NEG)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis=axis))


def viterbi(score: np.ndarray, log_t: np.ndarray) -> tuple[np.ndarray, float]:
    """(path, total score): free start and end, the first state wins ties."""
    n, _ = score.shape
    value, back = score[0], np.zeros(score.shape, np.int64)
    for t in range(1, n):
        c = value[:, None] + log_t
        back[t] = np.argmax(c, axis=0)
        value = c[back[t], np.arange(c.shape[1])] + score[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(np.argmax(value))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(value[path[-1]])


def forward_backward(score: np.ndarray, log_t: np.ndarray) -> tuple[float, np.ndarray]:
    """(log-likelihood without an entry term, posteriors)."""
    n, s = score.shape
    a, b = np.empty((n, s)), np.zeros((n, s))
    a[0] = score[0]
    for t in range(1, n):
        a[t] = log_sum(a[t - 1][:, None] + log_t, 0) + score[t]
    for t in range(n - 2, -1, -1):
        b[t] = log_sum(log_t + (score[t + 1] + b[t + 1])[None, :], 1)
    total = float(log_sum(a[-1], 0))
    return total, np.exp(a + b - total)


def _around(values: np.ndarray, kmax: int) -> np.ndarray:
    """[..., state, 2 kmax + 1]: the values around each state, ascending; -inf beyond the ends."""
    wide = np.full((*values.shape[:-1], values.shape[-1] + 2 * kmax), NEG)
    wide[..., kmax : kmax + values.shape[-1]] = values
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * kmax + 1, axis=-1)


def viterbi_band(score: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`viterbi` of reads of one length, [read, step, state], with the logarithms of jumps from -kmax to kmax: (paths, total scores)."""
    kmax, (reads, n, size) = len(jump) // 2, score.shape
    value, back, backward = score[:, 0], np.zeros(score.shape, np.int64), jump[::-1]
    for t in range(1, n):
        c = _around(value, kmax) + backward
        pick = c.argmax(axis=2)
        # no source at all counts as the first state
        best = np.take_along_axis(c, pick[:, :, None], 2)[:, :, 0]
        back[:, t] = np.where(best > NEG, np.arange(size) - kmax + pick, 0)
        value = best + score[:, t]
    path, own = np.zeros((reads, n), np.int64), np.arange(reads)
    path[:, -1] = value.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[own, t, path[:, t]]
    return path, value[own, path[:, -1]]


def forward_backward_band(score: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`forward_backward` of reads of one length, as `viterbi_band` takes them: (log-likelihoods, posteriors)."""
    kmax, n = len(jump) // 2, score.shape[1]
    a, b = np.empty_like(score), np.zeros_like(score)
    a[:, 0] = score[:, 0]
    for t in range(1, n):
        a[:, t] = log_sum(_around(a[:, t - 1], kmax) + jump[::-1], 2) + score[:, t]
    for t in range(n - 2, -1, -1):
        b[:, t] = log_sum(_around(score[:, t + 1] + b[:, t + 1], kmax) + jump, 2)
    total = log_sum(a[:, -1], 1)
    return total, np.exp(a + b - total[:, None, None])


# --- change points -----------------------------------------------------------------------------------------------------

MIN_VARIANCE = 3e-4
#: Fixed values of the penalty's two regimes: up to 1000 samples, and beyond.
PENALTY_SHORT = (1.239, 0.9872, 5.913e-10, -1.876e-06, 0.004354, -0.1906, 1.999)
PENALTY_LONG = (2.456, 1.187, 2.73)


def change_penalty(n: float) -> float:
    """Information penalty of one change point in a segment of n samples."""
    ll = np.log(np.log(n)) if n <= 1000 else np.log(np.log(min(n, 1e6)))
    if n > 1000:
        a, b, c = PENALTY_LONG
        return float(a * ll + b * np.log(ll) + c)
    a, b, p3, p2, p1, root, c = PENALTY_SHORT
    return float(a * ll + b * np.log(n) + p3 * n**3 + p2 * n**2 + p1 * n + root * np.sqrt(n) + c)


def change_points(x: np.ndarray, sensitivity: float = 1.0, least: int = 2) -> np.ndarray:
    """Bounds of levels [0, ..., len(x)]: best splits by an explicit stack, then merges of splits that no longer pay.

    Missing samples are left out and bounds refer to the original ones; an all-missing signal has no levels.
    """
    place = np.flatnonzero(~np.isnan(x))
    y = x[place]
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    if n < 2 * least:
        return np.array([0, len(x)])
    total, square = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])

    def log_var(a, b):
        k = b - a
        mean = (total[b] - total[a]) / k
        return np.log(np.maximum((square[b] - square[a]) / k - mean * mean, MIN_VARIANCE))

    def gain(a, cut, b):
        """Criterion of parting samples [a, b) at cut: negative where the split pays."""
        return 0.5 * ((cut - a) * log_var(a, cut) + (b - cut) * log_var(cut, b) - (b - a) * log_var(a, b)) + 1 + sensitivity * change_penalty(b - a)

    cuts, stack = [], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a < 2 * least:
            continue
        cut = np.arange(a + least, b - least + 1)
        value = gain(a, cut, b)
        k = int(np.argmin(value))
        if value[k] < 0:
            cuts.append(int(cut[k]))
            stack += [(a, int(cut[k])), (int(cut[k]), b)]
    bounds = [0, *(c for c in sorted(cuts) if least < c < n - least), n]
    while True:
        worst, at = 0.0, -1
        for k in range(1, len(bounds) - 1):
            # merging looks at the segment from the last sample of the level before, except in the first level
            a, b = max(bounds[k - 1], 1) - 1, bounds[k + 1]
            if b - a >= 2 * least:
                value = float(gain(a, bounds[k], b))
                if value > worst:
                    worst, at = value, k
        if at < 0:
            break
        bounds.pop(at)
    return np.array([0, *place[bounds[1:-1]], len(x)])


def levels(x: np.ndarray, bounds: np.ndarray) -> list[tuple[float, float, int, int, int]]:
    """(mean, population std, dwell, start, end) of each level, over its present samples."""
    return [(float(np.nanmean(x[a:b])), float(np.nanstd(x[a:b])), int(b - a), int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])]


# --- linkage -----------------------------------------------------------------------------------------------------------


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges (left, right, height, size) by Lance-Williams updates; of equal heights the pair of least leaves goes first."""
    if method not in ("single", "complete", "average", "weighted"):
        raise ValueError(f"linkage {method!r}")
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, live = list(range(n)), [1] * n, np.ones(n, bool)
    # of each row the first of its least columns: a merge changes those that were of it, and those that it came nearer to
    near = d.argmin(axis=1) if n else np.zeros(0, np.int64)
    low = d[np.arange(n), near]
    out = []
    for step in range(n - 1):
        i = int(np.argmin(low))
        j = int(near[i])
        a, b = sorted((name[i], name[j]))
        height, total = d[i, j], size[i] + size[j]
        out.append((a, b, height, total))
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / total
        else:
            new = (d[i] + d[j]) / 2
        live[j] = False
        new[~live] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        lost = live & ((near == i) | (near == j))
        lost[i] = True
        closer = ((new < low) | ((new == low) & (i < near))) & live & ~lost
        near[closer], low[closer] = i, new[closer]
        for r in np.flatnonzero(lost):
            near[r] = d[r].argmin()
            low[r] = d[r, near[r]]
        low[j] = np.inf
        name[i], size[i] = n + step, total
    return np.array(out).reshape(-1, 4)


def cut_tree(merges: np.ndarray, n: int, n_clusters: int | None = None, threshold: float | None = None) -> np.ndarray:
    """Labels 0.. by the smallest member of each cluster."""
    if (n_clusters is None) == (threshold is None):
        raise ValueError("give either n_clusters or a threshold")
    parent = list(range(2 * n - 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    todo = merges[np.argsort(merges[:, 2], kind="stable")] if threshold is not None else merges
    keep = len(merges) - (n_clusters - 1) if n_clusters is not None else int((merges[:, 2] <= threshold).sum())
    if n_clusters is not None and not 1 <= n_clusters <= n:
        raise ValueError("n_clusters is between one and the number of members")
    index = {tuple(m): k for k, m in enumerate(map(tuple, merges))}
    for m in todo[:keep]:
        new = n + index[tuple(m)]
        parent[find(int(m[0]))] = new
        parent[find(int(m[1]))] = new
    roots, labels = {}, np.empty(n, np.int64)
    for i in range(n):
        labels[i] = roots.setdefault(find(i), len(roots))
    return labels


def shifted(d: np.ndarray) -> tuple[np.ndarray, float]:
    """A distance matrix that may hold negative values, moved up so that it holds none, and by how much."""
    n = len(d)
    if d.shape != (n, n) or not np.isfinite(d).all() or not np.allclose(d, d.T, 1e-10, 1e-12) or np.abs(np.diag(d)).max(initial=0) > 1e-12:
        raise ValueError("distances are square, finite, symmetric, with a zero diagonal")
    shift = max(0.0, -float(d.min()))
    moved = d + shift
    np.fill_diagonal(moved, 0.0)
    return moved, shift


def cluster(d: np.ndarray, method: str = "average", n_clusters: int | None = None, threshold: float | None = None, min_size: int = 1) -> np.ndarray:
    """Labels of a distance matrix that may hold negative values (shifted before linkage); clusters under min_size get -1."""
    n = len(d)
    moved, shift = shifted(d)
    if n == 1:
        labels = np.zeros(1, np.int64)
    else:
        labels = cut_tree(linkage(moved, method), n, n_clusters, None if threshold is None else threshold + shift)
    size = np.bincount(labels, minlength=labels.max() + 1)
    small = size[labels] < min_size
    names = {}
    return np.array([-1 if s else names.setdefault(int(label), len(names)) for label, s in zip(labels, small)])

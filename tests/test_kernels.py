"""Kernels against exhaustive enumeration, invariants and planted structure."""

import itertools

import numpy as np
import pytest

from sigspark.functions import kernels as K
from sigspark.functions import profile_hmm as H
from sigspark.functions.boundary import BoundaryOptions, decode, segment


def brute_warp(c, weight, runs, open_begin, open_end):
    n, m = c.shape
    best = (np.inf, 0)

    def walk(i, j, kind, k, cost, length):
        nonlocal best
        if i == n - 1 and (open_end or j == m - 1) and cost < best[0] - 1e-12:
            best = (cost, length)
        for di, dj, move in ((1, 1, "d"), (1, 0, "v"), (0, 1, "h")):
            a, b = i + di, j + dj
            if a >= n or b >= m or (open_begin and i == 0 and move == "h"):
                continue
            run = k + 1 if move == kind else 1
            if move != "d" and runs and run > runs:
                continue
            walk(a, b, move, run, cost + (weight if move == "d" else 1) * c[a, b], length + 1)

    for j in range(m) if open_begin else [0]:
        walk(0, j, "d", 0, weight * c[0, j], 1)
    return best


@pytest.mark.parametrize("step,weight", [("symmetric1", 1), ("symmetric2", 2)])
@pytest.mark.parametrize("runs", [None, 0, 1, 3])
@pytest.mark.parametrize("open_begin", [False, True])
@pytest.mark.parametrize("open_end", [False, True])
def test_warp_equals_enumeration(step, weight, runs, open_begin, open_end):
    rng = np.random.default_rng(1)
    for _ in range(12):
        c = rng.random(tuple(rng.integers(1, 5, 2)))
        w = K.Warp(c[None], step=step, max_run=runs, open_begin=open_begin, open_end=open_end, path=True)
        dist, length = brute_warp(c, weight, runs or 0, open_begin, open_end)
        if not np.isfinite(dist):
            assert not np.isfinite(w.dist[0])
            continue
        path = w.path(0)
        assert w.dist[0] == pytest.approx(dist) and w.length[0] == len(path) == length
        cost = sum(c[i, j] * (weight if k == 0 or (path[k] - path[k - 1]).all() else 1) for k, (i, j) in enumerate(path))
        assert cost == pytest.approx(dist)


def test_warp_of_padded_pairs_and_bad_options():
    rng = np.random.default_rng(2)
    a, b = [rng.random(k) for k in (3, 9, 5)], [rng.random(k) for k in (6, 4, 5)]
    ones = [np.full(len(x), 0.1) for x in a], [np.full(len(x), 0.1) for x in b]
    for kind in ("gaussian", "l2", "abs"):
        many = K.warp_pairs(kind, a, ones[0], b, ones[1])
        for k in range(3):
            assert K.warp_pairs(kind, a[k : k + 1], ones[0][k : k + 1], b[k : k + 1], ones[1][k : k + 1]).norm[0] == many.norm[k]
    assert not np.isfinite(K.Warp(np.ones((1, 1, 9)), max_run=3).dist[0])
    for bad in ({"max_run": -1}, {"step": "x"}):
        with pytest.raises(ValueError):
            K.Warp(np.ones((1, 2, 2)), **bad)
    with pytest.raises(ValueError):
        K.cost_grid("x", *[np.ones(2)] * 4)


@pytest.mark.parametrize("kind", ["gaussian", "l2", "abs", "weighted"])
def test_warp_rows_make_their_costs_and_keep_to_what_paths_can_reach(kind):
    rng = np.random.default_rng(6)
    na, nb = rng.integers(1, 15, 40), rng.integers(1, 15, 40)
    draw = lambda sizes, of: [of(k) for k in sizes]
    level, std = (lambda k: rng.integers(0, 4, k) / 2.0), (lambda k: rng.integers(1, 4, k) / 4.0)
    am, as_, bm, bs = draw(na, level), draw(na, std), draw(nb, level), draw(nb, std)
    wide = [K.pad(x, fill) for x, fill in ((am, 0.0), (as_, 1.0), (bm, 0.0), (bs, 1.0))]
    grid = (wide[0][:, :, None] - wide[2][:, None, :]) ** 2 * wide[1][:, :, None] if kind == "weighted" else K.cost_grid(kind, *wide)
    for runs, begin, end in itertools.product((None, 1, 2, 3), (False, True), (False, True)):
        options = {"max_run": runs, "open_begin": begin, "open_end": end}
        many = K.Warp(K.CostRows(kind, *wide), na, nb, **options)
        traced = K.Warp(K.CostRows(kind, *wide), na, nb, path=True, **options)
        for k in range(40):
            # a pair by itself, and with all columns within reach
            one = K.Warp(grid[k : k + 1, : na[k], : nb[k]], path=True, **options)
            assert one.dist[0] == many.dist[k] == traced.dist[k]
            if np.isfinite(one.dist[0]):
                for x in ("norm", "length", "j_start", "j_end"):
                    assert getattr(one, x)[0] == getattr(many, x)[k] == getattr(traced, x)[k]
                assert one.path(0).tolist() == traced.path(k).tolist()


def test_a_capped_warp_takes_a_fraction_of_its_grid():
    """Columns that capped runs can't reach cost nothing: some 0.6 of a square, and little of a row of a wide one."""
    asked = []

    class Counted(K.CostRows):
        def row(self, i, lo, hi):
            asked.append(hi - lo)
            return super().row(i, lo, hi)

    x = np.random.default_rng(7).random((3, 64))
    assert np.isfinite(K.Warp(Counted("abs", x, None, x)).dist).all() and sum(asked) < 0.65 * 64 * 64


def test_warp_to_leaves_gaps():
    got = K.warp_to(np.array([[0, 0], [1, 0], [2, 2]]), np.array([1.0, 3.0, 5.0]), 4)
    assert got[0] == 2 and got[2] == 5 and np.isnan(got[[1, 3]]).all()


def paths(score, log_t):
    n, s = score.shape
    for p in itertools.product(range(s), repeat=n):
        yield p, sum(score[t, p[t]] for t in range(n)) + sum(log_t[p[t - 1], p[t]] for t in range(1, n))


def test_viterbi_and_forward_backward_equal_enumeration():
    rng = np.random.default_rng(3)
    score, log_t = rng.normal(size=(4, 4)), K.log_transition(4, kmax=2)
    all_ = dict(paths(score, log_t))
    path, total = K.viterbi(score, log_t)
    assert total == pytest.approx(max(all_.values())) and all_[tuple(path)] == pytest.approx(total)
    like, w = K.forward_backward(score, log_t)
    assert like == pytest.approx(np.logaddexp.reduce(list(all_.values())))
    assert w.sum(axis=1) == pytest.approx(np.ones(4))
    assert w[2, 1] == pytest.approx(sum(np.exp(v - like) for p, v in all_.items() if p[2] == 1))


def test_jump_pmf():
    p = K.jump_pmf()
    assert len(p) == 21 and p.sum() == pytest.approx(1) and p.argmax() == 11


def test_change_points():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.1, k) for m, k in ((0, 60), (1, 40), (0.3, 80))])
    assert np.abs(K.change_points(x) - [0, 60, 100, 180]).max() <= 1
    gaps = x.copy()
    gaps[[0, 30, 31, 179]] = np.nan
    assert np.abs(K.change_points(gaps) - [0, 60, 100, 180]).max() <= 1
    assert K.change_points(np.full(9, np.nan)).tolist() == [] and K.levels(np.full(9, np.nan), K.change_points(np.full(9, np.nan))) == []
    assert K.change_points(np.array([1.0, 2.0])).tolist() == [0, 2]


def test_clusters():
    d = np.array([[0, -2, 5, 6], [-2, 0, 4, 5], [5, 4, 0, -1], [6, 5, -1, 0.0]])
    for method in ("single", "complete", "average", "weighted"):
        assert K.cluster(d, method, n_clusters=2).tolist() == [0, 0, 1, 1]
        assert K.cluster(d, method, n_clusters=4).tolist() == [0, 1, 2, 3]
    assert K.cluster(d, threshold=-0.5).tolist() == [0, 0, 1, 1]
    assert K.cluster(d, threshold=-1.5, min_size=2).tolist() == [0, 0, -1, -1]
    with pytest.raises(ValueError):
        K.cluster(d)
    with pytest.raises(ValueError):
        K.cluster(d + 1, n_clusters=2)


def test_hmm_score_equals_enumeration_and_objectives_rise():
    rng = np.random.default_rng(5)
    mean, std = rng.normal(size=4), np.full(4, 0.5)
    offsets, weights = np.array(H.OFFSETS), np.array([0.1, 0.2, 0.5, 0.2])
    band = H.band(4, offsets, weights)
    dense = np.full((4, 4), -np.inf)
    for k, o in enumerate(offsets):
        for i in range(4):
            if 0 <= i + o < 4:
                dense[i, i + o] = band[k, i]
    assert np.exp(dense).sum(axis=1) == pytest.approx(np.ones(4))
    x, xs = rng.normal(size=3), np.full(3, 0.2)
    score = K.emission(x, xs, mean, std)
    want = np.logaddexp.reduce([v - np.log(4) for _, v in paths(score, dense)])
    like, gamma = H.score_read(x, xs, mean, std, offsets, weights, posterior=True)
    assert like == pytest.approx(want) and H.score_read(x, xs, mean, std, offsets, weights) == pytest.approx(want) and gamma.sum() == pytest.approx(3)
    truth = np.array([0.0, 1, -1, 0.5, 2, -0.5])
    reads = [(truth + rng.normal(0, 0.1, 6), np.full(6, 0.1), np.full(6, 3.0)) for _ in range(6)]
    p = H.fit(reads, 0, max_iter=6)
    assert len(p.log_likelihood) == p.n_iter + 1 and p.supported.all()
    for r in p.history:
        assert r["emission_after"] >= r["emission_before"] - 1e-9 and r["transition_after"] >= r["transition_before"] - 1e-9 and r["gradient"] <= 1e-8
    assert np.abs(p.mean - truth).max() < 0.15
    s = H.snapshot(reads, p, 1)
    assert s.n_iter == 1 and len(s.log_likelihood) == 2
    with pytest.raises(ValueError):
        H.snapshot(reads, p, p.n_iter + 1)
    with pytest.raises(ValueError):
        H.check_offsets([0, 1, 2])


def test_transition_gradient_and_hessian():
    rng = np.random.default_rng(6)
    ok = H.legal(3, np.array(H.OFFSETS)).T
    counts = np.where(ok, rng.random((3, 4)) * 5, 0)
    free = rng.normal(size=3)
    value, g, h, _, _ = H.transition_objective(free, counts, ok, 1.0)
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        up, down = H.transition_objective(free + e, counts, ok, 1.0), H.transition_objective(free - e, counts, ok, 1.0)
        assert (up[0] - down[0]) / 2e-6 == pytest.approx(g[k], abs=1e-5)
        assert (up[1] - down[1]) / 2e-6 == pytest.approx(h[k], abs=1e-5)


def test_decoder_equals_enumeration():
    rng = np.random.default_rng(7)
    o = BoundaryOptions(least_non_dna=2, end_tolerance=1, least_coverage=0.5, kmax=2)
    with np.errstate(divide="ignore"):
        jump = np.log(K.jump_pmf(kmax=2))
    for only in (False, True):
        o = BoundaryOptions(dna_only=only, least_non_dna=2, least_coverage=0.5, kmax=2)
        for _ in range(5):
            n, size = 6, 3
            dna, pre, region, non = rng.normal(size=(n, size)), rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
            span = 2
            first_exit = 0 if only else 1
            entries = range((size - span if only else first_exit - span + 1) + 1)
            best = -np.inf
            for p in itertools.product(range(-1, size + (not only)), repeat=n):
                if p[-1] != size and not only or only and p[-1] < 0 or p[0] == size:
                    continue
                total = 0.0
                for t, s in enumerate(p):
                    total += pre[t] if s == -1 else non[t] if s == size else dna[t, s]
                    q = p[t - 1] if t else -1
                    if t == 0 and s == -1 or q == s == -1 and t or q == s == size:
                        continue
                    if q == -1 and s in entries:
                        total -= np.log(len(entries))
                    elif 0 <= q < size and 0 <= s < size and abs(s - q) <= 2:
                        total += jump[s - q + 2]
                    elif first_exit <= q < size and s == size and n - t >= 2:
                        pass
                    else:
                        total = -np.inf
                        break
                best = max(best, total)
            path, total, null = decode(dna, pre, region, non, o)
            assert total == pytest.approx(best)
            assert null == pytest.approx(max([pre.sum(), region.sum()] + ([] if only else [non.sum()])))


def test_planted_boundary():
    rng = np.random.default_rng(8)
    anchor = rng.normal(0, 1, 30)
    mean = np.concatenate([np.full(5, 3.0), anchor, np.full(12, -3.0)]) + rng.normal(0, 0.05, 47)
    start = np.arange(47) * 10.0
    models = {"pre_dna": (3.0, 0.2), "dna": (0.0, 1.0), "non_dna": (-3.0, 0.2)}
    got = segment(mean, np.full(47, 0.05), start, start + 10, anchor, np.full(30, 0.1), np.arange(30, 0, -1), models)
    assert got["status"] == "pass" and got["boundary_step"] == 35 and got["boundary_sample"] == 350 and got["dna_start_step"] == 5
    bad = segment(rng.normal(0, 1, 47), np.full(47, 0.05), start, start + 10, anchor, np.full(30, 0.1), np.arange(30, 0, -1), models)
    assert bad["status"] == "rejected" and bad["boundary_step"] == -1
    with pytest.raises(ValueError):
        segment(mean, np.full(47, 0.05), start, start, anchor, np.full(30, 0.1), np.arange(30), models)


@pytest.mark.parametrize("n, size, kmax", [(12, 30, 4), (5, 3, 10), (1, 4, 10)])
def test_alignments_of_many_reads_equal_those_of_each(n, size, kmax):
    rng = np.random.default_rng(n)
    score = K.emission(rng.normal(0, 1, (6, n)), np.full((6, n), 0.05), rng.normal(0, 1, size), np.full(size, 0.1))
    with np.errstate(divide="ignore"):
        jump = np.log(K.jump_pmf(kmax=kmax))
    log_t = K.log_transition(size, kmax=kmax)
    paths, totals = K.viterbi_band(score, jump)
    likes, posteriors = K.forward_backward_band(score, jump)
    for k in range(6):
        path, total = K.viterbi(score[k], log_t)
        like, w = K.forward_backward(score[k], log_t)
        assert paths[k].tolist() == path.tolist() and totals[k] == pytest.approx(total, rel=1e-12)
        assert likes[k] == pytest.approx(like, rel=1e-12) and posteriors[k] == pytest.approx(w, abs=1e-9)

"""Groups of any size: tiles of pairs and distributed fits equal the forms that hold a group in a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import kernels as K
from sigspark.functions import profile_hmm as H
from sigspark.operators import alignment, clusters, consensus, em, linkage, pairs, refits
from sigspark.operators.consensus import pair_matrix, prepare
from sigspark.plans import studies
from sigspark.sources import fixtures as fx

TRACES = "trace_id long, label long, mean array<double>, std array<double>, dwell array<double>"


@pytest.fixture(scope="module")
def wobbly(spark):
    """Two groups of noisy copies of a shape, of different lengths, with stds of their own at each step, and a group of one."""
    rng = np.random.default_rng(3)
    rows = []
    for label in range(2):
        shape = np.cumsum(rng.normal(size=14))
        for _ in range(12):
            at = np.sort(rng.choice(14, rng.integers(9, 15), replace=False))
            rows.append((len(rows), label, (shape[at] + 0.2 * rng.normal(size=len(at))).tolist(), rng.uniform(0.1, 0.4, len(at)).tolist(), rng.uniform(1, 9, len(at)).tolist()))
    rows.append((99, 7, [1.0, 3.0, 2.0], [0.2, 0.3, 0.2], [1.0, 2.0, 3.0]))
    return spark.createDataFrame(rows, TRACES).cache()


def ready(frame, label, **options):
    own = sorted((r for r in frame.collect() if r["label"] == label), key=lambda r: r["trace_id"])
    return [r["trace_id"] for r in own], [(*prepare(r["mean"], r["std"], **options), np.array(r["dwell"])) for r in own]


def test_distributed_fit_equals_the_fit_of_a_group(spark, wobbly, small):
    grid = fx.grid_traces(spark, small).where("is_training AND label < 3").select("trace_id", "label", "mean", "std", "dwell")
    for frame, floor, rounds in ((wobbly, 1e-3, 20), (grid, 0.05, 4)):
        got = em.fit_large(em.prepared(frame, "label", True, floor), "label", min_std=floor, max_iter=rounds)
        assert len(got) == 3
        for label, (medoid, p) in got.items():
            ids, reads = ready(frame, label, normalise=True, floor=floor)
            first = int(np.argmin(pair_matrix([r[0] for r in reads], [r[1] for r in reads]).sum(axis=1)))
            want = H.fit(reads, first, min_std=floor, max_iter=rounds)
            assert medoid == ids[first] and (p.n_iter, p.converged) == (want.n_iter, want.converged)
            for c in ("mean", "std", "dwell", "depth", "stderr", "weights"):
                assert getattr(p, c) == pytest.approx(getattr(want, c), rel=1e-9, abs=1e-9), c
            assert p.log_likelihood == pytest.approx(want.log_likelihood, rel=1e-10)
            for a, b in zip(p.history, want.history):
                assert all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-6) for k in ("delta", "emission_before", "emission_after", "transition_after"))


def test_large_and_small_groups_in_one_table(spark, wobbly):
    one = alignment.fit_profile_hmms(wobbly, "label", max_iter=3, group_cells=1 << 40).toPandas().set_index("label")
    two = alignment.fit_profile_hmms(wobbly, "label", max_iter=3, group_cells=100).toPandas().set_index("label")
    assert set(one.index) == set(two.index) == {0, 1, 7}
    for label in one.index:
        for c in ("medoid_id", "n_iter", "converged", "stop_reason", "min_depth", "pseudocount", "normalise", "max_iter"):
            assert one.loc[label, c] == two.loc[label, c], c
        for c in ("mean", "std", "weights", "depth"):
            assert list(one.loc[label, c]) == pytest.approx(list(two.loc[label, c]), rel=1e-6, abs=1e-6)
        assert len(two.loc[label, "history"]) == two.loc[label, "n_iter"]
    with pytest.raises(ValueError):
        em.fit_large(em.prepared(wobbly, "label", True, 1e-3), "label", most=2)
    with pytest.raises(ValueError):
        em.fit_large(em.prepared(wobbly, "label", True, 1e-3), "label", max_iter=0)


def test_emission_step_is_that_of_single_steps():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(2, 60))
        x, xs, g = rng.normal(1, 1, n), rng.choice(rng.uniform(0.05, 1, 4), n), rng.uniform(size=n)
        level, var, floor = rng.normal(), rng.uniform(0.01, 2), 1e-4
        mean, new = H.fit_emissions(x, xs**2, g[:, None], np.array([level]), np.array([var]), floor)
        v, at = np.unique(xs**2, return_inverse=True)
        sums = [np.bincount(at, g * (x - level) ** k, len(v)) for k in range(3)]
        got = em.emission_step(*sums, v, level, var, floor)
        assert got[0] == pytest.approx(mean[0], abs=1e-10) and got[1] == pytest.approx(new[0], rel=1e-10) and got[3] >= got[2] - 1e-12


def test_tiles_give_every_pair_once(spark, wobbly):
    copies = wobbly.unionByName(wobbly.where("label = 1").withColumn("trace_id", F.col("trace_id") + 1000))
    whole = None
    for cells in (1 << 40, 20_000, 400):
        got = sorted(map(tuple, pairs.pairwise(copies, "label", cells=cells).collect()))
        assert len(got) == len({g[:3] for g in got}) == 12 * 11 // 2 + 24 * 23 // 2 and all(g[1] < g[2] for g in got)
        whole = whole or got
        assert [g[:3] for g in got] == [g[:3] for g in whole] and np.allclose([g[3] for g in got], [g[3] for g in whole], rtol=1e-12, atol=1e-12)
    by_pair = sorted((r["label"], r["a"], r["b"], r["norm_dist"]) for r in pairs.warp(pairs.unordered_pairs(copies, "label"), copies, copies, "label").collect())
    assert np.allclose([g[3] for g in by_pair], [g[3] for g in whole], rtol=1e-12)
    assert pairs.pairwise(copies.limit(0), "label").count() == 0


def test_blocks_of_a_large_group_are_bounded(spark):
    """Planned, not run: of 100,000 traces no tile has more cells than a few times the unit of work."""
    cells = pairs.TILE_CELLS
    rows = spark.range(100_000).select(F.lit(0).cast("long").alias("label"), F.col("id").alias("trace_id"), F.lit(64).alias("n"))
    blocks = -(-100_000 * 64 // int(cells**0.5))
    size = rows.groupBy(F.pmod(F.xxhash64("trace_id"), F.lit(blocks))).agg((F.sum("n") * F.sum("n")).alias("cells"))
    assert size.agg(F.max("cells")).first()[0] < 3 * cells


@pytest.mark.parametrize("method", ["single", "complete", "average", "weighted"])
def test_rounds_of_neighbours_equal_the_matrix_form(spark, method):
    """Labels and heights, with negative distances, for two groups of different sizes; pairs in either direction, repeated."""
    rng = np.random.default_rng(11)
    rows, truth = [], {}
    for grp, n in ((0, 15), (1, 2)):
        d = rng.normal(3, 2, (n, n))
        truth[grp] = d + d.T - np.diag(2 * d.diagonal())
        rows += [(grp, 10 * i, 10 * j, float(truth[grp][i, j])) for i in range(n) for j in range(n) if i < j or i == j + 1]
    edges = spark.createDataFrame(rows, "grp long, a long, b long, d double")
    height = "d" if method == "single" else "height"
    merges = linkage.least_forest(edges, "grp")[0] if method == "single" else linkage.merge_rounds(edges, "grp", method=method)
    got = sorted(r[height] for r in merges.where("grp = 0").collect())
    moved = truth[0] - truth[0].min()
    np.fill_diagonal(moved, 0)
    assert got == pytest.approx(sorted(K.linkage(moved, method)[:, 2] + truth[0].min()))
    for options in ({"n_clusters": 2}, {"threshold": 2.0, "min_size": 3}):
        labels = {(r["grp"], r["trace_id"]): r["label"] for r in linkage.cluster_rounds(edges, "grp", method=method, **options).collect()}
        for grp, d in truth.items():
            want = K.cluster(d - np.diag(d.diagonal()), method, **{"n_clusters": None, "threshold": None} | options)
            assert [labels[grp, 10 * i] for i in range(len(d))] == want.tolist(), (grp, options)


def test_clusters_of_large_and_small_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, j, float(rng.uniform())) for g, n in ((0, 9), (1, 5)) for i in range(n) for j in range(i + 1, n)]
    edges = spark.createDataFrame(rows, "grp long, a long, b long, d double")
    one, two = (sorted(map(tuple, clusters.cluster(edges, "grp", "average", n_clusters=3, group_edges=k).collect())) for k in (1000, 12))
    assert one == two and len(one) == 14
    assert linkage.cluster_rounds(edges.limit(0), "grp", method="single", threshold=1.0).count() == 0
    # equal distances: what is linked doesn't depend on the order; missing pairs are infinitely far
    same = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 4, 5, 1.0), (0, 3, 6, 5.0)], "grp long, a long, b long, d double")
    got = {r["trace_id"]: r["label"] for r in linkage.cluster_rounds(same, "grp", method="single", threshold=1.0).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}


def test_a_stopped_fit_goes_on_to_the_same_end(spark, wobbly):
    whole = alignment.fit_profile_hmms(wobbly, "label", max_iter=5, group_cells=100)
    part = alignment.fit_profile_hmms(wobbly, "label", max_iter=2)  # small groups, a group a task
    more = alignment.resume_profile_hmms(wobbly, part, "label", 5)
    back = alignment.snapshot_profile_hmms(wobbly, whole, "label", 2)
    for a, b, n in ((whole, more, 5), (part, back, 2)):
        a, b = (x.toPandas().set_index("label").sort_index() for x in (a, b))
        for label in a.index:
            for c in ("n_iter", "converged", "medoid_id"):
                assert a.loc[label, c] == b.loc[label, c] or n == 2 and c == "converged"
            for c in ("mean", "std", "dwell", "weights", "depth", "stderr", "log_likelihood"):
                assert list(a.loc[label, c]) == pytest.approx(list(b.loc[label, c]), rel=1e-8, abs=1e-8), (label, c)
    with pytest.raises(ValueError, match="no update"):
        alignment.snapshot_profile_hmms(wobbly, part, "label", 4)
    spoilt = part.withColumn("log_likelihood", F.transform("log_likelihood", lambda x: x + 1e-3))
    with pytest.raises(FloatingPointError):
        alignment.snapshot_profile_hmms(wobbly, spoilt, "label", 1)


def test_a_cost_of_ones_own(spark, wobbly):
    few = wobbly.where("trace_id < 6")
    own = lambda am, as_, bm, bs: np.abs(am[..., :, None] - bm[..., None, :])
    one, two = (sorted(map(tuple, pairs.pairwise(few, "label", cost=cost).collect())) for cost in ("abs", own))
    assert one == two and len(one) == 15
    for bad, name in ((lambda am, as_, bm, bs: am, "shape"), (lambda am, as_, bm, bs: own(am, as_, bm, bs) * np.nan, "not finite")):
        with pytest.raises(Exception, match=name):
            pairs.pairwise(few, "label", cost=bad).collect()


def test_barycentres_in_rounds_equal_those_of_a_group(spark, wobbly):
    one, two = (consensus.fit_barycentres(wobbly, "label", min_depth=None, group_cells=k).toPandas().set_index("label").sort_index() for k in (1 << 40, 100))
    assert list(one.index) == list(two.index) == [0, 1, 7]
    for label in one.index:
        for c in ("mean", "std", "dwell", "depth", "supported", "objective"):
            assert list(one.loc[label, c]) == pytest.approx(list(two.loc[label, c]), rel=1e-9, abs=1e-9), (label, c)
        assert all(one.loc[label, c] == two.loc[label, c] for c in ("iterations", "converged", "medoid_id"))


def test_refits_equal_fits_of_copied_traces(spark, wobbly):
    start = spark.createDataFrame([(0, 3), (1, 14), (7, 99)], "label long, trace_id long")
    table = em.prepared(wobbly, "label", True, 1e-3)
    got = refits.fit_rounds(table, "label", replicates=4, seed=9, start=start, min_depth=None)
    counts = {r["trace_id"]: r["c"] for r in table.select("trace_id", refits.draw_counts(4, 9).alias("c")).collect()}
    assert len(got) == 15 and len({tuple(c) for c in counts.values()}) > 5
    for (label, k), m in got.items():
        ids, reads = ready(wobbly, label, normalise=True, floor=1e-3)
        times = [1 if k == 0 else counts[i][k - 1] for i in ids]
        first = {0: 3, 1: 14, 7: 99}[label]
        if not sum(times):
            assert not m["converged"] and m["reads"] == 0 and m["mean"].tolist() == reads[0][0].tolist()
            continue
        copied = [reads[ids.index(first)]] + [r for r, n in zip(reads, times) for _ in range(n)]
        # the first stands before the copies to begin from, and counts for nothing
        want = consensus.barycentre(*([r[c] for r in copied] for c in range(3)), medoid=0, min_depth=max(2, -(-sum(times) // 2)), counts=[0] + [1] * sum(times))
        for c in ("mean", "std", "dwell", "objective"):
            assert m[c] == pytest.approx(want[c], rel=1e-9, abs=1e-9), (label, k, c)
        assert m["depth"].tolist() == want["depth"].tolist() and m["supported"].tolist() == want["supported"].tolist() and (m["iterations"], m["converged"]) == (want["iterations"], want["converged"])


def test_draws_have_a_mean_of_one(spark):
    rows = spark.range(4000).select(F.col("id").alias("trace_id")).select(refits.draw_counts(3, 1).alias("c")).collect()
    drawn = np.array([r["c"] for r in rows])
    assert np.abs(drawn.mean(axis=0) - 1).max() < 0.06 and np.abs(drawn.var(axis=0) - 1).max() < 0.12
    assert abs(np.corrcoef(drawn.T)[0, 1]) < 0.06


def test_the_medoid_is_of_all_traces_of_a_group(spark):
    """1300 traces, of which some are copies: tiles of one block and of many, and the form that holds a group in a task."""
    rng = np.random.default_rng(7)
    levels = rng.normal(size=(1300, 3))
    levels[1290:] = levels[1000]
    rows = [(k, int(k >= 1298), x.tolist(), [0.3] * 3, [1.0] * 3) for k, x in enumerate(levels)]
    rows += [(2000, 2, [1.0, 2.0], [0.1, 0.1], [1.0, 1.0]), (2001, 3, [1.0, 5.0], [0.1, 0.1], [1.0, 1.0]), (2002, 3, [3.0, 1.0], [0.1, 0.1], [1.0, 1.0])]
    frame = spark.createDataFrame(rows, TRACES)
    table = em.prepared(frame, "label", False, 1e-3)
    first = consensus.medoid_of(pair_matrix(list(levels[:1298]), [np.full(3, 0.3)] * 1298))
    assert {r["label"]: r["trace_id"] for r in em.medoids(table, "label").collect()} == {0: first, 1: 1298, 2: 2000, 3: 2001}
    sums = pair_matrix(list(levels[:1298]), [np.full(3, 0.3)] * 1298).sum(axis=1)
    for cells in (pairs.SUM_CELLS, (200 * 3) ** 2):
        got = {r["trace_id"]: r["row_sum"] for r in pairs.row_sums(table.where("label = 0"), "label", normalise=False, cells=cells).collect()}
        assert sorted(got) == list(range(1290)) and [got[k] for k in range(1290)] == pytest.approx(list(sums[:1290]), rel=1e-12)
    one, two = (consensus.fit_barycentres(frame, "label", normalise=False, max_iter=2, group_cells=k).toPandas().set_index("label").sort_index() for k in (1 << 40, 100))
    assert one["medoid_id"].tolist() == two["medoid_id"].tolist() == [first, 1298, 2000, 2001]


def test_ranks_without_edges(spark, wobbly, monkeypatch):
    """Those of an edge list, copies among the traces, with tiles of one block and of many; the study keeps no pairs."""
    copies = wobbly.unionByName(wobbly.where("trace_id % 5 = 0").withColumn("trace_id", F.col("trace_id") + 1000)).cache()
    want = sorted(map(tuple, clusters.medoid_ranking(pairs.pairwise(copies, "label"), "label", top=7).select("label", "trace_id", "rank", F.round("row_sum", 9)).collect()))
    for cells in (pairs.SUM_CELLS, 400):
        got = sorted(map(tuple, pairs.central(copies, "label", top=7, cells=cells).select("label", "trace_id", "rank", F.round("row_sum", 9)).collect()))
        assert got == want and len(got) == 14
    monkeypatch.setattr(pairs, "tiled", None)
    out = studies.medoid_robustness(copies, wobbly, "label", top=2, max_iter=2)
    assert sorted((r["label"], r["trace_id"]) for r in out.collect()) == sorted(w[:2] for w in want if w[2] < 3)

"""Work that grows with the input and no faster: batches, tiles and summaries of tiles."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigspark.functions import kernels as K
from sigspark.functions import kernels as K
from sigspark.functions import profile_hmm as H
from sigspark.operators import clusters, em, evaluation, linkage, pairs, refits, squares
from sigspark.plans import catalogue
from sigspark.plans import evaluation as evaluation_plans
from sigspark.sources import fixtures as fx


def test_traces_of_all_models_share_batches(monkeypatch):
    rng = np.random.default_rng(3)
    models = {g: {k: rng.normal(size=12) for k in range(6)} for g in range(5)}
    frame = pd.DataFrame({"g": np.arange(20) % 5, "mean": [rng.normal(size=9 + k % 4) for k in range(20)], "counts": [rng.integers(1, 3, 5) * (k > 4) for k in range(20)]})
    frame["std"], frame["dwell"] = [[np.full(len(m), v) for m in frame["mean"]] for v in (0.5, 1.0)]
    calls, warp = [], K.Warp
    monkeypatch.setattr(refits.K, "Warp", lambda *a, **b: calls.append(1) or warp(*a, **b))
    got = pd.concat(refits._sums(models, "g", 1e-3, {})(iter([frame]))).set_index(["g", "replicate", "pos"])
    assert len(calls) == 1
    for g, own in models.items():
        for k, target in own.items():
            if (g, k, 0) not in got.index:
                assert all(r.counts[k - 1] == 0 for r in frame[frame["g"] == g].itertuples())
                continue
            want = np.zeros((13, 5))
            for r in frame[frame["g"] == g].itertuples():
                n = 1 if k == 0 else r.counts[k - 1]
                w = warp((r.mean[:, None] - target)[None] ** 2 / r.std[0] ** 2, path=True)
                want[-1, :2] += n * w.norm[0], n
                for i, j in w.path(0):
                    want[j, :4] += n * np.array([1, r.mean[i], r.mean[i] ** 2, r.dwell[i]]) / r.std[i] ** 2
                for j in set(w.path(0)[:, 1]):
                    want[j, 4] += n
            assert np.allclose(got.loc[g, k].loc[[*range(12), -1]], want)


def rows(frame):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect())


def test_tiles_leave_summaries_of_their_pairs(spark, small):
    """The same as from an edge list, with tiles of one block and of many."""
    g = fx.grid_traces(spark, small).where("label < 4").withColumnRenamed("label", "grp").cache()
    edges = pairs.squared_distances(g, "grp").cache()
    far = pairs.mirrored(edges, "grp").groupBy("grp", "a").agg(F.max("d"))
    one = g.select("grp", "trace_id", F.lit(0).cast("long").alias("label"))
    for cells in (squares.TILE_CELLS, (5 * 64) ** 2):
        found = squares.neighbours(g, "grp", cells=cells).cache()
        assert rows(squares.ranked(found, "grp").select("grp", "trace_id", "row_sum", "rank")) == rows(clusters.medoid_ranking(edges, "grp"))
        assert rows(found.select("grp", "trace_id", squares.nearest_mean())) == rows(clusters.knn_distance(edges, 5, "grp"))
        assert rows(found.select("grp", "trace_id", "farthest")) == rows(far)
        assert rows(squares.faults(g, "grp", cells=cells)) == rows(clusters.edge_faults(edges, "grp"))
        want = clusters.outlier_scores(edges, one, "grp").drop("label")
        assert rows(squares.outlier_scores(g, "grp", cells=cells).select(*want.columns)) == rows(want)
        least = squares.forest(g, "grp", cells=cells).cache()
        assert least.count() < edges.count() / 2
        assert rows(linkage.cluster_rounds(least, "grp", method="single", n_clusters=3)) == rows(clusters.cluster(edges, "grp", "single", n_clusters=3))
    one = g.first()
    twice = g.unionByName(g.where(F.col("trace_id") == one["trace_id"]))
    assert [r["grp"] for r in squares.faults(twice, "grp").collect() if not r["valid"]] == [one["grp"]]


def test_linkage_of_squared_distances_needs_no_pairs():
    rng = np.random.default_rng(4)
    for n in (2, 3, 17, 80):
        x = rng.normal(size=(n, 5)) + 4 * rng.integers(0, 3, n)[:, None]
        d = ((x[:, None] - x[None]) ** 2).sum(axis=-1)
        for method in ("average", "weighted"):
            assert np.allclose(squares.linkage(x, method), K.linkage(d, method))
    same = squares.linkage(np.repeat(rng.normal(size=(6, 5)), 9, axis=0))
    assert np.allclose(same[:48, 2], 0) and (np.diff(same[:, 2]) >= 0).all()


def test_warps_of_all_pairs_move_traces_and_not_pairs(spark, small):
    """Both distances from tiles equal those of pairs with their payloads."""
    g = fx.grid_traces(spark, small).where("trace_id < 60").cache()
    for options in ({"max_run": None}, {"max_run": 3}, {"open_begin": True, "open_end": True}, {"step": "symmetric2"}):
        want = pairs.warp(pairs.unordered_pairs(g, "label"), g, g, "label", cost="abs", normalise=False, **options).select("label", "a", "b", "dist", "norm_dist")
        got = pairs.warped(g, "label", cost="abs", normalise=False, cells=(4 * 64) ** 2, **options)
        assert rows(got) == rows(want)


def _models(size: int, groups: int):
    offsets, rng = H.check_offsets(H.OFFSETS), np.random.default_rng(3)
    return {g: (rng.normal(0, 1, size), np.full(size, 0.3), H.start_weights(size, offsets, 1.0)) for g in range(groups)}, offsets


def test_rounds_hand_on_sums_of_many_variances(monkeypatch):
    models, offsets = _models(24, 3)
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"label": np.arange(300) % 3, "mean": list(rng.normal(0, 1, (300, 24))), "std": list(rng.uniform(0.1, 0.5, (300, 24))), "dwell": list(np.ones((300, 24)))})
    found = []
    for held in (10_000, 10_000_000):
        monkeypatch.setattr(em, "HELD_ROWS", held)
        monkeypatch.setattr(em, "BATCH_CELLS", 5_000)
        parts = list(em._expect(models, offsets, "label")(iter([frame])))
        found.append((max(map(len, parts)), pd.concat(parts).groupby(["label", "state", "key"])[["v0", "v1", "v2", "v3"]].sum()))
    assert found[0][0] < 20_000 < found[1][0]
    pd.testing.assert_frame_equal(found[0][1], found[1][1], rtol=1e-9)


def test_posteriors_come_in_small_frames():
    models, offsets = _models(40, 1)
    (mean, std, weights), rng = models[0], np.random.default_rng(6)
    rows = [{"trace_id": k, "label": 0, "mean": rng.normal(0, 1, 40), "std": np.full(40, 0.1), "pm": mean, "ps": std, "offsets": offsets, "weights": weights} for k in range(300)]
    parts = list(evaluation.posterior_frames(iter([pd.DataFrame(rows)]), "label", True, 0.05))
    assert pd.concat(parts)["trace_id"].tolist() == list(range(300)) and max(map(len, parts)) < 150


def test_trims_are_decoded_in_one_pass(spark, small):
    plan = catalogue.trim_sweep(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_pairs_of_many_lengths_share_batches_of_like_shapes():
    rng = np.random.default_rng(4)
    rows, columns = rng.integers(1, 120, (2, 5000))
    got = list(pairs.batches_of(rows, columns, 200_000))
    assert np.array_equal(np.sort(np.concatenate(got)), np.arange(5000))
    padded = [len(k) * int(rows[k].max()) * int(columns[k].max()) for k in got]
    assert max(padded) <= 200_000 and sum(padded) < 1.5 * int((rows * columns).sum()) and len(got) < 4 * int((rows * columns).sum()) / 200_000
    assert [k.tolist() for k in pairs.batches_of(np.array([50, 1]), np.array([50, 1]), 100)] == [[1], [0]] and not list(pairs.batches_of(np.zeros(0, int), np.zeros(0, int)))


def test_complete_linkage_needs_no_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    for n, most in ((1, 9), (2, 9), (90, 200), (90, 30), (90, 1)):
        x = rng.normal(size=(n, 5)) + rng.integers(0, 3, (n, 1)) * 3
        want = K.linkage(((x[:, None] - x[None]) ** 2).sum(axis=2), "complete")
        got = squares._complete(x, most)
        assert np.array_equal(got[:, [0, 1, 3]], want[:, [0, 1, 3]]) and np.allclose(got[:, 2], want[:, 2], rtol=1e-12)
    # copies and a lattice: many equal heights
    x = np.concatenate([np.zeros((20, 2)), np.ones((20, 2)) * 9, np.stack(np.meshgrid(range(6), range(6)), -1).reshape(-1, 2) + 50.0])
    for most in (200, 10):
        assert K.cut_tree(squares._complete(x, most), len(x), 3).tolist() == [0] * 20 + [1] * 20 + [2] * 36


def test_members_and_labels_without_edges(spark, small, monkeypatch):
    g = fx.grid_traces(spark, small).withColumnRenamed("label", "grp").cache()
    labels = g.select("grp", "trace_id", (F.col("trace_id") % 2).alias("label"))
    edges = pairs.squared_distances(g, "grp").cache()
    columns = ["grp", "label", "n_reads", "members", "medoid", "medoid_position"]
    plain = lambda frame: sorted(map(repr, frame.select(*columns).collect()))
    want, complete = plain(evaluation.cluster_members(edges, labels, "grp")), rows(clusters.cluster(edges, "grp", "complete", n_clusters=3))

    def none(*args, **options):
        raise AssertionError("edges of all pairs")

    monkeypatch.setattr(pairs, "squared_distances", none)
    assert plain(evaluation.grid_cluster_members(g, labels, "grp")) == plain(evaluation.grid_cluster_members(g, labels, "grp", cells=(5 * 64) ** 2)) == want
    queries = catalogue.queries()
    assert queries["cluster_members"](spark, small).count() == len(want) and rows(queries["cluster_labels_complete"](spark, small)) == complete


def test_searches_move_blocks_not_pairs(spark, small, monkeypatch):
    """The same as of joined pairs, with tiles of one block and of many; the queries join no pairs."""
    g = fx.grid_traces(spark, small).where("label < 4").cache()
    asked = g.where("trace_id % 7 = 0")
    every = asked.select("label", F.col("trace_id").alias("a")).join(g.select("label", F.col("trace_id").alias("b")), "label").where("a <> b").select("a", "b")
    for normalise in (False, True):
        want = rows(pairs.warp(every, g, g, normalise=normalise, open_end=True).select("a", "b", "dist", "norm_dist"))
        for cells in (pairs.TILE_CELLS, (5 * 64) ** 2, 64 * 64):
            got = pairs.searched(asked, g, "label", normalise=normalise, cells=cells, open_end=True)
            assert rows(got.select("a", "b", "dist", "norm_dist")) == want and len(want) > 50
    monkeypatch.setattr(pairs, "warp", None)
    for name in ("warp_search_closed", "warp_search_open", "warp_search_symmetric2"):
        assert catalogue.queries()[name](spark, small).columns == ["a", "b", "dist", "norm_dist"]


def test_expectation_by_scaled_probabilities_is_that_by_logarithms():
    """Reads that fit, and reads so far off that products of probabilities would vanish, in one batch."""
    rng, offsets = np.random.default_rng(8), H.check_offsets(H.OFFSETS)
    mean, std = rng.normal(0, 1, 30), np.full(30, 0.05)
    x = mean + rng.normal(0, 0.05, (12, 30))
    x[::3] = rng.normal(0, 3, (4, 30))
    moves = H.band(30, offsets, H.start_weights(30, offsets, 1.0))
    for xs in (np.full_like(x, 0.05), rng.uniform(0.05, 0.1, x.shape)):
        score = K.emission(x, xs, mean, std)
        share = H._ahead(np.moveaxis(score, 1, 0), moves, offsets)[0][0]
        assert 0 < (share > H.LEAST_SHARE).sum() < 12
        got, want = H.expectation(x, xs, mean, std, moves, offsets), H._by_logarithms(score, moves, offsets)
        for name, value in zip(("log_likelihood", "gamma", "counts"), want):
            np.testing.assert_allclose(got[name], value, rtol=1e-10, atol=1e-10)


def test_rows_of_a_round_do_not_grow_with_the_traces():
    """Each trace has a variance of its own; levels and variances are those of all single steps."""
    models, offsets = _models(16, 1)
    (mean, std, weights), rng, rows = models[0], np.random.default_rng(9), []
    moves = H.band(16, offsets, weights)
    for n in (200, 2000):
        x, xs = rng.normal(0, 1, (n, 16)), np.repeat(rng.uniform(0.1, 0.5, (n, 1)), 16, axis=1)
        if n == 200:
            xs *= rng.uniform(0.9, 1.1, xs.shape)
        frame = pd.DataFrame({"label": 0, "mean": list(x), "std": list(xs), "dwell": list(np.ones_like(x))})
        found = pd.concat(em._expect(models, offsets, "label", True)(iter([frame]))).groupby(["label", "state", "key"], as_index=False).sum()
        rows.append(len(found))
        got = np.stack(em._maximise(models, offsets, 1e-4, "label", True)((0, 0), found)["new"].iloc[1:])
        gamma = H.expectation(x, xs, mean, std, moves, offsets)["gamma"].reshape(-1, 16)
        level, var = H.fit_emissions(x.ravel(), xs.ravel() ** 2, gamma, mean, std**2, 1e-4)
        np.testing.assert_allclose(got[:, 0], level, atol=1e-10)
        np.testing.assert_allclose(got[:, 1], var, rtol=1e-10)
    assert rows[1] < 1.2 * rows[0] < 5000


def _uncapped(cost, weight: int, open_begin: bool, open_end: bool):
    """(distance, length, first column, last column) of one pair, cell by cell."""
    n, m = cost.shape
    best = {(0, j): (weight * cost[0, j], 1, j) for j in (range(m) if open_begin else (0,))}
    for i in range(n):
        for j in range(m):
            if (i, j) not in best:
                sources = (((i - 1, j - 1), weight), ((i - 1, j), 1), ((i, j - 1), 1))
                best[i, j] = min(((best[s][0] + w * cost[i, j], best[s][1] + 1, best[s][2]) for s, w in sources if s in best), key=lambda x: x[0])
    j = min(range(m), key=lambda j: best[n - 1, j][0]) if open_end else m - 1
    return *best[n - 1, j], j


def test_uncapped_warps_go_by_diagonals(monkeypatch):
    """Costs are made a diagonal at a time, not column by column of a row; distances, lengths, ends and paths are those of single cells."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(K.CostRows, "row", None)
    na, nb = rng.integers(1, 9, 30), rng.integers(1, 12, 30)
    x, y = rng.normal(size=(30, 8)), np.round(rng.normal(size=(30, 11)), 1)
    xs, ys = rng.uniform(0.1, 1, x.shape), rng.uniform(0.1, 1, y.shape)
    for kind in ("abs", "gaussian"):
        grid = K.cost_grid(kind, x, xs, y, ys)
        for step, ends in (("symmetric1", {}), ("symmetric2", {}), ("symmetric1", {"open_begin": True, "open_end": True})):
            w = K.Warp(K.CostRows(kind, x, xs, y, ys), na, nb, step=step, max_run=None, path=True, **ends)
            for k in range(30):
                dist, length, first, last = _uncapped(grid[k, : na[k], : nb[k]], 1 if step == "symmetric1" else 2, *(bool(ends),) * 2)
                path = w.path(k)
                assert np.isclose(w.dist[k], dist, rtol=1e-14) and (w.length[k], w.j_start[k], w.j_end[k]) == (length, first, last)
                assert len(path) == length and path[0].tolist() == [0, first] and path[-1].tolist() == [na[k] - 1, last]
                assert np.isin(np.diff(path, axis=0) @ [2, 1], (1, 2, 3)).all()


def test_silhouettes_and_candidates_without_edges(spark, small, monkeypatch):
    """The same as from an edge list, with tiles of one block and of many, copies, a group of one and a cluster of one among them."""
    g = fx.grid_traces(spark, small).where("label < 4").select(F.col("label").alias("grp"), "trace_id", "mean", "std", (F.col("trace_id") % 3).alias("label"))
    first = g.orderBy("trace_id").limit(1).drop("label")
    copies = first.drop("grp", "trace_id").select(F.lit(5).cast("long").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7))).alias("trace_id"), "mean", "std")
    g = g.unionByName(copies.withColumn("label", F.col("trace_id") % 2)).unionByName(first.withColumns({"grp": F.lit(6).cast("long"), "label": F.lit(0).cast("long")}))
    alone = g.where("grp = 1").agg(F.min("trace_id")).first()[0]
    g = g.withColumn("label", F.when(F.col("trace_id") == alone, 9).otherwise(F.col("label"))).cache()
    edges = pairs.squared_distances(g, "grp").cache()
    want = rows(clusters.silhouette(edges, g.select("grp", "trace_id", "label"), "grp"))
    assert len(want) == 5 and want[-1] == (5, 0.0)
    for cells in (squares.TILE_CELLS, (5 * 64) ** 2):
        assert rows(squares.silhouette(g, "grp", cells=cells)) == want
    ranks = clusters.medoid_ranking(catalogue.edges(spark, small), "label", top=5).where("rank > 1").count()

    def none(*args, **options):
        raise AssertionError("edges of all pairs")

    monkeypatch.setattr(pairs, "squared_distances", none)
    queries = catalogue.queries()
    assert queries["silhouette"](spark, small).count() == 10 and sum(r["n"] for r in evaluation_plans.perturbation_summary(spark, small).collect()) == ranks


def test_linkage_reads_few_rows_of_its_matrix(monkeypatch):
    """Merges are those of a search over all pairs, equal heights among them, and a step doesn't look at the whole matrix again."""
    rng, argmin, looked = np.random.default_rng(5), np.argmin, []
    monkeypatch.setattr(K.np, "argmin", lambda x, *a, **b: looked.append(np.size(x)) or argmin(x, *a, **b))
    for n in (2, 3, 40, 150):
        for method in ("single", "complete", "average", "weighted"):
            for x in (rng.normal(size=(n, n)) + 9, rng.integers(1, 4, (n, n)).astype(float)):
                d = np.triu(x, 1) + np.triu(x, 1).T
                looked.clear()
                got = K.linkage(d, method)
                assert sum(looked) <= 4 * n * n
                open_, size, name, want = np.where(np.eye(n) > 0, np.inf, d), np.ones(n), list(range(n)), []
                for step in range(n - 1):
                    i, j = divmod(int(open_.argmin()), n)
                    want.append((*sorted((name[i], name[j])), open_[i, j], size[i] + size[j]))
                    new = {"single": np.minimum(open_[i], open_[j]), "complete": np.maximum(open_[i], open_[j]), "average": (size[i] * open_[i] + size[j] * open_[j]) / (size[i] + size[j]), "weighted": (open_[i] + open_[j]) / 2}[method]
                    open_[i] = open_[:, i] = new
                    open_[j] = open_[:, j] = open_[i, i] = np.inf
                    name[i], size[i] = n + step, size[i] + size[j]
                assert np.array_equal(got, np.array(want))


def test_candidates_for_a_number_of_clusters_share_one_linkage(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame([(0, i, j, float(abs(i % 2 - j % 2) + rng.uniform(0, 0.2))) for i in range(20) for j in range(i + 1, 20)], "grp long, a long, b long, d double")
    fits = []
    monkeypatch.setattr(clusters, "spread", lambda frame, *keys: type("Rows", (), {"groupBy": lambda self, *k: type("Groups", (), {"applyInPandas": lambda self, fit, ddl: fits.append(fit)})()})())
    clusters.choose_clusters(edges, "grp")
    trees, linkage_ = [], K.linkage
    monkeypatch.setattr(K, "linkage", lambda *a: trees.append(1) or linkage_(*a))
    out = fits[0](edges.toPandas())
    assert len(trees) == 1 and out["k"].unique().tolist() == [2] and out["label"].tolist() == [k % 2 for k in range(20)]


def test_pairs_of_one_variance_each_share_their_logarithm(monkeypatch):
    """The same costs to the last bit, from one logarithm a pair."""
    rng, log, counted = np.random.default_rng(9), np.log, []
    x, y = rng.normal(size=(2, 20, 12))
    xs, ys = (np.repeat(rng.uniform(0.1, 1, (20, 1)), 12, axis=1) for _ in range(2))
    grid = K.cost_grid("gaussian", x, xs, y, ys)
    monkeypatch.setattr(K.np, "log", lambda v, *a, **b: counted.append(np.size(v)) or log(v, *a, **b))
    for stds, most in ((ys, 20), (ys * rng.uniform(0.9, 1.1, ys.shape), None)):
        counted.clear()
        costs = K.CostRows("gaussian", x, xs, y, stds)
        got = np.stack([costs.row(i, 0, 12).T for i in range(12)], axis=1)
        slanted = [costs.diagonal(k, max(0, k - 11), min(12, k + 1)) for k in range(23)]
        assert sum(counted) == (20 if most else 2 * 20 * 144)
        for k, d in enumerate(slanted):
            assert np.array_equal(d, np.stack([got[:, i, k - i] for i in range(max(0, k - 11), min(12, k + 1))]))
        if most:
            assert np.allclose(got, grid, rtol=1e-14, atol=1e-14)

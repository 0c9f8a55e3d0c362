"""Checks, controls, gates and audits of studies against small cases by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import alignment, evaluation, metrics
from sigspark.plans import catalogue
from sigspark.sources import fixtures, io


def grid(spark, rows):
    return spark.createDataFrame(rows, "event_id long, truth long, label long, score double")


def test_spoilt_grids_are_errors(spark):
    fine = [(1, 0, 0, 0.5), (1, 0, 1, 0.7), (2, 1, 0, float("inf")), (2, 1, 1, 0.1)]
    assert evaluation.checked_grid(grid(spark, fine)).count() == 4
    for bad, name in (((3, 0, 0, float("nan")), "nan"), ((3, 0, 0, None), "nan"), ((3, 0, 0, float("-inf")), "wrong infinity"), ((3, 0, 0, float("inf")), "no admissible score")):
        with pytest.raises(ValueError, match=name):
            evaluation.checked_grid(grid(spark, [*fine, bad]))
    with pytest.raises(ValueError, match="wrong infinity"):
        evaluation.checked_grid(grid(spark, fine), lower=False)


def test_tasks(spark):
    rows = [(e, e % 3, k, float(abs(e % 3 - k) + (e == 4 and k == 1) * 5)) for e in range(9) for k in range(3)]
    tasks = evaluation.task_table(spark, {"all": [0, 1, 2], "two": [1, 2]})
    got = {r["task"]: r for r in evaluation.task_classification(grid(spark, rows), tasks).collect()}
    assert got["all"]["events"] == 9 and got["all"]["accuracy"] == pytest.approx(8 / 9)
    assert got["two"]["events"] == 6 and got["two"]["balanced_accuracy"] == pytest.approx((2 / 3 + 1) / 2)
    higher = evaluation.task_classification(grid(spark, [(e, t, k, -s) for e, t, k, s in rows]), tasks, lower=False)
    assert {r["task"]: r for r in higher.collect()} == got
    for bad in ({"x": []}, {"x": [1, 1]}):
        with pytest.raises(ValueError):
            evaluation.task_table(spark, bad)


def test_pairs_of_labels(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 1, 3.0), (2, 0, 0, 2.0), (2, 0, 1, 2.0), (3, 1, 0, 4.0), (3, 1, 1, 1.0), (4, 1, 0, 1.0), (4, 1, 1, 1.0), (5, 2, 0, 9.0), (5, 2, 1, 9.0)]
    [r] = evaluation.pair_table(grid(spark, rows)).collect()
    # margins: -2 and 0 for a, 3 and 0 for b
    assert (r["a"], r["b"], r["events"], r["balanced_accuracy"]) == (0, 1, 4, 0.75)
    assert r["auroc"] == pytest.approx((1 + 1 + 1 + 0.5) / 4) and r["separation"] == pytest.approx((3 + 2 + 4 + 1) / (1 + 2 + 1 + 1))


def test_joins_with_checks(spark):
    a, b = (spark.createDataFrame([(1, x), (2, x)], f"k int, {x} string") for x in "ab")
    assert evaluation.checked_join([a, b], ["k"], 2).count() == 2
    with pytest.raises(ValueError):
        evaluation.checked_join([a, b], ["k"], 3)
    for broken in (b.where("k = 1"), b.union(b.where("k = 1"))):
        with pytest.raises(ValueError, match="repeated or missing key"):
            evaluation.checked_join([a, broken], ["k"])


def test_gates(spark):
    rows = evaluation.gate_rows(spark.range(5), {"some": (F.count(F.lit(1)) > 3, F.count(F.lit(1))), "even": (F.bool_and(F.col("id") % 2 == 0), F.max("id"))})
    assert {(r["check"], r["passed"], r["detail"]) for r in rows.collect()} == {("some", True, "5"), ("even", False, "4")}
    evaluation.require(rows.where("passed"))
    with pytest.raises(ValueError, match="even"):
        evaluation.require(rows)


def test_controls_keep_the_steps(spark, small):
    g = fixtures.grid_traces(spark, small).limit(5).cache()
    rows = {r["trace_id"]: r for r in g.collect()}
    for r in evaluation.reversed_traces(g).collect():
        assert r["mean"] == rows[r["trace_id"]]["mean"][::-1]
    a, b = ({r["trace_id"]: r for r in evaluation.shuffled_traces(g, s).collect()} for s in (1, 2))
    for k, r in a.items():
        assert sorted(r["mean"]) == sorted(rows[k]["mean"]) and r["mean"] != rows[k]["mean"] and r["mean"] != b[k]["mean"]


@pytest.fixture(scope="module")
def hmms(spark, small):
    return catalogue.hmm_profiles(spark, small).cache()


def test_posteriors(spark, small, hmms):
    held = fixtures.grid_traces(spark, small).where("NOT is_training").limit(6)
    scores = {(r["trace_id"], r["label"]): r["score"] for r in alignment.score_against(held, hmms, "label", "hmm", min_std=0.05).collect()}
    for r in evaluation.hmm_posteriors(held, hmms, "label", min_std=0.05).collect():
        assert r["log_likelihood"] == pytest.approx(scores[r["trace_id"], r["label"]])
        assert np.sum(r["posterior"], axis=1) == pytest.approx(np.ones(len(r["posterior"])))


def test_hmm_gates_take_the_floor_of_the_fit(spark, hmms):
    n = hmms.select("label", F.lit(4).alias("n_reads"))
    reasons = lambda p: {r["label"]: set(r["reasons"]) for r in alignment.hmm_gates(p, "label", n).collect()}
    sane = reasons(hmms)
    assert all("a parameter is not finite" not in x and "a state without a move" not in x for x in sane.values())
    assert all("stds at their floor" in x for x in reasons(hmms.withColumn("std", F.transform("std", lambda s: F.col("min_std")))).values())
    assert all("a parameter is not finite" in x for x in reasons(hmms.withColumn("mean", F.transform("mean", lambda s: F.lit(float("nan"))))).values())
    assert all("the trace has not a likelihood for each update" in x for x in reasons(hmms.withColumn("n_iter", F.col("n_iter") + 1)).values())
    assert all("a likelihood is not finite" in x for x in reasons(hmms.withColumn("log_likelihood", F.transform("log_likelihood", lambda x: F.lit(float("-inf"))))).values())
    # dwells count where positions are supported only
    odd = hmms.withColumn("dwell", F.transform("dwell", lambda x, i: F.when(i == 0, 1e6).otherwise(1.0))).withColumn("depth", F.transform("depth", lambda x, i: F.when(i == 0, 0.0).otherwise(99.0)))
    assert all("dwells too uneven" not in x for x in reasons(odd).values())
    assert all("dwells too uneven" in x for x in reasons(odd.withColumn("depth", F.transform("depth", lambda x: F.lit(99.0)))).values())
    for r in hmms.collect():
        assert r["final_log_likelihood"] == r["log_likelihood"][-1] and r["cap_hit"] == (not r["converged"]) and (r["min_std"], r["max_iter"]) == (0.05, 20)


def test_fit_settings_are_checked(spark, small):
    for bad in (True, 0, 2.5):
        with pytest.raises(ValueError):
            alignment.fit_profile_hmms(fixtures.grid_traces(spark, small), "label", max_iter=bad)


def test_warps_onto_an_axis(spark, small):
    train = fixtures.grid_traces(spark, small).where("is_training")
    profiles = catalogue.fitted(spark, small)
    rows = evaluation.warp_to_axis(train.where("label = 1"), profiles, "label").toPandas()
    length = len(profiles.where("label = 1").first()["mean"])
    assert set(rows["pos"]) == set(range(length)) and rows["value"].notna().mean() > 0.5
    own = profiles.withColumnRenamed("label", "trace_id").select("trace_id", F.col("trace_id").alias("label"), "mean", "std").where("label = 1")
    same = evaluation.warp_to_axis(own, profiles, "label", normalise=False).toPandas().sort_values("pos")
    assert same["value"].to_numpy() == pytest.approx(np.array(profiles.where("label = 1").first()["mean"]))


def test_reads_to_clusters_to_medoids(spark):
    rows = [(i, 0, [float(i % 2) * 5 + 0.01 * i + k for k in range(6)] if i % 2 else [6.0 - k + 0.01 * i for k in range(6)], [0.1] * 6) for i in range(6)]
    traces = spark.createDataFrame(rows, "trace_id long, grp long, mean array<double>, std array<double>")
    got = {tuple(r["members"]): r for r in evaluation.cluster_reads(traces, "grp", n_clusters=2).collect()}
    assert set(got) == {(0, 2, 4), (1, 3, 5)}
    assert all(r["n_reads"] == 3 and r["members"][r["medoid_position"]] == r["medoid"] for r in got.values())


def plain_ranks(rows):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2]]
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    if not pos:
        return None, None
    auroc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]) if neg else None
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    hits = np.cumsum([y for _, y, _ in order])
    return auroc, sum(hits[k] / (k + 1) for k, (_, y, _) in enumerate(order) if y) / len(pos)


def test_rank_metrics_do_not_depend_on_ranges(spark):
    """With ties, a third of all rows of one score, a long tail, infinities, and missing truths and scores."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.random() < 0.3), float(round(rng.normal(), 1)) if i % 3 else 1.0) for i in range(400)]
    rows += [(400 + i, i % 2, float(np.exp(rng.normal(0, 5)))) for i in range(50)] + [(500, 1, float("inf")), (501, 0, float("-inf")), (502, 1, None), (503, None, 3.0), (504, 0, float("nan"))]
    frame = spark.createDataFrame(rows, "id long, y int, s double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            assert tuple(metrics.rank_metrics(frame, "y", "s", "id").first()) == pytest.approx(plain_ranks(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = {r["g"]: (r["auroc"], r["average_precision"]) for r in metrics.rank_metrics(frame.withColumn("g", F.when(F.col("id") < 300, 0).when(F.col("id") < 450, 1).otherwise(F.col("id"))), "y", "s", "id", "g").collect()}
    assert by[0] == pytest.approx(plain_ranks(rows[:300])) and by[1] == pytest.approx(plain_ranks(rows[300:450]))
    assert by[500] == (None, 1.0) and by[501] == (None, None) and 502 not in by
    assert tuple(metrics.rank_metrics(frame.limit(0), "y", "s", "id").first()) == (None, None)


def test_ranges_hold_like_numbers_of_rows(spark):
    """Log-normal scores with outliers, a fifth of them equal: no range has more than twice the mean."""
    frame = spark.range(40_000).select("id", F.when(F.col("id") % 5 == 0, 1.0).when(F.col("id") % 1000 == 1, F.exp(F.col("id") / 100.0)).otherwise(F.exp(3 * F.randn(7))).alias("s"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        ranged = frame.repartitionByRange(16, F.col("s").desc(), "id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert ranged.max() < 2 * ranged.mean() and len(ranged) == 16
        got = metrics.running(frame, [("s", True), ("id", False)], {"place": F.lit(1)})
        assert got.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (0, 39_999, 40_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_provenance(spark, tmp_path):
    path = tmp_path / "some.bin"
    path.write_bytes(bytes(range(256)) * 9000)
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert io.file_digest(spark, f"file://{path}") == digest
    io.verify_digests(spark, {f"file://{path}": digest})
    with pytest.raises(ValueError, match="some.bin"):
        io.verify_digests(spark, {f"file://{path}": "0" * 64})
    assert io.code_state(str(tmp_path)) == {"commit": None, "dirty": None}
    io.write_summary({"x": np.float64(0.5)}, f"file://{tmp_path}/s.json", spark)
    assert (tmp_path / "s.json").read_text() == '{\n  "x": 0.5\n}'

"""The synthetic demonstration, large-group fits, sinks, streams and guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import consensus, pairs, regions, resample, robust
from sigspark.plans import studies
from sigspark.sources import fixtures, io


def test_demonstration(spark):
    d = studies.demonstration(spark)
    assert d["medoid"] == 0 and d["iterations"] == 8 and d["converged"] and d["supported"].all() and d["depth"].min() == 16
    assert d["consensus_rmse"] == pytest.approx(0.02526325901406634, abs=1e-12)
    assert d["medoid_rmse"] == pytest.approx(0.02538295553145976, abs=1e-12)


def test_large_group_fit_equals_group_fit(spark, small):
    traces = fixtures.grid_traces(spark, small).where("label = 1 AND is_training")
    own = consensus.fit_barycentres(traces, "label", normalise=False, max_iter=3).first()
    large = consensus.fit_barycentres(traces, "label", normalise=False, max_iter=3, group_cells=1).first()
    assert large["mean"] == pytest.approx(own["mean"]) and large["depth"] == own["depth"] and large["medoid_id"] == own["medoid_id"]


def test_uncapped_fold_equals_kernel(spark, small):
    g = fixtures.grid_traces(spark, small).where("trace_id < 20").select("trace_id", F.slice("mean", 1, 8).alias("mean"), F.slice("std", 1, 8).alias("std"), F.lit(1).alias("k"))
    p = pairs.unordered_pairs(g, "k")
    want = {(r["a"], r["b"]): r["dist"] for r in pairs.warp(p, g, g, cost="abs", normalise=False, max_run=None).collect()}
    x = p.join(g.select(F.col("trace_id").alias("a"), F.col("mean").alias("x")), "a").join(g.select(F.col("trace_id").alias("b"), F.col("mean").alias("y")), "b")
    got = {(r["a"], r["b"]): r["d"] for r in x.select("a", "b", pairs.uncapped_distance(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got == pytest.approx(want)


def test_resample_values(spark):
    frame = spark.createDataFrame([(0, [0.3, 0.3, 0.6], [0.1, 0.1, 0.1], [1.0] * 3), (1, [1.0, 1.0], [1.0, 3.0], [1.0] * 2)], "trace_id long, mean array<double>, std array<double>, dwell array<double>")
    assert resample.resample(frame, 6).where("trace_id = 0").first()["mean"] == pytest.approx([0.3, 0.3, 0.3, 0.36, 0.48, 0.6])
    assert resample.resample(frame, 3).where("trace_id = 1").first()["std"] == pytest.approx([1, 5**0.5, 3])
    with pytest.raises(ValueError):
        resample.resample(frame, 1)


def test_target_length(spark):
    rows = [("small", 10)] * 3 + [("large", 2)] * 100 + [("large", 12)] + [("determining", n) for n in (10, 11, 12, 13)]
    row = resample.target_length(spark.createDataFrame(rows, "k string, n long"), "k").first()
    assert row["target"] == 13 and row["determining"] == ["determining"]


def test_valid_trace(spark):
    rows = [([1.0], [0.1], [1.0]), ([], [], []), ([1.0, float("nan")], [0.1] * 2, [1.0] * 2), ([1.0], [-0.1], [1.0]), ([1.0], [0.1, 0.2], [1.0]), ([float("inf")], [0.1], [1.0])]
    got = spark.createDataFrame(rows, "mean array<double>, std array<double>, dwell array<double>").select(robust.valid_trace().alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, False, False]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double")
    assert io.write_csv([a, b], f"{tmp_path}/out")
    back = io.read_csv_text(spark, f"{tmp_path}/out")
    assert back.columns == ["i", "s", "d"] and back.count() == 2 and set(dict(back.dtypes).values()) == {"string"}
    assert not io.write_csv([a.limit(0)], f"{tmp_path}/none") and not (tmp_path / "none").exists()
    io.write_csv_fields(b, f"{tmp_path}/fields", ["d"])
    assert io.read_csv_text(spark, f"{tmp_path}/fields").columns == ["d"]
    assert io.json_rows(a).first()["json"] == '{"i":1,"s":"x"}'
    io.write_summary({"x": np.float64(1.5), "p": tmp_path, "a": np.arange(2)}, f"{tmp_path}/s.json")
    with pytest.raises(FileNotFoundError):
        io.read_kmer_table(spark, None, "NO_SUCH_VARIABLE")
    with pytest.raises(FileNotFoundError):
        io.dataset_paths(spark, str(tmp_path), ["none"])


def test_annotations(spark, tmp_path):
    rows = [(2, 0, 100, 10, 40, 40, 90), (1, 0, 100, 50, 40, 40, 90)]
    spark.createDataFrame(rows, ", ".join(f"`{c}` long" for c in io.ANNOTATION)).write.parquet(f"{tmp_path}/a")
    got = io.read_annotations(spark, f"{tmp_path}/a", strict=False).collect()
    assert [(r["index"], r["ok"]) for r in got] == [(1, False), (2, True)]
    with pytest.raises(Exception, match="annotation out of order"):
        io.read_annotations(spark, f"{tmp_path}/a").collect()


def test_recordings(spark):
    rng = np.random.default_rng(9)
    raw = np.concatenate([rng.normal(m, 0.1, 50) for m in (0, 1, 0.4, 2)])
    channels = io.calibrate(spark.createDataFrame([("d", 100.0, 0.0, 1.0, 1.0, raw.tolist())], "dataset string, sample_rate double, offset double, range double, digitisation double, samples array<double>"))
    steps = studies.recording_segments(channels, spark.createDataFrame([("d", 1, 50, 200)], "dataset string, index long, start_idx long, end_idx long"))
    assert [(r["start_sample"], r["end_sample"]) for r in steps.orderBy("pos").collect()] == [(50, 100), (100, 150), (150, 200)]


def test_set_overlap_of_nothing(spark):
    none = spark.createDataFrame([], "k long")
    assert regions.set_overlap(none, none, "k").first()["jaccard"] == 1.0


def test_streams(spark, small, tmp_path):
    from sigspark.streaming import scorer

    traces = fixtures.grid_traces(spark, small).where("trace_id < 30")
    traces.write.parquet(f"{tmp_path}/in")
    profiles = traces.where("trace_id < 3").select(F.col("trace_id").alias("key"), "mean", "std")
    stream = spark.readStream.schema(traces.schema).parquet(f"{tmp_path}/in")
    q = scorer.score_stream(stream, profiles, "key").writeStream.format("memory").queryName("scores").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scores").count() == 90


def test_ablation_has_eight_conditions_and_paired_differences(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(48):
        n, shape = 12 + i % 7, i % 3
        level = np.sin(np.linspace(0, 2 + 2 * shape, n)) + rng.normal(0, 0.05, n)
        rows.append((i, shape, i % 2 == 0 if i < 24 else i % 4 < 2, level.tolist(), [0.1] * n, [1.0] * n))
    traces = spark.createDataFrame(rows, "trace_id long, construct long, is_training boolean, mean array<double>, std array<double>, dwell array<double>")
    got, differences = studies.ablation(traces, "construct", fixed=20, replicates=40, max_iter=2)
    got = {r["condition"]: r for r in got.collect()}
    assert set(got) == {"T", "TO", "TN_p95", "TN_fixed_20", "TON_p95", "TON_fixed_20", "TNO_p95", "TNO_fixed_20"}
    lengths = {k: [len(r[3]) for r in rows if r[1] == k and r[2]] for k in range(3)}
    assert got["TN_p95"]["target"] == int(np.ceil(max(np.percentile(v, 95) for v in lengths.values())))
    assert len({r["events"] for r in got.values()}) == 1
    assert all(r[f"{m}_low"] <= r[f"{m}_high"] for r in got.values() for m in studies.METRICS)
    differences = differences.collect()
    assert {(r["condition_a"], r["condition_b"]) for r in differences} == set(studies.contrasts(20)) and len(differences) == 21
    for r in differences:
        assert r["estimate"] == pytest.approx(got[r["condition_a"]][r["metric"]] - got[r["condition_b"]][r["metric"]]) and r["replicates"] == 40

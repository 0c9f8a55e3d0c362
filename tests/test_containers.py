"""Containers of arrays against numpy: splits, patterns, filters, sinks, and the caches' checks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.sources import containers as C


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(1)
    arrays = {"mean_0": r.normal(size=7), "std_0": np.arange(7), "flag": np.array(True), "matrix": r.normal(size=(50, 30)), "cube": r.normal(size=(4, 3, 2)).astype("f4"), "column": np.asfortranarray(r.normal(size=(6, 5))), "name": np.array("peptide é"), "none": np.zeros(0), "flat": np.zeros((3, 0)), "big": r.integers(-5, 5, (200, 100))}
    np.savez(tmp_path / "a.npz", **arrays)
    np.savez_compressed(tmp_path / "b.npz", **arrays)
    (tmp_path / "other.txt").write_text("no container")
    return str(tmp_path), arrays


def expected(arrays):
    out = {}
    for name, x in arrays.items():
        for r, values in enumerate(x.reshape(x.shape[0], -1) if x.ndim > 1 else [np.atleast_1d(x)]):
            out[name, r] = list(x.shape), values.tolist()
    return out


@pytest.mark.parametrize("split", [300, 4096, 1 << 30])
def test_every_slice_once_whatever_the_splits(spark, folder, split):
    path, arrays = folder
    rows = C.read_arrays(spark, path, split=split).collect()
    want = expected(arrays)
    for file in "ab":
        own = [r for r in rows if r["path"].endswith(f"{file}.npz")]
        assert len(own) == len({(r["member"], r["row"]) for r in own}) == len(want)
        for r in own:
            shape, values = want[r["member"], r["row"]]
            got = r["texts"] if r["member"] == "name" else r["values"]
            assert (r["shape"], got) == (shape, values)
            assert (r["texts"] is None) == (r["member"] != "name")


def test_patterns_headers_and_filters(spark, folder):
    path, arrays = folder
    assert {r["member"] for r in C.read_arrays(spark, path, "*_0").collect()} == {"mean_0", "std_0"}
    heads = C.read_arrays(spark, path, columns=("member", "row")).collect()
    assert len(heads) == 2 * len(expected(arrays))
    own = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = C.read_arrays(spark, path + "/a.npz", split=1000).where("member = 'big' AND row >= 190 AND row < 195 AND size(values) = 100")
        assert sorted(r["row"] for r in frame.collect()) == [190, 191, 192, 193, 194]
        got = C.read_arrays(spark, path).where("member IN ('flag', 'name') AND path LIKE '%b.npz'").collect()
        assert {r["member"] for r in got} == {"flag", "name"} and len(got) == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", own)


def test_what_is_no_array_of_numbers_or_texts(spark, tmp_path):
    np.savez(tmp_path / "o.npz", x=np.array([{"a": 1}], object))
    with pytest.raises(Exception, match="not numbers or texts"):
        C.read_arrays(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no containers"):
        C.read_arrays(spark, str(tmp_path / "missing")).collect()


def test_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).select(F.concat(F.lit("m_"), F.col("id").cast("string")).alias("member"), F.transform(F.sequence(F.lit(0), (F.col("id") % 5).cast("int")), lambda x: x / 2).alias("values"))
    for _ in range(2):  # again, in the place of the first
        C.write_arrays(rows.repartition(3, "member"), path)
        assert len([f for f in os.listdir(path) if f.endswith(".npz")]) == 3
    got = {r["member"]: r["values"] for r in C.read_arrays(spark, path).collect()}
    assert got == {r["member"]: r["values"] for r in rows.collect()}
    loaded = {}
    for f in os.listdir(path):
        if f.endswith(".npz"):
            loaded |= {k: v.tolist() for k, v in np.load(f"{path}/{f}").items()}
    assert loaded == got
    C.write_arrays(rows.where("member = 'm_1'"), path, "append")
    assert C.read_arrays(spark, path, "m_1").count() == 2
    with pytest.raises(Exception, match="needs a name"):
        C.write_arrays(rows.select(F.lit(None).cast("string").alias("member"), "values"), path, "append")
    assert C.read_arrays(spark, path).count() == 101


def test_retried_tasks_leave_one_file(tmp_path):
    writer = C.Writer({"path": str(tmp_path)}, False)
    for attempt in (1, 2):
        np.savez(tmp_path / f"part-00000-{attempt}-{writer.job}.npz", x=np.zeros(1))
    np.savez(tmp_path / "earlier.npz", x=np.zeros(1))
    writer.commit([C.Written(str(tmp_path / f"part-00000-2-{writer.job}.npz")), C.Written(None), None])
    assert sorted(os.listdir(tmp_path)) == ["earlier.npz", f"part-00000-2-{writer.job}.npz"]
    writer.abort([])
    assert os.listdir(tmp_path) == ["earlier.npz"]


def test_trace_cache(spark, tmp_path):
    r = np.random.default_rng(2)
    arrays = {f"{c}_{i}": r.normal(size=5 + i) for i in range(6) for c in ("mean", "std", "dwell")}
    del arrays["dwell_2"]
    arrays["std_3"] = np.zeros(4)
    arrays["mean_4"][1] = np.nan
    np.savez(tmp_path / "traces.npz", **arrays)
    rows = spark.createDataFrame([(i, 5 + i + (i == 5), "other") for i in (0, 1, 2, 3, 4, 5, 7)] + [(0, 5, "again"), (None, 5, "no index")], "index long, n_steps long, mean string")
    got = C.read_trace_cache(spark, str(tmp_path), rows, strict=False).collect()
    problems = {r["index"]: r["problem"] for r in got}
    assert len(got) == 9 and problems[0] is problems[1] is None
    words = {2: "lacks a channel", 3: "different shapes", 4: "aren't finite", 5: "differs in length", 7: "isn't cached", None: "isn't cached"}
    assert all(w in problems[k] for k, w in words.items())
    assert all(r["mean"] == arrays[f"mean_{r['index']}"].tolist() for r in got if r["problem"] is None)
    good = C.read_trace_cache(spark, str(tmp_path), rows.where("index < 2"))
    assert good.columns == ["index", "n_steps", "mean", "std", "dwell"] and good.count() == 3
    with pytest.raises(Exception, match="trace 7 isn't cached"):
        C.read_trace_cache(spark, str(tmp_path), rows.where("index IN (0, 7)")).where("size(mean) > 2").collect()
    with pytest.raises(Exception, match="trace 5 differs in length"):
        C.read_trace_cache(spark, str(tmp_path), rows.where("index = 5")).collect()


def test_distance_cache(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.random((5, 5))
    good = x + x.T
    np.fill_diagonal(good, 0)
    bad, diagonal = good.copy(), good.copy()
    bad[1, 3] += 1e-3
    diagonal[2, 2] = 1
    np.savez(tmp_path / "d.npz", good=good, bad=bad, diagonal=diagonal, small=good[:3, :3], one=np.zeros((1, 1)))
    axis = lambda g, n: [(g, k, 100 - k) for k in range(n)]
    table = spark.createDataFrame(axis("good", 5) + axis("one", 1), "group string, position long, trace_id long")
    got = {(r["a"], r["b"]): r["d"] for r in C.read_distance_cache(spark, str(tmp_path), table).collect()}
    assert got == {(100 - j, 100 - i): good[i, j] for i in range(5) for j in range(i + 1, 5)}
    for name, n, words in (("bad", 5, "not symmetric at 1, 3"), ("diagonal", 5, "diagonal isn't zero at 2"), ("small", 5, "matrix and rows differ"), ("absent", 2, "matrix and rows differ")):
        table = spark.createDataFrame(axis(name, n), "group string, position long, trace_id long")
        with pytest.raises(Exception, match=words.split(" at ")[0]):
            C.read_distance_cache(spark, str(tmp_path), table).collect()
        assert any(words in (r["problem"] or "") for r in C.read_distance_cache(spark, str(tmp_path), table, strict=False).collect())


def test_profile_cache(spark, tmp_path):
    for k in range(3):
        np.savez(tmp_path / f"rank{k}.npz", mean=np.arange(4.0), std=np.ones(4 - (k == 2)), supported=np.ones(4, bool), converged=np.array(k == 0), construct=np.array("p"), more=np.zeros((2, 2)))
    got = {os.path.basename(r["path"]): r for r in C.read_profile_cache(spark, str(tmp_path), texts=("construct",), strict=False).collect()}
    assert got["rank0.npz"]["problem"] is None and got["rank0.npz"]["converged"] == 1 and got["rank1.npz"]["converged"] == 0
    assert got["rank0.npz"]["construct"] == "p" and "differ in shape" in got["rank2.npz"]["problem"]
    with pytest.raises(Exception, match="lacks a member"):
        C.read_profile_cache(spark, str(tmp_path), scalars=("absent",)).collect()

"""Both jobs on copies: growing input, reruns, odd rows, and their command lines."""

import json
import logging
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import _common, design_levels, trace_cohorts
from sigspark.operators import lut
from sigspark.sources import fixtures

from conftest import ROOT

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def plain_levels(text, table, k=6):
    bases = "".join("ACGT"[LETTERS.index(c.upper()) % 4] if c.upper() != "Y" and c.upper() != "Z" else "AC"["YZ".index(c.upper())] for c in text or "" if c in LETTERS + LETTERS.lower())
    kmers = [bases[i : i + k] for i in range(len(bases) - k + 1)]
    known = [table[x] for x in kmers if x in table]
    mean = lambda i: sum(v[i] for v in known) / len(known) if known else None
    status = "short" if not kmers else "covered" if len(known) >= 0.4 * len(kmers) else "uncovered"
    return len(bases), len(kmers), len(known), mean(0), mean(1), status


def test_levels_of_growing_texts(spark, small, tmp_path, caplog):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").limit(60).cache()
    table = {r["kmer"]: (r["pre_mean"], r["post_mean"]) for r in fixtures.kmer_table(spark, small).collect()}
    folder, out, parts = f"file://{tmp_path}/docs", f"file://{tmp_path}/out", f"{small}/part.parquet"
    odd = [(None, "no id ABCDEF"), (1, None), (2, ""), (3, "ACGTA"), (4, "12 é ß 中"), (5, "acgtac"), (5, "acgtac"), (6, "the quick brown fox " * 9000)]
    docs.where("doc_id % 2 = 0").select("doc_id", "text").coalesce(1).write.parquet(folder)
    run = lambda: design_levels.run(spark, design_levels.DEFAULTS, folder, parts, out)
    caplog.set_level(logging.INFO, "jobs.design_levels")
    assert run() == [0]
    first = rows(design_levels.read(spark, out))
    spark.createDataFrame(odd, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    docs.where("doc_id % 2 = 1").select("doc_id", "text").coalesce(1).write.mode("append").parquet(folder)
    assert run() == [1]  # both new files, and nothing else
    got = design_levels.read(spark, out)
    assert [r for r in rows(got) if r[6] == 0] == first
    assert run() == [] and "nothing new" in caplog.text and "batch 1 of" in caplog.text
    want = [(d, *plain_levels(t, table)) for d, t in [*((r["doc_id"], r["text"]) for r in docs.collect()), *odd]]
    found = rows(got.drop("batch"))
    assert len(found) == len(want)
    for a, b in zip(found, sorted(want, key=str)):
        assert a == tuple(pytest.approx(x, abs=1e-6) if isinstance(x, float) else x for x in b)
    # all at once gives the same rows, and so does a batch that is taken again
    design_levels.run(spark, design_levels.DEFAULTS | {"files_per_batch": 1}, folder, parts, f"{out}-whole")
    assert rows(design_levels.read(spark, f"{out}-whole").drop("batch")) == found
    for name in ("1", ".1.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink()
    assert run() == [1] and rows(design_levels.read(spark, out).drop("batch")) == found


def test_levels_of_an_empty_folder(spark, small, tmp_path):
    folder, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(folder)
    design_levels.run(spark, design_levels.DEFAULTS, folder, f"{small}/part.parquet", out)
    assert design_levels.read(spark, out).count() == 0


def test_template_segments(spark, small):
    """Segments change nothing, whatever their length; a k beyond what goes to all tasks is joined."""
    one = spark.createDataFrame([(1, "ACGTTGCA" * 40), (2, "ACG"), (3, None)], "id long, template string")
    kmers = fixtures.kmer_table(spark, small)
    whole = rows(lut.template_levels(one, kmers, "id"))
    assert all(rows(lut.template_levels(one, kmers, "id", segment=s)) == whole for s in (1, 7, 64))
    assert [r[:4] for r in whole] == [(1, 320, 315, whole[0][3]), (2, 3, 0, 0), (3, None, 0, 0)]
    long = lut.template_levels(one, kmers.withColumn("kmer", F.concat("kmer", F.lit("ACG"))), "id", k=9)
    assert rows(long)[0][2] == 312


def test_cohorts_rerun_to_the_same_rows(spark, small, tmp_path, caplog):
    out = f"file://{tmp_path}/out"
    events = spark.read.parquet(f"{small}/events.parquet")
    odd = events.where("user_id = 3").withColumns({"user_id": F.lit(900).cast("long"), "value": F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))})
    events.unionByName(odd.select(*[F.col(c).cast(events.schema[c].dataType) for c in events.columns])).withColumn("construct", F.lit("clash")).write.parquet(f"{tmp_path}/events")
    config = trace_cohorts.DEFAULTS | {"least_steps": 40}
    seen = []
    caplog.set_level(logging.INFO, "jobs.trace_cohorts")
    for _ in range(2):
        trace_cohorts.run(spark, config, f"file://{tmp_path}/events", out)
        seen.append([rows(trace_cohorts.read(spark, out, n)) for n in ("manifest", "prepared", "lengths")])
    assert seen[0] == seen[1] and "wrote" in caplog.text
    manifest = trace_cohorts.read(spark, out, "manifest")
    assert manifest.count() == events.select("user_id").distinct().count() + 1
    assert manifest.where("trace_id = 900").first()["exclusion_reason"] == "invalid"
    z = trace_cohorts.read(spark, out, "prepared").groupBy("trace_id").agg(F.median("z").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = z.join(manifest, "trace_id").collect()
    assert all(abs(r["m"]) < 1e-9 and r[2] == r["kept"] >= 40 for r in joined) and len(joined) == manifest.where("exclusion_reason IS NULL").count()


def test_settings(spark, tmp_path):
    for name, job in (("design_levels", design_levels), ("trace_cohorts", trace_cohorts)):
        assert _common.settings(spark, f"file://{ROOT}/jobs/{name}.json", job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "c.json").write_text(json.dumps({"fold": 3}))
    with pytest.raises(ValueError, match="unknown settings: fold"):
        _common.settings(spark, str(tmp_path / "c.json"), trace_cohorts.DEFAULTS)


@pytest.mark.parametrize("name, inputs", [("design_levels", ("documents", "part")), ("trace_cohorts", ("events",))])
def test_command_lines(spark, small, tmp_path, name, inputs):
    flags = [x for t in inputs for x in (f"--{'parts' if t == 'part' else t}", f"{small}/{t}.parquet")]
    ran = subprocess.run([sys.executable, f"{ROOT}/jobs/{name}.py", "--config", f"{ROOT}/jobs/{name}.json", *flags, "--output", f"file://{tmp_path}/out"], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert f"jobs.{name}" in ran.stderr
    assert spark.read.parquet(f"file://{tmp_path}/out/{'levels' if name == 'design_levels' else 'manifest'}").count() > 0

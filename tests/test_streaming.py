"""Traces from a stream equal the traces of the whole table, in whatever order the steps come."""

import pytest
from pyspark.sql import functions as F

from sigspark.sources import fixtures as fx
from sigspark.streaming import assembly, scorer

STEP = "trace_id long, event_id long, ts timestamp, mean double, std double"


def run(spark, folder, out, files, **options):
    """Takes the files one after the other in one query; gives the closed traces and the late rows."""
    stream = spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(folder)
    query = assembly.assemble(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(assembly.TRACE).parquet(out), assembly.late_rows(query)


def test_shuffled_steps_give_the_traces_of_the_table(spark, small, tmp_path):
    folder, out = f"file://{tmp_path}/steps", f"file://{tmp_path}/out"
    own = fx.table(spark, small, "events").where("user_id < 8")
    steps = own.select(F.col("user_id").alias("trace_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("mean"), (F.lit(0.5) + F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100).alias("std"))
    for k in range(3):  # each file has steps of all times and traces
        steps.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(folder)
    last = spark.createDataFrame([(999, 1, 0.0, 1.0)], "trace_id long, event_id long, mean double, std double").withColumn("ts", F.lit("2099-01-01").cast("timestamp")).select("trace_id", "event_id", "ts", "mean", "std")
    last.coalesce(1).write.mode("append").parquet(folder)
    closed, late = run(spark, folder, out, 4, gap="3650 days", late="3650 days")
    want = {r["trace_id"]: r for r in fx.nest(fx.event_steps(own)).collect()}
    got = {r["trace_id"]: r for r in closed.collect()}
    assert set(got) == set(want) and late == 0 and closed.count() == len(got)
    for k, r in got.items():
        assert (r["mean"], r["std"]) == (want[k]["mean"], want[k]["std"]) and r["dwell"] == pytest.approx(want[k]["dwell"]) and r["n"] == len(r["mean"])


def test_gaps_part_traces_and_late_rows_are_counted(spark, tmp_path):
    folder, out = f"file://{tmp_path}/steps", f"file://{tmp_path}/out"
    at = lambda hour, minute=0: f"2024-05-01 {hour:02}:{minute:02}:00"
    files = [
        [(1, 1, at(1), 1.0, 0.1), (1, 3, at(1, 20), 3.0, 0.1), (2, 1, at(1), None, 0.2), (None, 9, at(1), 1.0, 0.1)],
        [(1, 2, at(1, 10), 2.0, 0.1), (1, 4, at(1, 20), 4.0, 0.1)],  # between and beside what has come
        [(3, 1, at(8), 7.0, 0.1)],
        [(5, 1, at(8, 10), 9.0, 0.1)],
        [(1, 5, at(2), 5.0, 0.1), (1, 6, at(8, 30), 6.0, 0.1)],  # the first is late
        [(4, 1, at(20), 8.0, 0.1)],
        [(4, 2, at(23), 8.0, 0.1)],  # the last trace is still open
    ]
    for rows in files:
        spark.createDataFrame(rows, STEP.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    closed, late = run(spark, folder, out, len(files), gap="1 hour", late="30 minutes")
    got = sorted((r["trace_id"], str(r["first"]), r["mean"], r["dwell"]) for r in closed.collect())
    assert got == [(1, at(1), [1.0, 2.0, 3.0, 4.0], [600.0, 600.0, 0.0, 1.0]), (1, at(8, 30), [6.0], [1.0]), (2, at(1), [None], [1.0]), (3, at(8), [7.0], [1.0]), (5, at(8, 10), [9.0], [1.0])] and late == 1


def test_window_counts_of_a_table(spark):
    rows = spark.createDataFrame([(1, "2024-05-01 01:00:00", 2.0), (1, "2024-05-01 01:30:00", 4.0), (1, "2024-05-01 02:30:00", 5.0)], "trace_id long, ts string, mean double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["n"], r["level"]) for r in scorer.window_counts(rows).collect()) == [(1, 5.0), (2, 3.0)]

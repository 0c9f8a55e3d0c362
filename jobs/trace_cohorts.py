"""Cohorts for a study: from recorded steps to checked, trimmed and scaled traces.

Each trace is checked, cut behind its last low step, and left out with a reason if it is not valid or too short. The others are scaled
robustly by their own kept steps and get a fold. Writes, each split by construct,

    manifest  one row for each trace: its steps, those kept, why it is left out, fold, centre and scale
    prepared  the scaled steps of the traces that stay

and `lengths`, the quartiles of kept steps by construct and over all.

    python jobs/trace_cohorts.py --config jobs/trace_cohorts.json --events PATH --output PATH

A rerun overwrites the three tables with the same rows.
"""

from __future__ import annotations

import argparse
import logging

if __name__ == "__main__":
    import _common

    _common.importable()

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators import regions, resample, robust
from sigspark.plans.catalogue import STEPS
from sigspark.sources import fixtures

log = logging.getLogger("jobs.trace_cohorts")

#: low: a trace ends with its last step at or under this level. least_steps: fewest steps of a trace that stays. folds: their number.
DEFAULTS = {"low": 20.0, "least_steps": 50, "folds": 5}


def prepare(steps: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(manifest, prepared) of a table of steps."""
    traces = fixtures.nest(steps, "construct", "stored_is_consensus").withColumn("n", F.size("mean").cast("long")).withColumn("valid", robust.valid_trace())
    kept = regions.tail_trim(traces, config["low"], 1).withColumns({c: F.slice(c, F.lit(1), F.col("keep")) for c in ("std", "dwell")})
    short = regions.length_manifest(kept, config["least_steps"]).drop("n")
    judged = kept.join(short, "trace_id").withColumn("exclusion_reason", F.when(~F.col("valid"), "invalid").otherwise(F.col("exclusion_reason")))
    judged = judged.withColumn("fold", F.pmod("trace_id", F.lit(config["folds"])).cast("long"))
    stays = fixtures.unnest(judged.where("exclusion_reason IS NULL"), "construct", "fold")
    params = robust.robust_params(stays, "trace_id")
    manifest = judged.select("trace_id", "construct", "stored_is_consensus", "n", F.col("keep").cast("long").alias("kept"), "exclusion_reason", "fold").join(params, "trace_id", "left")
    prepared = robust.znorm(stays, "trace_id").select("trace_id", "construct", "fold", "pos", "z", "z_std", "dwell")
    return manifest, prepared


def run(spark: SparkSession, config: dict, events: str, output: str) -> None:
    rows = spark.read.parquet(events)
    manifest, prepared = prepare(fixtures.event_steps(rows), config)
    for name, frame in (("manifest", manifest), ("prepared", prepared)):
        frame.write.mode("overwrite").partitionBy("construct").parquet(f"{output}/{name}")
    written = read(spark, output, "manifest")
    kept = written.where("exclusion_reason IS NULL")
    resample.length_summary(kept, "construct", "kept").write.mode("overwrite").parquet(f"{output}/lengths")
    for r in written.groupBy(F.coalesce("exclusion_reason", F.lit("kept")).alias("why")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("steps")).orderBy("why").collect():
        log.info("read %s: %d traces of %d steps %s", events, r["n"], r["steps"], r["why"])
    for name in ("manifest", "prepared", "lengths"):
        log.info("wrote %d rows to %s/%s", read(spark, output, name).count(), output, name)


def read(spark: SparkSession, output: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{output}/{name}")


def report(spark: SparkSession, output: str) -> DataFrame:
    """All three tables as written, one row a trace: its manifest, sums of its prepared steps, and the median length of its construct."""
    sums = read(spark, output, "prepared").groupBy("trace_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("z").alias("z"), F.sum("z_std").alias("z_std"))
    median = read(spark, output, "lengths").where("construct IS NOT NULL").select(F.col("construct").cast("long").alias("construct"), F.col("p50").alias("median_kept"))
    joined = read(spark, output, "manifest").withColumn("construct", F.col("construct").cast("long")).join(sums, "trace_id", "left").join(median, "construct", "left")
    return joined.na.fill(0, ["steps"]).withColumns({c: F.round(c, 6) for c in ("shift", "scale", "z", "z_std", "median_kept")})


SQL = f"""
WITH {STEPS},
c AS (SELECT trace_id, any_value(construct) AS construct, any_value(stored_is_consensus) AS stored_is_consensus, any_value(n) AS n, coalesce(max(CASE WHEN mean <= {DEFAULTS["low"]} THEN pos + 1 END), 0) AS kept FROM t GROUP BY trace_id),
j AS (SELECT *, CASE WHEN kept < {DEFAULTS["least_steps"]} THEN 'fewer than {DEFAULTS["least_steps"]} steps' END AS exclusion_reason FROM c),
s AS (SELECT t.* FROM t JOIN j USING (trace_id) WHERE exclusion_reason IS NULL AND pos < kept),
p AS (SELECT trace_id, median(mean) AS shift, 1.4826 * mad(mean) AS scale FROM s GROUP BY trace_id),
z AS (SELECT trace_id, count(*) AS steps, sum((mean - shift) / CASE WHEN scale > 0 THEN scale ELSE 1.0 END) AS z, sum(std / CASE WHEN scale > 0 THEN scale ELSE 1.0 END) AS z_std FROM s JOIN p USING (trace_id) GROUP BY trace_id),
m AS (SELECT construct, quantile_cont(kept, 0.5) AS median_kept FROM j WHERE exclusion_reason IS NULL GROUP BY construct)
SELECT trace_id, construct, stored_is_consensus, n, kept, exclusion_reason, trace_id % {DEFAULTS["folds"]} AS fold, round(shift, 6) AS shift, round(scale, 6) AS scale, coalesce(steps, 0) AS steps, round(z, 6) AS z, round(z_std, 6) AS z_std, round(median_kept, 6) AS median_kept
FROM j LEFT JOIN p USING (trace_id) LEFT JOIN z USING (trace_id) LEFT JOIN m USING (construct)"""


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", help="JSON file of settings")
    for name in ("events", "output"):
        p.add_argument(f"--{name}", required=True)
    a = p.parse_args(arguments)
    from jobs import _common

    spark = _common.session("trace_cohorts")
    try:
        run(spark, _common.settings(spark, a.config, DEFAULTS), a.events, a.output)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

"""Runnable jobs, and the queries that run each of them twice over whole tables into a folder of its own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import design_levels, trace_cohorts


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only where that is unset and all runs in one process, in a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sigspark-jobs-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_design_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "design-levels")
    for _ in range(2):
        design_levels.run(spark, design_levels.DEFAULTS, f"{sf_dir}/documents.parquet", f"{sf_dir}/part.parquet", output)
    return design_levels.read(spark, output).drop("batch")


def job2_trace_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "trace-cohorts")
    for _ in range(2):
        trace_cohorts.run(spark, trace_cohorts.DEFAULTS, f"{sf_dir}/events.parquet", output)
    return trace_cohorts.report(spark, output)


def queries() -> dict:
    return {f.__name__: f for f in (job1_design_levels, job2_trace_cohorts)}


def oracle_sql() -> dict[str, str]:
    return {"job1_design_levels": design_levels.SQL, "job2_trace_cohorts": trace_cohorts.SQL}

"""The driver's tables read as signal data: traces, fixed-grid traces, a k-mer table and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_steps(table(spark, sf_dir, "events"))


def event_steps(events: DataFrame) -> DataFrame:
    """Long table of steps: trace_id, pos, mean, std, dwell, start_sample, end_sample, construct, stored_is_consensus.

    A user's events by time are a trace; dwell is the time to the next event in seconds (1 for the last).
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("trace_id"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.col("value").alias("mean"),
        (F.lit(0.5) + F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100).alias("std"),
        F.coalesce((F.lead(micros).over(order) - micros) / 1e6, F.lit(1.0)).alias("dwell"),
        (F.col("user_id") % 9).alias("construct"),
        (F.col("user_id") % 2 == 0).alias("stored_is_consensus"),
    )


def nest(long: DataFrame, *keys: str) -> DataFrame:
    """One row per trace with the arrays mean, std and dwell in order of pos."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mean", "std", "dwell")))
    nested = long.groupBy("trace_id", *keys).agg(ordered.alias("s"))
    return nested.select("trace_id", *keys, *[F.col(f"s.{c}").alias(c) for c in ("mean", "std", "dwell")])


def unnest(nested: DataFrame, *keys: str) -> DataFrame:
    """The inverse of nest."""
    rows = nested.select("trace_id", *keys, F.posexplode(F.arrays_zip("mean", "std", "dwell")).alias("pos", "s"))
    return rows.select("trace_id", *keys, F.col("pos").cast("long").alias("pos"), "s.mean", "s.std", "s.dwell")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(steps(spark, sf_dir), "construct", "stored_is_consensus")


def grid_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as traces on a fixed grid: trace_id, label, is_training, mean, std (0.05), dwell (1)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("trace_id"),
        F.col("label").cast("long").alias("label"),
        (F.col("vec_id") % 2 == 0).alias("is_training"),
        F.col("embedding").cast("array<double>").alias("mean"),
        F.transform("embedding", lambda x: F.lit(0.05)).alias("std"),
        F.transform("embedding", lambda x: F.lit(1.0)).alias("dwell"),
    )


def kmer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_levels(table(spark, sf_dir, "part"))


def kmer_levels(part: DataFrame) -> DataFrame:
    """k-mer levels from part: the six base-4 digits of the key, first occurrence; incomplete below 4,096 parts."""
    key = F.col("p_partkey") % 4096
    digits = [F.substring(F.lit("ACGT"), ((F.floor(key / 4**k) % 4) + 1).cast("int"), F.lit(1)) for k in range(5, -1, -1)]
    rows = part.select(F.concat(*digits).alias("kmer"), "p_partkey", (F.col("p_retailprice") / 1000).alias("pre_mean"), (F.col("p_size") / 50).alias("post_mean"))
    first = rows.groupBy("kmer").agg(F.min_by(F.struct("pre_mean", "post_mean"), "p_partkey").alias("x"))
    return first.select("kmer", "x.pre_mean", F.lit(0.1).alias("pre_std"), "x.post_mean", F.lit(0.1).alias("post_std"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """template_id, template: the letters of each whole benchmark text, mapped to ACGT."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("template_id"), bases("text").alias("template"))


def bases(text: str) -> Column:
    """The letters A-Z of a text, in either case, mapped to ACGT."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGT" * 6 + "AC")

"""Scoring of arriving traces against fixed profiles, and counts of arriving steps with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import score_against


def score_stream(traces: DataFrame, profiles: DataFrame, label: str, **options) -> DataFrame:
    """A stream of nested traces scored against a static table of profiles: stateless."""
    return score_against(traces, profiles, label, **options)


def window_counts(steps: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Steps and mean level of each trace in tumbling windows of a stream; data later than `late` is left out."""
    rows = steps.withWatermark(time, late).groupBy("trace_id", F.window(time, window).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("level")).select("trace_id", F.col("w.start").alias("start"), "n", "level")

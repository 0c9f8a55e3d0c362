"""How much work a task of a kernel gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt, by the keys if any, over as many tasks as the session's shuffles have (spark.sql.shuffle.partitions, which is set
    for the data), but twice as many as there are cores at least.

    Kernels cost far more than the bytes that they read, by which adaptive plans would size their tasks.
    """
    spark = frame.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return frame.repartition(n, *keys)


def tasks_for(spark: SparkSession, volume: float, each: float, most: int = 100_000) -> int:
    """Tasks for a volume of work, `each` a task: twice as many as cores at least, `most` at most."""
    return int(min(most, max(2 * spark.sparkContext.defaultParallelism, volume / each)))

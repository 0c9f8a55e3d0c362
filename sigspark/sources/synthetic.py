"""The synthetic demonstration set: noisy copies of one template of different lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the template: a sine and two bumps as (height, centre, width).
SINE = 0.6
BUMPS = ((0.35, 0.30, 0.08), (-0.25, 0.72, 0.06))


def template(x: np.ndarray) -> np.ndarray:
    return SINE * np.sin(2 * np.pi * x) + sum(h * np.exp(-(((x - c) / w) ** 2)) for h, c, w in BUMPS)


def synthetic_traces(spark: SparkSession, seed: int = 42, n: int = 16, shortest: int = 48, longest: int = 80) -> DataFrame:
    """n native traces (trace_id, mean, std, dwell): lengths from shortest to longest, noise 0.04 to 0.07 in turn.

    Drawn from one numpy generator on the driver, so a seed gives the same traces anywhere.
    """
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        size = int(rng.integers(shortest, longest + 1))
        noise = 0.04 + 0.01 * (i % 4)
        mean = template(np.linspace(0.0, 1.0, size)) + rng.normal(0.0, noise, size)
        rows.append((i, mean.tolist(), [noise] * size, [1.0] * size))
    return spark.createDataFrame(rows, "trace_id long, mean array<double>, std array<double>, dwell array<double>")

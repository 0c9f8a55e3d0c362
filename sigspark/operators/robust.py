"""Robust centre and scale of traces, and the scalings built on them. Everything here is Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD = 1.4826


def robust_params(long: DataFrame, *keys: str, value: str = "mean") -> DataFrame:
    """keys, shift, scale: median and 1.4826 * median(|x - median|), exact, of the finite values."""
    finite = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    centre = finite.groupBy(*keys).agg(F.median(value).alias("shift"))
    if keys:
        joined = finite.join(centre, list(keys))
    else:
        joined = finite.crossJoin(F.broadcast(centre))  # one row
    return joined.groupBy(*keys).agg(F.first("shift").alias("shift"), (MAD * F.median(F.abs(F.col(value) - F.col("shift")))).alias("scale"))


def nonzero(scale: Column) -> Column:
    """The scale, or 1 where it is zero, negative or not finite."""
    return F.when(scale.isNull() | F.isnan(scale) | (scale <= 0) | (scale == float("inf")), F.lit(1.0)).otherwise(scale)


def znorm(long: DataFrame, *keys: str, shift: float | None = None, scale: float | None = None) -> DataFrame:
    """Steps with z = (mean - shift) / scale; parameters given replace the trace's own, each by itself; scale 0 counts as 1."""
    joined = long.join(robust_params(long, *keys), list(keys)) if shift is None or scale is None else long
    a = F.lit(shift) if shift is not None else F.col("shift")
    b = nonzero(F.lit(scale) if scale is not None else F.col("scale"))
    return joined.withColumn("z", (F.col("mean") - a) / b).withColumn("z_std", F.col("std") / b).drop("shift", "scale")


def pooled_params(kmers: DataFrame) -> DataFrame:
    """Centre and scale of a k-mer table over its pre and post means together."""
    pool = kmers.select(F.explode(F.array("pre_mean", "post_mean")).alias("mean"))
    return robust_params(pool)


def to_table_units(long: DataFrame, kmers: DataFrame, *keys: str) -> DataFrame:
    """Means and stds mapped to the scale of the k-mer table: factor = table scale / trace scale (null where that is zero)."""
    own = robust_params(long, *keys)
    target = pooled_params(kmers).select(F.col("shift").alias("t_shift"), F.col("scale").alias("t_scale"))
    factor = F.try_divide("t_scale", "scale")
    joined = long.join(own, list(keys)).crossJoin(F.broadcast(target))
    return joined.select(*long.columns, ((F.col("mean") - F.col("shift")) * factor + F.col("t_shift")).alias("unit_mean"), (F.col("std") * factor).alias("unit_std"))


def affine_calibrate(long: DataFrame, reference: DataFrame, target_shift: float, target_scale: float, *keys: str, std_floor: float = 1e-3) -> DataFrame:
    """Maps the reference steps' median and MAD to the target, per trace; the std is floored after scaling."""
    own = robust_params(reference, *keys)
    gain = F.lit(target_scale) / nonzero(F.col("scale"))
    joined = long.join(own, list(keys))
    return joined.select(*long.columns, ((F.col("mean") - F.col("shift")) * gain + target_shift).alias("cal_mean"), F.greatest(F.col("std") * gain, F.lit(std_floor)).alias("cal_std"))


def prepare_reads(long: DataFrame, *keys: str, normalise: bool = True, min_std: float = 1e-3) -> DataFrame:
    """Steps ready for fits: scaled robustly (scale <= 0 or not finite counts as 1), std not under the floor."""
    if not normalise:
        return long.withColumn("std", F.greatest("std", F.lit(min_std)))
    joined = long.join(robust_params(long, *keys), list(keys))
    b = nonzero(F.col("scale"))
    return joined.withColumn("mean", (F.col("mean") - F.col("shift")) / b).withColumn("std", F.greatest(F.col("std") / b, F.lit(min_std))).drop("shift", "scale")


def robust_z(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds z: (x - median) / scale by MAD; the population std where the MAD is about zero; zeros where that is, too."""
    eps = 2.220446049250313e-16
    own = robust_params(rows, *keys, value=value).join(rows.groupBy(*keys).agg(F.stddev_pop(value).alias("_p")), list(keys))
    tiny = eps * F.greatest(F.lit(1.0), F.abs("shift"))
    scale = F.when(F.col("scale") > tiny, F.col("scale")).when(F.col("_p") > tiny, F.col("_p"))
    params = own.select(*keys, F.col("shift").alias("_m"), scale.alias("_s"))
    return rows.join(params, list(keys)).withColumn("z", F.coalesce((F.col(value) - F.col("_m")) / F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def valid_trace(mean: str = "mean", std: str = "std", dwell: str = "dwell") -> Column:
    """Whether a nested trace is usable: not empty, equal lengths, finite, std and dwell not negative."""

    def finite(c):
        return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    same = (F.size(mean) > 0) & (F.size(mean) == F.size(std)) & (F.size(mean) == F.size(dwell))
    return same & finite(mean) & finite(std) & finite(dwell) & F.forall(std, lambda x: x >= 0) & F.forall(dwell, lambda x: x >= 0)

"""Interval, banded and nearest joins of steps, trims, and the joins and set checks of cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midpoint(start: str = "start_sample", end: str = "end_sample") -> Column:
    return F.floor((F.col(start) + F.col(end)) / 2).cast("long")


def in_interval(steps: DataFrame, intervals: DataFrame, lo: str, hi: str, *keys: str) -> DataFrame:
    """Steps whose midpoint lies in the half-open interval [lo, hi) of their event: an equi-join with a range."""
    return steps.join(intervals.select(*keys, lo, hi), list(keys)).where((midpoint() >= F.col(lo)) & (midpoint() < F.col(hi))).drop(lo, hi)


def three_regions(steps: DataFrame, bounds: DataFrame, *keys: str) -> DataFrame:
    """Steps with region pre_dna, dna or non_dna by their midpoint against d_start and p_start."""
    joined = steps.join(bounds.select(*keys, "d_start", "p_start"), list(keys))
    region = F.when(midpoint() < F.col("d_start"), "pre_dna").when(midpoint() < F.col("p_start"), "dna").otherwise("non_dna")
    return joined.withColumn("region", region).drop("d_start", "p_start")


def nearest_step(steps: DataFrame, truth: DataFrame, sample: str, *keys: str) -> DataFrame:
    """(keys, sample, pos): the step whose start is nearest to the sample, the lower one of a tie."""
    joined = steps.join(truth.select(*keys, sample), list(keys))
    return joined.groupBy(*keys, sample).agg(F.min_by("pos", F.struct(F.abs(F.col("start_sample") - F.col(sample)), F.col("pos"))).alias("pos"))


def tail_trim(nested: DataFrame, threshold: float, tail: int) -> DataFrame:
    """Keeps each trace up to its last step of mean <= threshold; tail_mean holds the next `tail` steps if there are as many."""
    n = F.size("mean")
    low = F.filter(F.transform(F.col("mean"), lambda x, i: F.when(x <= threshold, i + 1).otherwise(F.lit(0))), lambda x: x > 0)
    keep = F.coalesce(F.array_max(low), F.lit(0))
    out = nested.withColumn("keep", keep)
    full = F.col("keep") + tail <= n
    return out.withColumn("tail_mean", F.when(full, F.slice("mean", F.col("keep") + 1, F.lit(tail)))).withColumn("mean", F.slice("mean", F.lit(1), F.col("keep")))


def last_window(column: str, n: int) -> Column:
    """The last n elements of an array, or all."""
    return F.when(F.size(column) > n, F.slice(column, -n, n)).otherwise(F.col(column))


def length_manifest(nested: DataFrame, least: int) -> DataFrame:
    """(trace_id, n, exclusion_reason): every trace, with the reason why it is left out, if it is."""
    n = F.size("mean").cast("long")
    return nested.select("trace_id", n.alias("n"), F.when(n < least, F.concat(F.lit("fewer than "), F.lit(least).cast("string"), F.lit(" steps"))).alias("exclusion_reason"))


def fit_levels(values: DataFrame, *keys: str, value: str = "mean", floor: float = 1e-3) -> DataFrame:
    """(keys, n, level, spread): median and 1.4826 MAD; where that is under the floor, the population std, at least the floor.
    Groups of one value fail by a null spread."""
    from .robust import robust_params

    own = robust_params(values, *keys, value=value)
    more = values.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"))
    wide = F.when(F.col("scale") >= floor, F.col("scale")).otherwise(F.greatest(F.coalesce("sd", F.lit(floor)), F.lit(floor)))
    return own.join(more, list(keys)).select(*keys, "n", F.col("shift").alias("level"), F.when(F.col("n") >= 2, wide).alias("spread"))


def leave_fold_out(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """Rows once for each fold that is not their own, with the held-out fold as `held_fold`: the training rows of each fold."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))
    return rows.withColumn("held_fold", F.explode(others)).withColumn("held_fold", F.col("held_fold").cast("long"))


def blocked_groups(events: DataFrame, blocks: int, order: str, *keys: str) -> DataFrame:
    """Contiguous blocks 0.. in order, the first ones a row longer where the count doesn't divide."""
    return events.withColumn("block", (F.ntile(blocks).over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def even_depth(events: DataFrame, depth: int, order: str, *keys: str) -> DataFrame:
    """`depth` rows of each group, evenly spaced by rint(linspace(0, n - 1, depth)); where two fall together, the first rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    ranked = events.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    points = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda k: F.rint(k * (F.col("_n") - 1) / F.lit(max(depth - 1, 1)).cast("double")).cast("int"))
    distinct = F.size(F.array_distinct(points)) == depth
    return ranked.where(F.when(distinct, F.array_contains(points, F.col("_r"))).otherwise(F.col("_r") < depth)).drop("_r", "_n")


def gap_runs(rows: DataFrame, order: str, flag: str, *keys: str) -> DataFrame:
    """(keys, longest, terminal): the longest run of false inside, and the longest at either end."""
    w = Window.partitionBy(*keys)
    island = rows.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w))
    island = island.withColumn("_g", F.col("_r") - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))).where(~F.col(flag))
    runs = island.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("k"), F.min("_r").alias("lo"), F.max("_r").alias("hi"), F.first("_n").alias("n"))
    edge = (F.col("lo") == 1) | (F.col("hi") == F.col("n"))
    found = runs.groupBy(*keys).agg(F.max(F.when(~edge, F.col("k"))).alias("longest"), F.max(F.when(edge, F.col("k"))).alias("terminal"))
    return rows.select(*keys).distinct().join(found, list(keys), "left").na.fill(0, ["longest", "terminal"])


def common_keys(rows: DataFrame, key: str, condition: str) -> DataFrame:
    """Keys that every condition holds."""
    n = rows.select(condition).distinct().agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(key).agg(F.count_distinct(condition).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select(key)


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both sets, of their intersection and union, and their Jaccard index (1 for an empty union)."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    both = F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull())
    counts = x.join(y, key, "full_outer").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), both.alias("n_both"), F.count(F.lit(1)).alias("n_union"))
    return counts.withColumn("jaccard", F.when(F.col("n_union") == 0, 1.0).otherwise(F.try_divide("n_both", "n_union")))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side holds; no rows mean equal sets."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("first")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("second")))


def repeated_ids(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def condition_manifest(events: DataFrame, retained: DataFrame, conditions: list[str], key: str) -> DataFrame:
    """Every event under every condition, with whether it is retained there."""
    every = events.select(key, F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"))
    kept = retained.select(key, "condition").distinct().withColumn("retained", F.lit(True))
    return every.join(kept, [key, "condition"], "left").na.fill(False, ["retained"])


def substitute_column(grid: DataFrame, replacement: DataFrame, label: str) -> DataFrame:
    """A score grid (event, label, score) with one label's scores replaced."""
    return grid.where(F.col("label") != label).unionByName(replacement.where(F.col("label") == label))


def stratified_split(events: DataFrame, fraction: float, seed: int, stratum: str, key: str) -> DataFrame:
    """Marks floor(n * fraction + 0.5) events of each stratum as training, by a hash of seed, stratum and key."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col(stratum).cast("string"), F.col(key).cast("string")), 256)
    w = Window.partitionBy(stratum)
    rank, n = F.row_number().over(w.orderBy(digest)), F.count(F.lit(1)).over(w)
    return events.withColumn("is_training", rank <= F.floor(n * fraction + 0.5))

"""Scores and metrics of classifications, ranks, intervals and fits: closed forms over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import Tables

INF = float("inf")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def predictions(grid: DataFrame, lower: bool = True) -> DataFrame:
    """Of a score grid (event_id, truth, label, score): event_id, truth, predicted and the margin to the second best.

    The first label in order wins ties; a score of infinity is inadmissible.
    """
    s = F.col("score") if lower else -F.col("score")
    order = Window.partitionBy("event_id", "truth").orderBy(s, "label")
    ranked = grid.withColumn("_s", s).withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    best = ranked.groupBy("event_id", "truth").agg(F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("predicted"), F.max(F.when(F.col("_r") == 1, F.col("_s"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("_s"))).alias("_b"))
    return best.select("event_id", "truth", "predicted", F.when(F.abs("_b") < INF, F.col("_b") - F.col("_a")).alias("margin"))


def confusion(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """(truth, predicted, n) for all pairs of labels, zeros included. labels is a small table with the column label."""
    grid = labels.select(F.col("label").alias("truth")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    return grid.join(pred.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n")), ["truth", "predicted"], "left").na.fill(0, ["n"])


def per_class(cells: DataFrame) -> DataFrame:
    """(label, count, recall, precision, f1) from confusion cells."""
    rows = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("count"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    out = rows.join(cols, "label").withColumn("recall", ratio(F.col("hit"), F.col("count"))).withColumn("precision", ratio(F.col("hit"), F.col("called")))
    return out.select("label", "count", "recall", "precision", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def summary(classes: DataFrame) -> DataFrame:
    """One row: events, accuracy, balanced accuracy and macro F1; the latter two over classes that occur."""
    seen = F.col("count") > 0
    return classes.agg(
        F.sum("count").alias("events"),
        ratio(F.sum(F.col("recall") * F.col("count")), F.sum("count")).alias("accuracy"),
        F.coalesce(F.avg(F.when(seen, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.coalesce(F.avg(F.when(seen, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
    )


def running(rows: DataFrame, order: list[tuple[str, bool]], sums: dict[str, Column], *keys: str) -> DataFrame:
    """Adds the sums over all rows before each one, within keys, in an order of columns (name, descending).

    Rows are dealt to ranges of keys and order, whose ends Spark samples, so that ranges hold about as many rows each however the values
    are spread; equal values may part at a range's end by the columns that follow. The ranges' totals are added up in order, and
    each row adds what is before it in its range. The ranged rows are written once, as samples may differ between runs.
    """
    by = [F.col(c).desc() if down else F.col(c) for c, down in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = Tables(rows.sparkSession).put(rows.repartitionByRange(n, *keys, *by).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))  # the ranges, and one more for each key
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(base, [*keys, "_part"])
    return joined.select(*rows.columns, *((F.col(f"_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in sums.items()))


def rank_metrics(rows: DataFrame, truth: str, score: str, order: str, *keys: str) -> DataFrame:
    """One row (for each of keys): AUROC by average ranks, and average precision with ties in the order of `order`.

    Rows without a truth or a score (null or NaN) are left out; both are null where one of the truths is missing. Ranks come from
    `running`: of distinct scores for AUROC, so that a frequent one is a single row, and of rows for average precision.
    """
    own = rows.select(*keys, F.col(truth).cast("double").alias("_y"), F.col(score).alias("_s"), F.col(order).alias("_o")).where("_y IS NOT NULL AND _s IS NOT NULL AND NOT isnan(double(_s))")
    per = own.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("k"), F.sum("_y").alias("pos"))
    ranked = running(per, [("_s", False)], {"before": F.col("k")}, *keys)
    u = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("before") + (F.col("k") + 1) / 2)).alias("ranks"), F.sum("pos").alias("p"), F.sum("k").alias("n"))
    auroc = F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    listed = running(own, [("_s", True), ("_o", False)], {"found": F.col("_y"), "place": F.lit(1)}, *keys)
    precision = (F.col("found") + F.col("_y")) / (F.col("place") + 1)
    ap = listed.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_y") * precision), F.sum("_y")).alias("average_precision"))
    u = u.select(*keys, auroc.alias("auroc"))
    return u.join(ap, list(keys)) if keys else u.crossJoin(F.broadcast(ap))  # one row each


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where either side has no variance."""
    dx, dy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((dx > 0) & (dy > 0), F.try_divide(F.covar_pop(x, y), dx * dy))


def curve_metrics(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, rmse, mae, max_abs, r) of two columns of points."""
    d = F.col(x) - F.col(y)
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_abs"), correlation(x, y).alias("r"))


def boundary_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Errors (predicted - truth, in steps) of passed events, and the acceptance over all: rows have status and error."""
    ok = F.col("status") == "pass"
    e = F.when(ok, F.col("error"))
    a = F.abs(e)
    n = F.count(e)
    share = lambda c: F.try_divide(F.count_if(c), n)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        n.alias("accepted"),
        F.try_divide(n, F.count(F.lit(1))).alias("acceptance"),
        F.avg(e).alias("mean_error"),
        F.median(e).alias("median_error"),
        F.avg(a).alias("mean_abs"),
        F.median(a).alias("median_abs"),
        F.percentile(a, F.lit(0.9)).alias("p90_abs"),
        F.max(a).alias("max_abs"),
        share(a == 0).alias("exact"),
        share(a <= 1).alias("within_one"),
        share(a <= 2).alias("within_two"),
    )


def best_trim(summaries: DataFrame, least_acceptance: float = 0.9) -> DataFrame:
    """The row of least (median, 90th percentile, mean) absolute error and trim among those of enough acceptance; if none has
    it, that of the most acceptance."""
    gate = F.coalesce(F.col("acceptance") >= least_acceptance, F.lit(False))
    some = summaries.withColumn("gate", gate)
    order = [F.col("gate").desc(), F.when(~F.col("gate"), -F.col("acceptance")), F.col("median_abs").asc_nulls_last(), F.col("p90_abs").asc_nulls_last(), F.col("mean_abs").asc_nulls_last(), F.col("trim")]
    return some.orderBy(*order).limit(1).drop("gate")


def nuisance_scores(train: DataFrame, held: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """(key, label, score): distance of held rows to class centroids, after scaling by the training median and MAD (0 counts as 1)."""
    from .robust import nonzero, robust_params

    def long(rows, *keep):
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")
        return rows.select(*keep, pairs).select(*keep, "x.feature", "x.v")

    t = long(train, label)
    params = F.broadcast(robust_params(t, "feature", value="v").withColumn("scale", nonzero(F.col("scale"))))  # a row for each feature
    z = lambda rows: rows.join(params, "feature").withColumn("z", (F.col("v") - F.col("shift")) / F.col("scale"))
    centre = z(t).groupBy(label, "feature").agg(F.avg("z").alias("c"))
    return z(long(held, key)).join(centre, "feature").groupBy(key, label).agg(F.sqrt(F.sum((F.col("z") - F.col("c")) ** 2)).alias("score"))


def bootstrap_draws(events: DataFrame, replicates: int, seed: int, stratum: str, key: str) -> DataFrame:
    """(replicate, stratum, draw, key): as many draws with replacement from each stratum as it has events, by hashes.

    Event numbers inside a stratum are joined back to draws; the same draws serve every quantity of a pair.
    """
    w = Window.partitionBy(stratum)
    numbered = events.select(stratum, key).withColumn("i", F.row_number().over(w.orderBy(key)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    draws = numbered.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    text = F.concat_ws("|", F.lit(seed).cast("string"), F.col(stratum).cast("string"), F.col("replicate").cast("string"), F.col("i").cast("string"))
    value = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    picked = draws.select("replicate", stratum, F.col("i").alias("draw"), (value % F.col("n")).alias("i"))
    return picked.join(numbered.select(stratum, "i", key), [stratum, "i"]).select("replicate", stratum, "draw", key)


def percentile_interval(rows: DataFrame, value: str, confidence: float, *keys: str) -> DataFrame:
    """(keys, low, high, replicates) over finite values."""
    tail = (1 - confidence) / 2
    v = F.when(~F.isnan(value) & (F.abs(value) < INF), F.col(value))
    return rows.groupBy(*keys).agg(F.percentile(v, F.lit(tail)).alias("low"), F.percentile(v, F.lit(1 - tail)).alias("high"), F.count(v).alias("replicates"))


def bootstrap_accuracy(pred: DataFrame, draws: DataFrame, key: str = "event_id") -> DataFrame:
    """(replicate, accuracy, balanced_accuracy) of the drawn events; strata are the true classes."""
    hit = (F.col("truth") == F.col("predicted")).cast("double")
    own = draws.join(pred.select(key, "truth", hit.alias("hit")), key)
    recall = own.groupBy("replicate", "truth").agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    return recall.groupBy("replicate").agg((F.sum("h") / F.sum("n")).alias("accuracy"), F.avg(F.col("h") / F.col("n")).alias("balanced_accuracy"))


def bootstrap_classification(pred: DataFrame, draws: DataFrame, *keys: str, key: str = "event_id") -> DataFrame:
    """(keys, replicate, accuracy, balanced_accuracy, macro_f1) of the drawn events, which serve all keys; strata are the true classes."""
    by = [*keys, "replicate"]
    own = draws.select("replicate", key).join(pred.select(*keys, key, "truth", "predicted"), key)
    cells = own.groupBy(*by, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    true = cells.groupBy(*by, F.col("truth").alias("label")).agg(hit.alias("hit"), F.sum("n").alias("count"))
    called = cells.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    f1 = 2 * F.col("hit") / (F.col("count") + F.coalesce("called", F.lit(0)))
    return true.join(called, [*by, "label"], "left").groupBy(*by).agg((F.sum("hit") / F.sum("count")).alias("accuracy"), F.avg(F.col("hit") / F.col("count")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def paired_differences(a: DataFrame, b: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """One row: interval of the difference of a quantity over the same replicates."""
    both = a.select("replicate", F.col(value).alias("x")).join(b.select("replicate", F.col(value).alias("y")), "replicate").select((F.col("x") - F.col("y")).alias("difference"))
    return percentile_interval(both, "difference", confidence)


def separation_ratio(between: Column, within: Column) -> Column:
    """between / within; null unless within is positive."""
    return F.when(within > 0, between / within)


def monotone(rows: DataFrame, value: str, order: str, *keys: str, tol: float = 1e-8) -> DataFrame:
    """(keys, monotone): whether values never rise by more than tol."""
    step = rows.withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    return step.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("_d") <= tol), F.lit(True)).alias("monotone"))


def pivot_scores(grid: DataFrame, labels: list) -> DataFrame:
    """event_id, score_<label>...: one row per event."""
    wide = grid.groupBy("event_id").pivot("label", labels).agg(F.first("score"))
    return wide.select("event_id", *[F.col(f"`{label}`").alias(f"score_{label}") for label in labels])


def percent(*columns: str) -> list[Column]:
    """100 * x; missing stays missing."""
    return [(100 * F.col(c)).alias(f"{c}_percent") for c in columns]

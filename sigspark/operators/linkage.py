"""Hierarchical clusters of groups that don't fit a task: rounds over edge rows.

Single linkage is a least spanning forest, found in Boruvka's rounds: every cluster takes its least edge, and what these connect becomes
one cluster, so that each round halves the clusters at least.

The other methods merge reciprocal nearest neighbours: in each round every cluster finds its nearest one; pairs that are each other's
nearest merge, all at once, and the edges to them are put together by the method's rule. As none of the methods brings merged clusters
nearer, these are the merges of the greedy algorithm. A cluster is named by its least member. Edges are ordered by distance and then by
their ends, so that the least edge of all is always between reciprocal neighbours and every round merges something; usually a
round halves the clusters or so, and leaves a quarter of the edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import Tables

METHODS = ("complete", "average", "weighted")


def merge_rounds(edges: DataFrame, *group: str, method: str = "average") -> DataFrame:
    """(group, a, b, height, size, round): the merges of each group, b into a with a < b, from edges (group, a, b, d).

    Every pair must be there, in either direction; repeated ones must agree. A round writes the edges that are left.
    """
    if method not in METHODS:
        raise ValueError(f"linkage {method!r}")
    named = list(group)
    now = edges.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("d").alias("d"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")).where("a < b").distinct()
    tables = Tables(edges.sparkSession)
    now, found, k = tables.put(now), [], 0
    while not now.isEmpty():
        ends = F.explode(F.array("a", "b"))
        nearest = now.select(*group, ends.alias("u"), "a", "b", "d", "na", "nb").groupBy(*group, "u").agg(F.min(F.struct("d", "a", "b", "na", "nb")).alias("e"))
        chosen = nearest.groupBy(*group, "e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(*group, "e.*")
        merged = tables.put(chosen.select(*group, "a", "b", F.col("d").alias("height"), (F.col("na") + F.col("nb")).alias("size"), F.lit(k).cast("long").alias("round")))
        found.append(merged)
        # what each merged cluster becomes: its name, its size and its share of the new one
        parts = merged.select(*group, "size", F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"))
        rows = now
        for end in ("a", "b"):
            to = parts.select(*group, F.col("old").alias(end), F.col("new").alias(f"{end}_new"), F.col("size").alias(f"{end}_size"))
            rows = rows.join(to, [*named, end], "left")
        u, v = F.coalesce("a_new", "a"), F.coalesce("b_new", "b")
        nu, nv = F.coalesce("a_size", "na"), F.coalesce("b_size", "nb")
        halves = F.when(F.col("a_new").isNotNull(), 0.5).otherwise(1.0) * F.when(F.col("b_new").isNotNull(), 0.5).otherwise(1.0)
        rows = rows.select(*group, F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), F.when(u < v, nu).otherwise(nv).alias("na"), F.when(u < v, nv).otherwise(nu).alias("nb"), "d", (F.col("na") * F.col("nb")).alias("w"), halves.alias("h")).where("a < b")
        d = {"complete": F.max("d"), "average": F.sum(F.col("d") * F.col("w")) / F.sum("w"), "weighted": F.sum(F.col("d") * F.col("h"))}[method]
        now, k = tables.put(rows.groupBy(*group, "a", "b", "na", "nb").agg(d.alias("d")).select(*group, "a", "b", "d", "na", "nb")), k + 1
    if not found:
        return now.select(*group, "a", "b", F.col("d").alias("height"), F.col("na").alias("size"), F.lit(0).cast("long").alias("round"))
    return reduce(DataFrame.unionByName, found)


def cut_merges(merges: DataFrame, members: DataFrame, *group: str, n_clusters: int | None = None, threshold: float | None = None, min_size: int = 1) -> DataFrame:
    """(group, trace_id, label): clusters of members (group, trace_id) after the merges up to a height, or until so many are left; labels by
    the least member; clusters under min_size get -1."""
    if (n_clusters is None) == (threshold is None):
        raise ValueError("give either n_clusters or a threshold")
    if threshold is not None:
        kept = merges.where(F.col("height") <= threshold)
    else:
        kept = merges.join(_undone(merges, *group, height="height", n_clusters=n_clusters), [*group, "a", "b"], "left_anti")
    roots = members.select(*group, F.col("trace_id").alias("node")).distinct().join(kept.select(*group, F.col("b").alias("node"), F.col("a").alias("root")), [*group, "node"], "left")
    roots = followed(Tables(merges.sparkSession), roots.withColumn("root", F.coalesce("root", "node")), *group)
    return _labels(roots.withColumnRenamed("node", "trace_id"), *group, min_size=min_size)


def least_forest(edges: DataFrame, *group: str) -> tuple[DataFrame, DataFrame]:
    """The edges (group, a, b, d) of a least spanning forest, and (group, trace_id, root): the least trace that each is connected with.

    Edges may be in either direction and repeated; equal ones are ordered by their ends, so the forest is unique. A round has a
    shuffle of the edges that are left, and writes the least one between any two clusters.
    """
    tables = Tables(edges.sparkSession)
    own = F.struct("d", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = tables.put(edges.where("a <> b").select(*group, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), own.alias("e")).groupBy(*group, "u", "v").agg(F.min("e").alias("e")))
    members = edges.select(*group, F.explode(F.array("a", "b")).alias("trace_id")).distinct()
    names, trees = tables.put(members.withColumn("root", F.col("trace_id"))), []
    while not now.isEmpty():
        both = now.select(*group, "e", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("u").alias("to")))).alias("x"))
        least = tables.put(both.groupBy(*group, F.col("x.node").alias("node")).agg(F.min(F.struct("e", F.col("x.to").alias("to"))).alias("m")).select(*group, "node", "m.e", "m.to"))
        trees.append(least.select(*group, "e.a", "e.b", "e.d").distinct())
        # each follows its least edge; of the two that follow each other the lesser is the root
        back = least.select(*group, F.col("node").alias("to"), F.col("to").alias("back"))
        up = least.join(back, [*group, "to"]).select(*group, "node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("root"))
        up = followed(tables, up, *group)
        names = tables.put(names.join(up.select(*group, F.col("node").alias("root"), F.col("root").alias("_new")), [*group, "root"], "left").select(*group, "trace_id", F.coalesce("_new", "root").alias("root")))
        ends = now
        for end in ("u", "v"):
            ends = ends.join(up.select(*group, F.col("node").alias(end), F.col("root").alias(f"{end}_new")), [*group, end])
        now = tables.put(ends.where("u_new <> v_new").groupBy(*group, F.least("u_new", "v_new").alias("u"), F.greatest("u_new", "v_new").alias("v")).agg(F.min("e").alias("e")))
    first = names.groupBy(*group, "root").agg(F.min("trace_id").alias("first"))
    tree = reduce(DataFrame.unionByName, trees) if trees else now.select(*group, "e.a", "e.b", "e.d")
    return tree, names.join(first, [*group, "root"]).select(*group, "trace_id", F.col("first").alias("root"))


def followed(tables: Tables, up: DataFrame, *group: str) -> DataFrame:
    """(group, node, root) with each node's last root, from its next one: pointers double, so rounds grow with the logarithm of the
    longest chain."""
    up, changed = tables.put(up), True
    while changed:
        above = up.select(*group, F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = tables.put(up.join(above, [*group, "root"]).select(*group, "node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_changed")))
        changed = not moved.where("_changed").isEmpty()
        up = moved.drop("_changed")
    return up


def _labels(roots: DataFrame, *group: str, min_size: int) -> DataFrame:
    sizes = roots.groupBy(*group, "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    names = sizes.select(*group, "root", (F.row_number().over(Window.partitionBy(*group).orderBy("root")) - 1).cast("long").alias("label"))
    return roots.join(names, [*group, "root"], "left").select(*group, "trace_id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def _undone(merges: DataFrame, *group: str, height: str, n_clusters: int) -> DataFrame:
    """The highest n_clusters - 1 merges of each group."""
    last = Window.partitionBy(*group).orderBy(F.col(height).desc(), F.col("a").desc(), F.col("b").desc())
    return merges.withColumn("_k", F.row_number().over(last)).where(F.col("_k") < n_clusters).select(*group, "a", "b")


def cluster_rounds(edges: DataFrame, *group: str, method: str = "average", n_clusters: int | None = None, threshold: float | None = None, min_size: int = 1) -> DataFrame:
    """(group, trace_id, label) of groups of any size; members are the ends of the edges."""
    if (n_clusters is None) == (threshold is None):
        raise ValueError("give either n_clusters or a threshold")
    members = edges.select(*group, F.explode(F.array("a", "b")).alias("trace_id")).distinct()
    if method != "single":
        return cut_merges(merge_rounds(edges, *group, method=method), members, *group, n_clusters=n_clusters, threshold=threshold, min_size=min_size)
    if threshold is not None:
        kept = edges.where(F.col("d") <= threshold)
    else:
        tree, _ = least_forest(edges, *group)
        kept = tree.join(_undone(tree, *group, height="d", n_clusters=n_clusters), [*group, "a", "b"], "left_anti")
    roots = least_forest(kept, *group)[1]
    return _labels(members.join(roots, [*group, "trace_id"], "left").withColumn("root", F.coalesce("root", "trace_id")), *group, min_size=min_size)

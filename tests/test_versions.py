"""Versions of a table: digests that depend on the rows alone, and changes against a plain comparison."""

import collections

import pytest
from pyspark.sql import functions as F

from sigspark.operators import versions as V

DDL = "id long, part string, x double, t string"


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def plain(old, new):
    a, b = ({k: collections.Counter(r for r in rows if r[:2] == k) for k in {r[:2] for r in rows}} for rows in (old, new))
    out = set()
    for k in a.keys() | b.keys():
        if a.get(k) != b.get(k):
            out.add((*k, "added" if k not in a else "removed" if k not in b else "changed", sum(a.get(k, {}).values()), sum(b.get(k, {}).values())))
    return out


@pytest.fixture
def versions(spark, tmp_path):
    old = [(i % 90, "ab"[i % 2], i / 4, f"t{i}") for i in range(120)] + [(None, "a", 1.0, None), (5, None, None, ""), (7, "b", 1.0, "same"), (7, "b", 1.0, "same")]
    new = [r for r in old if r[0] != 11]
    new[3] = (*new[3][:3], "other")
    new.remove((7, "b", 1.0, "same"))
    new[new.index((5, None, None, ""))] = (5, None, None, None)
    new += [(1000, "z", 2.0, "new"), (None, None, None, None)]
    paths = str(tmp_path / "old"), str(tmp_path / "new")
    for rows, path in zip((old, new), paths):
        V.write_version(table(spark, rows), path, "id", "part", folder=1, leaf=2)
    return old, new, *paths


def test_changes(spark, versions):
    old, new, a, b = versions
    got = V.changed_rows(spark, a, b, "id", "part", folder=1)
    assert {tuple(r) for r in got.collect()} == plain(old, new) and got.columns == ["id", "part", "change", "old_rows", "new_rows"]
    assert {r["change"] for r in got.collect()} == {"added", "removed", "changed"}
    assert V.changed_rows(spark, a, a, "id", "part", folder=1).collect() == []


def test_digests_depend_on_the_rows_alone(spark, versions, tmp_path):
    old, new, a, b = versions
    first = V.root(spark, a)
    V.write_version(table(spark, old[::-1]).repartition(7), a, "id", "part", folder=1, leaf=2)
    assert V.root(spark, a) == first != V.root(spark, b)
    V.require_root(spark, a, first)
    with pytest.raises(ValueError, match="not the recorded"):
        V.require_root(spark, b, first)
    leaves = V.digests(table(spark, old), "id", "part", leaf=3)
    top = V.raised(leaves, 1).collect()
    assert sum(r["rows"] for r in top) == len(old)
    assert {tuple(r) for r in top} == {tuple(r) for r in V.digests(table(spark, old), "id", "part", leaf=1).collect()}


def test_rows_that_were_tampered_with(spark, versions, tmp_path):
    _, _, a, b = versions
    assert V.verify_version(spark, a, "id", "part", leaf=2).collect() == []
    path = f"{a}/rows"
    held = spark.read.parquet(path)
    changed = spark.createDataFrame([tuple(r) for r in held.collect()], held.schema)
    changed = changed.withColumn("x", F.when((F.col("id") == 4) & (F.col("part") == "a"), F.lit(-1.0)).otherwise(F.col("x")))
    changed.write.mode("overwrite").partitionBy("_folder").parquet(path)
    assert len(V.verify_version(spark, a, "id", "part", leaf=2).collect()) == 1


def test_empty_tables_and_names(spark, tmp_path, versions):
    old, _, a, _ = versions
    path = str(tmp_path / "none")
    V.write_version(table(spark, []), path, "id", "part", folder=1, leaf=2)
    assert V.root(spark, path) == "0-0-0"
    got = V.changed_rows(spark, path, a, "id", "part", folder=1).collect()
    assert {tuple(r) for r in got} == plain([], old)
    with pytest.raises(ValueError, match="_range"):
        V.write_version(table(spark, old).withColumn("_range", F.lit(1)), path, "id")
    with pytest.raises(ValueError, match="key"):
        V.write_version(table(spark, old), path)


def test_unchanged_folders_are_not_read(spark, tmp_path):
    rows = [(i, "a", 0.0, "t") for i in range(400)]
    paths = str(tmp_path / "1"), str(tmp_path / "2")
    V.write_version(table(spark, rows), paths[0], "id")
    V.write_version(table(spark, [*rows[:-1], (399, "a", 1.0, "t")]), paths[1], "id")
    got = V.changed_rows(spark, *paths, "id")
    assert [tuple(r) for r in got.collect()] == [(399, "changed", 1, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_folder") + plan.count("PartitionFilters: [(_folder") >= 2

"""Versions of a table: digests by range of keys, so that two versions are compared by their digests and only differing ranges are read.

A version is written partitioned by range, a hash of the key, with its digests in a small table beside it. A digest of a range is the sum of
its rows' digests (120 bits of SHA-256 each): it doesn't depend on order or partitions, counts repeated rows, and is added up to
those of fewer, larger ranges and to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the key's hash that name a folder, and those that name a range of digests.
FOLDER, LEAF = 2, 4
_PARTS = ("digest_high", "digest_low")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values by column name: nulls differ from all values, and no value runs into the next."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def key_hash(*keys: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"}), 256)


def digests(rows: DataFrame, *keys: str, leaf: int = LEAF) -> DataFrame:
    """(range, rows, digest_high, digest_low) of the key ranges that have rows."""
    own = rows.select(F.substring(key_hash(*keys), 1, leaf).alias("range"), row_digest(rows.columns).alias("_d"))
    part = lambda at: F.sum(F.conv(F.substring("_d", at, 15), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)")
    return own.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), part(1).alias(_PARTS[0]), part(16).alias(_PARTS[1]))


def raised(leaves: DataFrame, level: int) -> DataFrame:
    """Digests of the larger ranges that the first `level` digits name; level 0 is the root, a row even of an empty table."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in (("rows", "long"), *((p, "decimal(38,0)") for p in _PARTS))]
    if level == 0:
        return leaves.agg(*sums).select(F.lit("").alias("range"), "rows", *_PARTS)
    return leaves.groupBy(F.substring("range", 1, level).alias("range")).agg(*sums)


def write_version(rows: DataFrame, path: str, *keys: str, folder: int = FOLDER, leaf: int = LEAF) -> None:
    """The rows under path/rows, partitioned by range, their columns under path/columns and their digests under path/digests. Written again it gives the same rows."""
    if not keys:
        raise ValueError("name the key of the table")
    if clash := {"_folder", "_range", "_from"} & set(rows.columns):
        raise ValueError(f"the table has columns named {sorted(clash)}")
    h = key_hash(*keys)
    named = rows.withColumn("_range", F.substring(h, 1, leaf)).withColumn("_folder", F.concat(F.lit("r"), F.substring(h, 1, folder)))
    # contiguous ranges for each task, so few files; the rows of one key, however many, are dealt by where they come from
    dealt = named.withColumn("_from", F.spark_partition_id()).repartitionByRange("_range", "_from").drop("_from")
    dealt.sortWithinPartitions("_folder", "_range").write.mode("overwrite").partitionBy("_folder").parquet(f"{path}/rows")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    digests(read_version(rows.sparkSession, path).drop("_folder", "_range"), *keys, leaf=leaf).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a version, with `_range` and `_folder`; a version without rows has no files of them, but its columns are kept beside it."""
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("_range", "string").add("_folder", "string")).parquet(f"{path}/rows")


def root(spark: SparkSession, path: str) -> str:
    """The root digest of a written version, as text."""
    r = raised(spark.read.parquet(f"{path}/digests"), 0).first()
    return f"{r['rows']}-{int(r[_PARTS[0]]):x}-{int(r[_PARTS[1]]):x}"


def require_root(spark: SparkSession, path: str, expected: str) -> None:
    """Fails unless the version at path is the one whose root was recorded."""
    if (found := root(spark, path)) != expected:
        raise ValueError(f"{path} has root {found}, not the recorded {expected}")


def verify_version(spark: SparkSession, path: str, *keys: str, leaf: int = LEAF) -> DataFrame:
    """Ranges whose rows differ from the recorded digests (range, recorded, found: numbers of rows)."""
    recorded = spark.read.parquet(f"{path}/digests")
    found = digests(read_version(spark, path).drop("_folder", "_range"), *keys, leaf=leaf)
    return _differing(recorded, found).select("range", F.col("_old").alias("recorded"), F.col("_new").alias("found"))


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    named = lambda frame, x: frame.select("range", F.col("rows").alias(f"_{x}"), F.struct("rows", *_PARTS).alias(f"_{x}_digest"))
    both = named(old, "old").join(named(new, "new"), "range", "full")
    return both.where(~F.col("_old_digest").eqNullSafe(F.col("_new_digest"))).select("range", F.coalesce("_old", F.lit(0)).alias("_old"), F.coalesce("_new", F.lit(0)).alias("_new"))


def changed_rows(spark: SparkSession, old: str, new: str, *keys: str, folder: int = FOLDER) -> DataFrame:
    """(keys, change, old_rows, new_rows) of the keys whose rows differ between two written versions: added, removed or changed.

    The digests are compared first, folders, then leaves within those that differ; of the tables only differing folders are read,
    and keys and digests alone leave the scan. Rows of one key are compared as a bag; a null key is a key. Columns that only one version has make
    all of its rows differ. There are 16**folder folders at most, so their names fit a filter.
    """
    leaves = [spark.read.parquet(f"{p}/digests") for p in (old, new)]
    folders = [f"r{r['range']}" for r in _differing(*(raised(x, folder) for x in leaves)).select("range").collect()]
    ranges = _differing(*leaves).select(F.col("range").alias("_range"))

    def bags(path, side):
        rows = read_version(spark, path)
        own = [c for c in rows.columns if c not in ("_folder", "_range")]
        rows = rows.where(F.col("_folder").isin(folders)).select(*[F.col(f"`{k}`") for k in keys], "_range", row_digest(own).alias("_d"))
        rows = rows.join(ranges, "_range", "left_semi")  # digests move, not rows
        part = lambda at: F.sum(F.conv(F.substring("_d", at, 15), 16, 10).cast("decimal(38,0)"))
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_{side}"), F.struct(part(1).alias("h"), part(16).alias("l")).alias(f"_{side}_d"))

    a, b = bags(old, "old").alias("a"), bags(new, "new").alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same, "full").where(~(F.col("_old").eqNullSafe(F.col("_new")) & F.col("_old_d").eqNullSafe(F.col("_new_d"))))
    change = F.when(F.col("_old").isNull(), F.lit("added")).when(F.col("_new").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    side = [F.when(F.col("_old").isNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys]
    return both.select(*side, change.alias("change"), F.coalesce("_old", F.lit(0)).alias("old_rows"), F.coalesce("_new", F.lit(0)).alias("new_rows"))

"""Where the operators of this subpackage keep what several jobs or executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset and all runs in one process (tests), a new
    temporary one. On a cluster without that setting it is an error: executors would not see each other's files."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("sigspark.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sigspark-")
        spark.conf.set("sigspark.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_live: dict[str, set[str]] = {}


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators of this session still keep, those that frames not yet read depend on included."""
    for path in _live.pop(spark.sparkContext.applicationId, set()):
        remove(spark, path)


class Stage:
    """Tables that one operator writes to the shared folder to cut lineage, and drops when they are not needed.

    What the returned frame reads stays until `release`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, key: str) -> DataFrame:
        old = self.paths.get(key)
        path = new_path(self.spark, f"{self.name}-{key}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[key] = path
        live = _live.setdefault(self.spark.sparkContext.applicationId, set())
        live.add(path)
        if old:
            live.discard(old)
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        for key in keys or list(self.paths):
            if key in self.paths:
                path = self.paths.pop(key)
                _live.get(self.spark.sparkContext.applicationId, set()).discard(path)
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) of the rows that have an id; other columns, whatever their names, go."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")


def total_bytes(docs: DataFrame) -> tuple[int, int]:
    """(rows, UTF-8 bytes) of a texts() table: what partition counts are derived from."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def parts_for(volume: float, each: float, least: int = 16) -> int:
    """A power of two of parts, so that each holds about `each` of the volume."""
    parts = least
    while parts * each < volume:
        parts *= 2
    return parts


def lowest_hashes(rows: DataFrame, n: int, most_bytes: int, *columns: str) -> DataFrame:
    """The columns of at most n rows and most_bytes of text, those with the lowest hashes of doc_id: ids are chosen first, so that
    texts aren't sorted.

    The chosen ids, n at most, go to all tasks.
    """
    found = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    kept, used = [], 0
    for r in found:
        if used + (r["size"] or 0) <= most_bytes:
            used += r["size"] or 0
            kept.append((r["doc_id"],))
    ids = rows.sparkSession.createDataFrame(kept, "doc_id long")
    return rows.join(F.broadcast(ids), "doc_id").select("doc_id", *columns).orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(n)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that no frame refers to any more, rather than at some later collection."""
    gc.collect()
    spark._jvm.System.gc()

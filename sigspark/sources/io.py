"""Readers and sinks: calibrated raw channels, annotations, k-mer tables, CSV, JSON and fingerprints."""

from __future__ import annotations

import json
import hashlib
import os
import re
import subprocess
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = ("index", "start_idx", "end_idx", "d_start_idx", "d_end_idx", "p_start_idx", "p_end_idx")


def calibrate(raw: DataFrame) -> DataFrame:
    """ADC samples to current: (sample + offset) * range / digitisation, element-wise; adds `pa`."""
    return raw.withColumn("pa", F.transform("samples", lambda x: (x + F.col("offset")) * F.col("range") / F.col("digitisation")))


def read_annotations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Event annotations by index. Strict: rows that break start <= d_start < d_end <= p_start < p_end <= end fail the job;
    else they carry ok = false."""
    rows = spark.read.parquet(path)
    ok = (F.col("start_idx") <= F.col("d_start_idx")) & (F.col("d_start_idx") < F.col("d_end_idx")) & (F.col("d_end_idx") <= F.col("p_start_idx"))
    ok = ok & (F.col("p_start_idx") < F.col("p_end_idx")) & (F.col("p_end_idx") <= F.col("end_idx"))
    if strict:
        message = F.concat(F.lit("annotation out of order: "), F.col("index").cast("string"))
        return rows.withColumn("ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).where("ok").drop("ok").orderBy("index")
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).orderBy("index")


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """Raw channels of HDF5 files as (path, samples, sample_rate, offset, range, digitisation). Needs h5py on the executors."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading HDF5 needs the h5py package") from e
    schema = "path string, samples array<double>, sample_rate double, offset double, range double, digitisation double"

    def read(frames):
        import io

        import h5py
        import pandas as pd

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                with h5py.File(io.BytesIO(content), "r") as f:
                    signal = f["Raw/Channel_1/Signal"]
                    rows.append((name, signal[:].astype(float), *(float(signal.attrs[k]) for k in ("sample_rate", "offset", "range", "digitisation"))))
            yield pd.DataFrame(rows, columns=["path", "samples", "sample_rate", "offset", "range", "digitisation"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def dataset_paths(spark: SparkSession, root: str, names: list[str], suffixes: tuple[str, str] = ("raw.parquet", "events.parquet")) -> dict[str, tuple[str, str]]:
    """The raw and annotation path of each data set; any that is missing is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out, missing = {}, []
    for name in names:
        pair = tuple(f"{root}/{name}/{s}" for s in suffixes)
        missing += [p for p in pair if not jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
        out[name] = pair
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
    return out


KMER_SCHEMA = "kmer string, pre_mean double, pre_std double, post_mean double, post_std double"


def read_kmer_table(spark: SparkSession, path: str | None = None, variable: str = "SIGSPARK_KMER_TABLE") -> DataFrame:
    """The k-mer table from CSV; the path may come from the environment."""
    path = path or os.environ.get(variable)
    if not path:
        raise FileNotFoundError(f"no k-mer table: give a path or set {variable}")
    return spark.read.csv(path, header=True, schema=KMER_SCHEMA)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in the order in which they first occur."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(frames: list[DataFrame], path: str) -> bool:
    """Writes the union of the frames; nothing where there are no rows. Tells whether files were written."""
    frame = union_rows(frames)
    if frame.isEmpty():
        return False
    frame.write.mode("overwrite").csv(path, header=True)
    return True


def write_csv_fields(frame: DataFrame, path: str, fields: list[str]) -> None:
    """Writes just the fields, in their order."""
    frame.select(*fields).write.mode("overwrite").csv(path, header=True)


def json_rows(frame: DataFrame, name: str = "json") -> DataFrame:
    return frame.select(F.to_json(F.struct(*frame.columns)).alias(name))


def write_summary(values: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small summary as JSON; numpy scalars, arrays and paths are converted. With a session, path is one of its file systems."""

    def plain(x):
        if hasattr(x, "tolist"):
            return x.tolist()
        return str(x)

    text = json.dumps(values, indent=2, default=plain)
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_profiles(profiles: DataFrame, path: str, by: str = "model_id") -> None:
    """Profiles with their fingerprint, one folder for each model."""
    profiles.withColumn("fingerprint", fingerprint_of(F.col("mean"), F.col("std"))).write.mode("overwrite").partitionBy(by).parquet(path)


def missing_fits(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows (model_id, fingerprint) that the cache doesn't hold."""
    return wanted.join(cached.select("model_id", "fingerprint"), ["model_id", "fingerprint"], "left_anti")


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file, read in pieces through the session's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    digest, piece = hashlib.sha256(), 1 << 20
    try:
        while data := bytes(stream.readNBytes(piece)):
            digest.update(data)
    finally:
        stream.close()
    return digest.hexdigest()


def code_state(folder: str) -> dict:
    """The commit of the code in a folder and whether files differ from it; None for both outside a repository."""
    ask = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    head = ask("rev-parse", "HEAD")
    if head.returncode:
        return {"commit": None, "dirty": None}
    return {"commit": head.stdout.strip(), "dirty": bool(ask("status", "--porcelain").stdout.strip())}


def verify_digests(spark: SparkSession, recorded: dict[str, str]) -> None:
    """Fails unless every file (path: digest) is what was recorded."""
    wrong = [p for p, d in recorded.items() if file_digest(spark, p) != d]
    if wrong:
        raise ValueError(f"files differ from what was recorded: {', '.join(sorted(wrong))}")


def fingerprint_of(*arrays):
    """SHA-256 over the elements of arrays of doubles, in order."""
    return F.sha2(F.concat_ws("|", *[F.concat_ws(",", F.transform(a, lambda x: x.cast("string"))) for a in arrays]), 256)


def combined_fingerprint(rows: DataFrame, key: str, digest: str, digits: int = 3) -> DataFrame:
    """One digest over all (key, digest) rows, in two levels: rows by key within the buckets that the first hexadecimal digits of the
    key's digest name, then the buckets' digests by bucket."""

    def joined(frame, a, b, *by):
        pairs = F.sort_array(F.collect_list(F.struct(a, b)))
        return frame.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.transform(pairs, lambda x: F.concat_ws(" ", x[a], x[b]))), 256).alias("fingerprint"))

    buckets = joined(rows.withColumn("bucket", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits)), key, digest, "bucket")
    return joined(buckets, "bucket", "fingerprint")


def positions(profiles: DataFrame, *keys: str) -> DataFrame:
    """Profiles as rows: keys, pos, relative_position (0 to 1), mean, std, and depth where there is one."""
    columns = [c for c in ("mean", "std", "dwell", "depth", "supported") if c in profiles.columns]
    rows = profiles.select(*keys, F.size("mean").alias("n"), F.posexplode(F.arrays_zip(*columns)).alias("pos", "x"))
    relative = F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return rows.select(*keys, "pos", relative.alias("relative_position"), *[F.col(f"x.{c}").alias(c) for c in columns])


class Tables:
    """Tables in the shared folder of spark.checkpoint.dir that an operator's rounds write and read again: they carry no lineage, and
    none of what the planner has found out about their columns, which grows from round to round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/sigspark-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, frame: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset and all runs in one process, as in tests, a temporary one; else
    that is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/") if folder else "file://" + tempfile.mkdtemp(prefix="sigspark-")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder of spark.checkpoint.dir, so that plans over it stay short."""
    spark = frame.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()

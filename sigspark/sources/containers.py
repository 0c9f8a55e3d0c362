"""Containers of named arrays (zip files of .npy members, as numpy.savez writes them) as a source and a sink of Spark.

A row is one array, or one slice along the first axis of an array of several axes: (path, member, row, shape, values, texts). Large files are read in
splits, as text files are: a task takes the slices (of compressed members: the members) that begin in its range of bytes, so no task
and no row holds a whole matrix. Only the sizes of files are looked at on the driver. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import fnmatch
import io
import math
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, member string, row long, shape array<long>, values array<double>, texts array<string>"
#: Bytes of files that one task reads.
SPLIT = 64 << 20
#: Bytes of values in one batch.
BATCH = 4 << 20
SUFFIX = ".npy"
_ARROW = {"path": pa.string(), "member": pa.string(), "row": pa.int64(), "shape": pa.list_(pa.int64()), "values": pa.list_(pa.float64()), "texts": pa.list_(pa.string())}


def _opened(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Split(InputPartition):
    """Ranges (path, first byte, byte after the last) of files that a task reads."""

    ranges: list

    def __init__(self, ranges):
        self.ranges = ranges


class Reader(DataSourceReader):
    """Plans ranges of files and reads the arrays that begin in them; `members` is a pattern of names, as of files."""

    def __init__(self, options, columns):
        self.where, self.columns = options["path"], columns
        self.split = int(options.get("split", SPLIT))
        self.tests = {"member": [("like", options["members"])] if "members" in options else [], "path": [], "row": []}

    def partitions(self):
        file_system, at = _opened(self.where)
        info = file_system.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no containers at {self.where}")
        files = [info] if info.type == pafs.FileType.File else file_system.get_file_info(pafs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.path.endswith(".npz"))
        splits, room = [], 0
        for path, size in files:
            if not self.wanted("path", path):
                continue
            for lo in range(0, max(1, size), self.split):
                part = min(self.split, size - lo)
                if room < part:
                    splits.append([])
                    room = self.split
                splits[-1].append((path, lo, lo + self.split))
                room -= part
        return [Split(s) for s in splits] or [Split([])]

    def wanted(self, column, value) -> bool:
        return all(
            {"like": lambda a, b: fnmatch.fnmatchcase(a, b), "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[kind](value, other)
            for kind, other in self.tests[column]
        )

    def read(self, partition):
        file_system, _ = _opened(self.where)
        for path, lo, hi in partition.ranges:
            with file_system.open_input_file(path) as raw, zipfile.ZipFile(raw) as container:
                for info in container.infolist():
                    name = info.filename.removesuffix(SUFFIX)
                    if info.filename.endswith(SUFFIX) and self.wanted("member", name):
                        yield from self.slices(container, info, path, name, lo, hi)

    def slices(self, container, info, path, name, lo, hi):
        # a compressed member belongs to the range in which it begins
        if info.compress_type != zipfile.ZIP_STORED and not lo <= info.header_offset < hi:
            return
        # a stored one begins to be looked at from where its directory entry says
        if info.header_offset >= hi or info.compress_type == zipfile.ZIP_STORED and info.header_offset + info.file_size + 2 * (1 << 16) < lo:
            return
        with container.open(info) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if dtype.hasobject or dtype.kind not in "biufSU":
                raise ValueError(f"{path}: member {name} has kind {dtype}, not numbers or texts")
            n = shape[0] if len(shape) > 1 else 1
            each = shape[1:] if len(shape) > 1 else shape
            width = math.prod(each) * dtype.itemsize
            begin = f.tell()
            first, last = 0, n
            if fortran and len(shape) > 1 or info.compress_type != zipfile.ZIP_STORED:
                if not lo <= info.header_offset < hi:
                    return
            else:
                at = info.header_offset + begin  # in order of the file, whatever the length of the header in between
                first, last = ((min(n, max(0, -(-(x - at) // width))) if width else (0 if x <= at else n)) for x in (lo, hi))
            rows = [r for r in range(first, last) if self.wanted("row", r)]
            if "values" not in self.columns and "texts" not in self.columns:
                for k in range(0, len(rows), 1 << 16):
                    yield self.batch(path, name, rows[k : k + (1 << 16)], shape, None, dtype)
                return
            if fortran and len(shape) > 1:
                whole = np.frombuffer(f.read(), dtype).reshape(shape, order="F")
            step = max(1, BATCH // max(1, width))
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                if fortran and len(shape) > 1:
                    values = whole[own].reshape(len(own), -1)
                else:
                    parts = []
                    for r in own:
                        if f.tell() != begin + r * width:
                            f.seek(begin + r * width)
                        parts.append(f.read(width))
                        if len(parts[-1]) != width:
                            raise ValueError(f"{path}: member {name} ends before its shape {shape}")
                    values = np.frombuffer(b"".join(parts), dtype).reshape(len(own), -1)
                yield self.batch(path, name, own, shape, values, dtype)

    def batch(self, path, name, rows, shape, values, dtype):
        made = {"path": lambda: [path] * len(rows), "member": lambda: [name] * len(rows), "row": lambda: rows, "shape": lambda: [list(shape)] * len(rows)}
        made["values"] = lambda: None if dtype.kind in "SU" else list(values.astype(float))
        made["texts"] = lambda: None if dtype.kind not in "SU" else [[x.decode() if isinstance(x, bytes) else x for x in v] for v in values.tolist()]
        columns = []
        for c in self.columns:
            data = made[c]()
            columns.append(pa.nulls(len(rows), _ARROW[c]) if data is None else pa.array(data, _ARROW[c]))
        return pa.RecordBatch.from_arrays(columns, self.columns)


class PushingReader(Reader):
    """A reader that takes the filters on path, member and row; for sessions that push filters to Python sources."""

    def pushFilters(self, filters):
        kinds = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.tests and isinstance(f, (EqualTo, In)):
                self.tests[column].append(("in", [f.value] if isinstance(f, EqualTo) else list(f.value)))
            elif column in ("path", "member") and isinstance(f, StringStartsWith):
                self.tests[column].append(("starts", f.value))
            elif column == "row" and type(f) in kinds:
                self.tests[column].append((kinds[type(f)], f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    """One container for each task that has rows (member, values), under the name of its attempt; commit removes what other attempts left."""

    def __init__(self, options, overwrite):
        self.where, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        file_system, at = _opened(self.where)
        task = TaskContext.get()
        path, container = f"{at.rstrip('/')}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job}.npz", None
        for batch in iterator:
            for member, values in zip(batch.column("member").to_pylist(), batch.column("values")):
                if member is None or not values.is_valid:
                    raise ValueError("a member needs a name and values")
                if container is None:
                    file_system.create_dir(at, recursive=True)
                    stream = file_system.open_output_stream(path)
                    container = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                content = io.BytesIO()
                np.lib.format.write_array(content, values.values.to_numpy(zero_copy_only=False), allow_pickle=False)
                container.writestr(member + SUFFIX, content.getvalue())
        if container is not None:
            container.close()
            stream.close()
        return Written(path if container is not None else None)

    def _remove(self, which):
        file_system, at = _opened(self.where)
        for f in file_system.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=True)):
            if f.path.endswith(".npz") and which(f.path):
                file_system.delete_file(f.path)

    def commit(self, messages):
        kept = {m.path for m in messages if m is not None}
        self._remove(lambda p: p not in kept and (self.overwrite or self.job in p))

    def abort(self, messages):
        self._remove(lambda p: self.job in p)


class ArrayContainers(DataSource):
    @classmethod
    def name(cls):
        return "array_containers"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        columns = schema.fieldNames()
        if unknown := set(columns) - set(_ARROW):
            raise ValueError(f"containers have no columns {sorted(unknown)}")
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(dict(self.options), columns)

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def read_arrays(spark: SparkSession, path: str, members: str | None = None, columns: tuple[str, ...] = ("path", "member", "row", "shape", "values", "texts"), split: int = SPLIT) -> DataFrame:
    """The arrays of the containers under path whose names fit the pattern; without `values` and `texts` only headers are read.

    Filters on path, member and row reach the source where spark.sql.python.filterPushdown.enabled is set. Numbers and truth
    values are doubles, texts strings; other kinds are a named error, as are members that end early. Arrays of one axis or none are one
    row, empty ones too. Members stored in column order are read whole by one task.
    """
    spark.dataSource.register(ArrayContainers)
    kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    options = {"split": str(split), "pushdown": str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()}
    if members is not None:
        options["members"] = members
    return spark.read.format("array_containers").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).options(**options).load(path)


def write_arrays(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (member, values) as containers, one for each task; a task holds one array at a time."""
    rows.sparkSession.dataSource.register(ArrayContainers)
    rows.select(F.col("member").cast("string").alias("member"), F.col("values").cast("array<double>").alias("values")).write.format("array_containers").mode(mode).save(path)


# --- caches with a table beside them -------------------------------------------------------------------------------------


def _checked(frame: DataFrame, wrong: list[tuple[Column, Column]], strict: bool, carrier: str) -> DataFrame:
    """Adds what is wrong with a row (null where nothing is); strict: such a row fails the job with that text. The carrier's value
    depends on the check as well, so that no filter on it, of the planner or a user, can drop such a row unseen."""
    problem = F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), text) for test, text in wrong])
    out = frame.withColumn("problem", problem)
    if not strict:
        return out
    bad, kind = F.col("problem").isNotNull(), frame.schema[carrier].dataType
    out = out.withColumn(carrier, F.when(bad, F.raise_error(F.col("problem")).cast(kind)).otherwise(F.col(carrier)))
    return out.where(F.when(bad, F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True))).drop("problem")


def _finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def write_trace_cache(traces: DataFrame, path: str, channels: tuple[str, ...] = ("mean", "std", "dwell")) -> None:
    """Traces as members channel_index, with `index` the trace's."""
    member = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{c}_"), F.col("index").cast("string")).alias("member"), F.col(c).alias("values")) for c in channels])).alias("x")
    write_arrays(traces.select(member).select("x.*"), path)


def read_trace_cache(spark: SparkSession, path: str, companion: DataFrame, channels: tuple[str, ...] = ("mean", "std", "dwell"), strict: bool = True) -> DataFrame:
    """The companion's rows with their cached channels, checked against `n_steps`.

    companion has `index` and `n_steps`; only its traces are returned. Wrong is a trace that isn't cached or lacks a channel, is cached
    twice, has channels of different lengths or of another length than n_steps, or values that aren't finite. Strict: an error that names the
    trace; else such rows have their `problem`. Repeated rows of the companion give repeated rows.
    """
    found = F.regexp_extract("member", "^(.*)_([0-9]+)$", 1)
    cached = read_arrays(spark, path, columns=("member", "shape", "values")).select(found.alias("_channel"), F.regexp_extract("member", "^(.*)_([0-9]+)$", 2).cast("long").alias("index"), F.size("shape").alias("_axes"), "values")
    cached = cached.where(F.col("_channel").isin(*channels) & F.col("index").isNotNull())
    one = [F.max(F.when(F.col("_channel") == c, F.col("values"))).alias(c) for c in channels]
    cached = cached.groupBy("index").agg(*one, F.count(F.lit(1)).alias("_members"), F.max("_axes").alias("_axes"))
    own = companion.drop(*channels, "_members", "_axes").withColumn("index", F.col("index").cast("long"))
    rows = own.join(cached, "index", "left")
    named = lambda text: F.concat(F.lit("trace "), F.coalesce(F.col("index").cast("string"), F.lit("without an index")), F.lit(f" {text}"))
    first = F.col(channels[0])
    wrong = [
        (F.col("_members").isNull(), named("isn't cached")),
        (F.col("_members") > len(channels), named("is cached twice")),
        (F.array_contains(F.array(*[F.col(c).isNull() for c in channels]), True), named("lacks a channel")),
        (F.array_contains(F.array(*[F.size(c) != F.size(first) for c in channels]), True) | (F.col("_axes") != 1), named("has channels of different shapes")),
        (F.size(first) != F.col("n_steps"), named("differs in length from its row")),
        (~F.forall(F.array(*[_finite(F.col(c)) for c in channels]), lambda x: x), named("has values that aren't finite")),
    ]
    return _checked(rows, wrong, strict, channels[0]).drop("_members", "_axes")


def read_distance_cache(spark: SparkSession, path: str, companion: DataFrame, strict: bool = True, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Edge list (group, a, b, d), a < b, of cached matrices: a member for each group, its axis the companion's `position` in the group.

    companion has group, position (0 to n-1, each once) and trace_id. Wrong is a group without a matrix, a matrix whose shape is
    not that of the group's rows, an entry that isn't finite or differs from its mirror beyond rtol and atol, and a diagonal entry beyond
    atol. Strict: an error that names the place; else such edges (and positions, with b null) have their `problem`.
    Groups of one trace give no edges. Matrices are read by rows; no task holds one.
    """
    sizes = companion.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    axis = companion.select("group", F.col("position").cast("long").alias("position"), "trace_id").join(sizes, "group")
    rows = read_arrays(spark, path, columns=("member", "row", "shape", "values")).select(F.col("member").alias("group"), F.col("row").alias("position"), "shape", "values")
    held = axis.withColumn("group", F.col("group").cast("string")).join(rows, ["group", "position"], "left")
    shaped = (F.size("shape") == 2) & (F.element_at("shape", 1) == F.col("_n")) & (F.get("shape", F.lit(1)) == F.col("_n"))
    at = lambda text: F.concat(F.col("group"), F.lit(f": {text} at "), F.coalesce(F.col("position").cast("string"), F.lit("no position")))
    wrong = [(F.col("shape").isNull() | ~shaped, at("matrix and rows differ")), (F.abs(F.get("values", F.col("position").cast("int"))) > atol, at("diagonal isn't zero")), (~_finite(F.col("values")), at("values aren't finite"))]
    held = _checked(held, wrong, strict, "values")
    cells = held.where("problem IS NULL") if not strict else held
    cells = cells.select("group", "position", F.posexplode("values").alias("other", "d")).where("other <> position")
    ends = cells.groupBy("group", F.least("position", F.col("other").cast("long")).alias("i"), F.greatest("position", F.col("other").cast("long")).alias("j"))
    edges = ends.agg(F.min("d").alias("d"), F.max("d").alias("_most"), F.count(F.lit(1)).alias("_sides"))
    far = F.abs(F.col("_most") - F.col("d")) > atol + rtol * F.greatest(F.abs("d"), F.abs("_most"))
    edges = _checked(edges, [((F.col("_sides") != 2) | far, F.concat(F.col("group"), F.lit(": not symmetric at "), F.concat_ws(", ", F.col("i").cast("string"), F.col("j").cast("string"))))], strict, "d")
    names = axis.select(F.col("group").cast("string").alias("group"), "position", "trace_id")
    kept = ["d"] if strict else ["d", "problem"]
    edges = edges.join(names.withColumnsRenamed({"position": "i", "trace_id": "_u"}), ["group", "i"]).join(names.withColumnsRenamed({"position": "j", "trace_id": "_v"}), ["group", "j"])
    edges = edges.select("group", F.least("_u", "_v").alias("a"), F.greatest("_u", "_v").alias("b"), *kept)
    if strict:
        return edges
    return edges.unionByName(held.where("problem IS NOT NULL").select("group", F.col("trace_id").alias("a"), F.lit(None).cast(dict(axis.dtypes)["trace_id"]).alias("b"), F.lit(None).cast("double").alias("d"), "problem"))


def read_profile_cache(spark: SparkSession, path: str, channels: tuple[str, ...] = ("mean", "std", "supported"), scalars: tuple[str, ...] = ("converged",), texts: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """One row for each container under path: its channels, of one length, its numbers and its texts. Strict: a container that lacks one of them or
    whose channels differ in shape or aren't finite fails the job; else it has its `problem`."""
    rows = read_arrays(spark, path).where(F.col("member").isin(*channels, *scalars, *texts))
    pick = lambda name, column: F.max(F.when(F.col("member") == name, F.col(column)))
    out = rows.groupBy("path").agg(
        *[pick(c, "values").alias(c) for c in channels], *[F.get(pick(c, "values"), F.lit(0)).alias(c) for c in scalars], *[F.get(pick(c, "texts"), F.lit(0)).alias(c) for c in texts],
        F.max(F.when(F.col("member").isin(*channels), F.size("shape"))).alias("_axes"),
    )
    named = lambda text: F.concat(F.col("path"), F.lit(f": {text}"))
    wrong = [
        (F.array_contains(F.array(*[F.col(c).isNull() for c in (*channels, *scalars, *texts)]), True), named("lacks a member")),
        (F.array_contains(F.array(*[F.size(c) != F.size(channels[0]) for c in channels]), True) | (F.col("_axes") != 1), named("channels differ in shape")),
        (~F.forall(F.array(*[_finite(F.col(c)) for c in channels]), lambda x: x), named("values aren't finite")),
    ]
    return _checked(out, wrong, strict, channels[0]).drop("_axes")

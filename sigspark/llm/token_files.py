"""Token ids in binary files (operator 4): frequency-ranked, byte-aligned variable-length integers, control bytes apart.

A folder holds `ranks.u32` (the id of each rank, most frequent first) and files `part-*.svb` in ascending doc_id order. A
file is a run of blocks of whole documents. A block: the magic number, four little-endian int64 counts (documents, ids,
control bytes, data bytes), the doc_ids as int64, the number of ids of each document as int64, the control bytes and the data
bytes. Each control byte holds the byte lengths, less one, of four ranks, two bits each from the low end; the data bytes
hold the ranks, little-endian. A block is decoded by looking its control bytes up in a table of lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._pretoken import LibraryWords, WordCoder, vocabulary_path
from ._shared import Stage, free_shuffles, new_path, texts, total_bytes

MAGIC = b"SVB1"
BLOCK_IDS = 1 << 20
#: Byte lengths of the four values of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | (code[:, 1] << 2) | (code[:, 2] << 4) | (code[:, 3] << 6)
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of the control and data bytes."""
    size = LENGTHS[control].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], "<i8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, data])


def read_blocks(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, numbers of ids, ranks) of each block of an open file."""
    while magic := file.read(4):
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        docs, n, controls, size = np.frombuffer(file.read(32), "<i8").tolist()
        ids, counts = np.frombuffer(file.read(8 * docs), "<i8"), np.frombuffer(file.read(8 * docs), "<i8")
        control, data = np.frombuffer(file.read(controls), np.uint8), np.frombuffer(file.read(size), np.uint8)
        yield ids, counts, decode_values(control, data, n)


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    return WordCoder(path, LibraryWords(path))


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches):
        coder, press = _coder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b, data, offs in T.chunks(batch.column(1)):
                ids, at = coder(data, offs)
                rows = [press.compress(np.append(ids[x:y], np.uint32(end_id)).astype("<u2" if end_id < 65536 and (y == x or ids[x:y].max() < 65536) else "<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at) + 1), pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _ids(packed: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _frequencies(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.bincount(_ids(packed, n), minlength=len(total))
            got[: len(total)] += total
            total = got
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, file_bytes: int = 1 << 26) -> DataFrame:
    """Encodes whole texts with the tokenizers library, appends end_id to each, and writes the files to folder.

    Returns the manifest, one row per file: file, start (ids in the files before it), n_docs, n_tokens. A null text is an
    empty one, and has the end id alone. Rows of one doc_id follow each other in the order of their packed ids, so the files
    are the same however often they are written; rows without an id are left out, and other columns, whatever their names. A text of
    any length is one document of one block. An empty table gives no files. Every executor must reach the folder by its URI. A file is written under a name of its own and then
    moved, so a task that is run again leaves one whole file.
    """
    path = path or vocabulary_path()
    stage = Stage(spark, "token-files")
    docs = texts(docs)
    _, volume = total_bytes(docs)
    encoded = stage.put(_encoded(docs, path, end_id), "ids")
    counted = encoded.select("n_tokens", "ids").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    by_rank = counted["id"].to_numpy(np.uint32)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank)
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/ranks.u32") as f:
        f.write(by_rank.astype("<u4").tobytes())

    def write(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.svb"
        fs, at = pafs.FileSystem.from_uri(folder)
        own = f"{at}/.{name}-{context.taskAttemptId()}"
        docs = tokens = 0
        first = None
        with fs.open_output_stream(own) as f:
            held, n = [], 0

            def flush():
                f.write(pack_block(np.array([x[0] for x in held]), np.array([len(x[1]) for x in held]), ranks.value[np.concatenate([x[1] for x in held])]))

            for batch in batches:
                for doc_id, count, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    first = doc_id if first is None else first
                    held.append((doc_id, _ids(packed, count)))
                    docs, tokens, n = docs + 1, tokens + count, n + count
                    if n >= BLOCK_IDS:
                        flush()
                        held, n = [], 0
            if held:
                flush()
        if docs:
            fs.move(own, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], ["file", "first", "n_docs", "n_tokens"])
        else:
            fs.delete_file(own)

    files = max(1, -(-volume // file_bytes))
    ordered = encoded.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
    manifest = stage.put(ordered.mapInArrow(write, "file string, first long, n_docs long, n_tokens long"), "manifest")
    rows = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["file"])
    stage.drop()
    free_shuffles(spark)
    start = 0
    for r in rows:
        r["start"] = start
        start += r["n_tokens"]
    return spark.createDataFrame([(r["file"], r["start"], r["n_docs"], r["n_tokens"]) for r in rows], "file string, start long, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32."""
    kept = [("ids", pa.binary())] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *kept, ("ids_crc32", pa.int64())])

    def read(batches):
        fs, at = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{at}/ranks.u32") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{at}/{file}") as f:
                    for doc_ids, counts, ranks in read_blocks(f):
                        ids = by_rank[ranks].astype("<u4")
                        ends = np.cumsum(counts)
                        raw = [ids[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                        columns = [pa.array(doc_ids), pa.array(start + ends - counts), pa.array(counts)]
                        columns += [pa.array(raw, pa.binary())] if with_ids else []
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([zlib.crc32(r) for r in raw], pa.int64())], schema=schema)
                        start += int(ends[-1])

    ddl = "doc_id long, start long, n_tokens long, " + ("ids binary, " if with_ids else "") + "ids_crc32 long"
    return manifest.select("file", "start").repartition(max(1, manifest.count())).mapInArrow(read, ddl)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, written to the shared folder and read back."""
    folder = new_path(spark, "tokens")
    manifest = write_token_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder, manifest, with_ids=False)

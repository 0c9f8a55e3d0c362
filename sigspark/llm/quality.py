"""Quality classifier by compression (operator 10).

Zstandard dictionaries are built from good and from bad labelled text (raw content: whole texts, so that whatever a
document shares with them costs little). A document is compressed in blocks, each from the dictionary alone, so that a long text
does not become its own dictionary. Its only feature is the difference of its compressed sizes under the two, a byte of its text;
a logistic curve fitted on labelled documents that built neither dictionary turns it into a calibrated score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .langid import held_out

#: Dictionary size in bytes.
DICTIONARY = 1 << 20
LEVEL = 9
#: Bytes of a text that are compressed together.
BLOCK = 256


@dataclass
class Model:
    """Two dictionaries and the curve: mean and scale of the feature, its weights (constant, slope)."""

    good: bytes
    bad: bytes
    mean: float = 0.0
    scale: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    level: int = LEVEL
    _made: list = field(default_factory=list, repr=False)

    def compressors(self) -> list:
        if not self._made:
            dicts = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None for d in (self.good, self.bad)]
            for d in filter(None, dicts):
                d.precompute_compress(level=self.level)
            self._made = [zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False) for d in dicts]
        return self._made

    def __getstate__(self):
        return self.__dict__ | {"_made": []}

    def difference(self, raw: bytes) -> float:
        """The normalised difference of the compressed sizes of the blocks: above 0 where the good dictionary helps more."""
        if not raw:
            return 0.0
        good, bad = self.compressors()
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks) / len(raw)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        x = curve((differences - self.mean) / self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def curve(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip(x, -6, 6)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method with a ridge on all but the first column."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def divide(texts: list[bytes], room: int = DICTIONARY) -> tuple[list[bytes], list[bytes]]:
    """Texts for a dictionary and texts for the curve: every second one goes into the dictionary, whole, as long as there is room for
    it; all others go to the curve, which has those of the dictionary only where there are no others."""
    build, rest = [], []
    for k, text in enumerate(texts):
        if k % 2 == 0 and len(text) <= room:
            build.append(text)
            room -= len(text)
        else:
            rest.append(text)
    return build, rest or build


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 2400, level: int = LEVEL, fit_bytes: int = 1 << 25) -> Model | None:
    """A model of the labelled rows (see labelled); None unless both labels occur.

    At most fit_rows documents and fit_bytes bytes of each label are used, those with the lowest hashes of their ids; each of them,
    whole, is in a dictionary or fits the curve (see divide). Ids are chosen before any text is moved; the chosen ones, twice
    fit_rows at most, go to all tasks. Of rows with one doc_id the least text is used.
    """
    chosen = labelled(docs, labels)
    ids = [chosen.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for label in (0, 1)]
    kept, used = [], [0, 0]
    for r in ids[0].union(ids[1]).collect():  # 2 * fit_rows at most
        if used[r["quality"]] + r["size"] <= fit_bytes:
            used[r["quality"]] += r["size"]
            kept.append((r["doc_id"], r["quality"]))
    own = docs.sparkSession.createDataFrame(kept, "doc_id long, quality int")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    sample = [[], []]
    for label, text in zip(rows.column("quality").to_pylist(), rows.column("text").to_pylist()):
        sample[label].append(text.encode())
    if not all(sample):
        return None
    build, rest = zip(*map(divide, sample))
    bad, good = map(b"".join, build)
    model = Model(good, bad, level=level)
    x = np.array([model.difference(t) for label in (0, 1) for t in rest[label]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    model.mean, model.scale = float(x.mean()), float(x.std()) or 1.0
    model.weights = logistic(curve((x - model.mean) / model.scale), y)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) from the text alone; without a model every score is 0.5.

    A null text is empty, and every empty text gets one and the same score, that of no difference. A score of exactly 0.5 counts as
    label 1. Equal texts get equal scores, in any row; repeated rows give repeated rows; rows without an id are left out.
    All blocks of a text of any length count. Other columns, whatever their names, are not read. An empty table gives an
    empty result.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for a, b, data, offs in T.chunks(batch.column(2)):
                if model is None:
                    value = np.full(b - a, 0.5)
                else:
                    raw = data.tobytes()
                    value = model.scores(np.array([model.difference(raw[x:y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, size in bytes, quality) of the labelled documents to learn from: those with text that are not held out.

    Rows without a label of 0 or 1 or without an id teach nothing; of a document with several labels the least counts.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return docs.where("text IS NOT NULL").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).join(own, "doc_id")


def op10_quality_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents; the labels are those of the table labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(spark, docs, fit(docs, labels))

"""Language identification (operator 7): sparse multinomial logistic regression on TF-IDF of character n-grams.

Characters are lower-cased; runs of other signs than letters are one blank. N-grams of one to three characters are hashed
to a fixed number of columns. Document frequencies are counted over all learning documents. Weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of the learning documents (`fit_rows`, whole
texts, the lowest hashes of the ids); a part of the sample is held back to set the temperature of the softmax.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import _text as T
from ._shared import free_shuffles, lowest_hashes

COLUMNS = 1 << 15
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
MARK = 1 << 31
CHUNK = 1 << 18  # bytes of text whose n-grams are counted at once

_fold: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, itself if a mark, else 0; marks have the top bit too."""
    if not _fold:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low[0])
            elif kind[0] == "M":
                table[c] = c | MARK
        _fold.append(table)
    return _fold[0]


def chunk_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, columns, counts, has letters) of a chunk of documents, columns ascending in each row."""
    rows = len(offs) - 1
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(place, offs)
    sign = _fold_table()[cp]
    letter = sign != 0
    total = np.concatenate([[0], np.cumsum(letter & (sign < MARK))])
    letters = total[first[1:]] - total[first[:-1]] > 0
    # one blank for each run of other signs, one before and one after each document
    doc = np.repeat(np.arange(rows), np.diff(first))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    sign, doc = sign[keep], doc[keep]
    n = len(sign)
    keys = []
    for k in ORDERS:
        if n >= k:
            code = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                code = code * np.uint64(0x100000001B3) + sign[i : n - k + 1 + i].astype(np.uint64) + np.uint64(1)
            whole = doc[: n - k + 1] == doc[k - 1 :]
            column = ((T.mix(code + np.uint64(k)) >> np.uint64(20)) % np.uint64(COLUMNS)).astype(np.int64)
            keys.append((doc[: n - k + 1] * COLUMNS + column)[whole])
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if rows * COLUMNS <= 1 << 22:
        dense = np.bincount(key, minlength=rows * COLUMNS)
        key = np.flatnonzero(dense)
        counts = dense[key]
    else:
        key, counts = np.unique(key, return_counts=True)
    pointers = np.searchsorted(key, np.arange(rows + 1) * COLUMNS)
    return pointers, key % COLUMNS, counts, letters


def tf_idf(pointers, columns, counts, idf) -> np.ndarray:
    """Rows of (1 + ln count) * idf, scaled to length one."""
    value = (1 + np.log(counts)) * idf[columns]
    rows = len(pointers) - 1
    row = np.repeat(np.arange(rows), np.diff(pointers))
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return value / np.where(norm > 0, norm, 1)[row]


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader (proximal) with l1 and l2 penalties."""

    def __init__(self, columns: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-2, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((columns, classes)), np.zeros((columns, classes))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)

    def _weights(self, z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def _step(self, z, n, g, w):
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        return z + g - s * w, n + g * g

    def update(self, columns: np.ndarray, values: np.ndarray, label: int) -> None:
        w, b = self._weights(self.z[columns], self.n[columns]), self._weights(self.bias_z, self.bias_n)
        logits = values @ w + b
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        self.z[columns], self.n[columns] = self._step(self.z[columns], self.n[columns], values[:, None] * p, w)
        self.bias_z, self.bias_n = self._step(self.bias_z, self.bias_n, p, b)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.z, self.n), self._weights(self.bias_z, self.bias_n)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, pointers, columns, counts) -> np.ndarray:
        value = tf_idf(pointers, columns, counts, self.idf)
        rows = len(pointers) - 1
        out = np.zeros((rows, len(self.labels)))
        row = np.repeat(np.arange(rows), np.diff(pointers))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(row, value * self.weights[columns, k], rows)
        return out + self.bias


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm between 1/20 and 20."""

    n, k = logits.shape
    slack = 1 / (n + 2)  # a target of exactly one would ask for no temperature at all where all rows are right
    target = np.full((n, k), slack / max(k - 1, 1))
    target[np.arange(n), labels] = 1 - slack

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    lo, hi, g = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def _document_frequencies(batches):
    total, n = np.zeros(COLUMNS, np.int64), 0
    for batch in batches:
        for a, b, data, offs in T.chunks(batch.column(0), CHUNK):
            _, columns, _, letters = chunk_features(data, offs)
            total += np.bincount(columns, minlength=COLUMNS)
            n += int(letters.sum())
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["column", "n"])


def fit(spark: SparkSession, learn: DataFrame, fit_rows: int = 3000, epochs: int = 3, fit_bytes: int = 1 << 26, **penalties) -> Model | None:
    """A model of the learning rows (doc_id, text, lang); None if there are none with letters.

    Rows without text, lang or letters teach nothing. The sample is of fit_rows rows and fit_bytes
    bytes of text at most, whole texts.
    """
    learn = learn.where("text IS NOT NULL AND lang IS NOT NULL")
    found = {int(r["column"]): int(r["n"]) for r in learn.select("text").mapInArrow(_document_frequencies, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()}
    n = found.pop(-1, 0)
    free_shuffles(spark)
    df = np.zeros(COLUMNS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = lowest_hashes(learn, fit_rows, fit_bytes, "text", "lang").toArrow()
    langs = sample.column("lang").to_pylist()
    rows, targets = [], []
    labels = sorted(set(langs))
    for a, b, data, offs in T.chunks(sample.column("text"), CHUNK):
        pointers, columns, counts, letters = chunk_features(data, offs)
        value = tf_idf(pointers, columns, counts, idf)
        for k in range(b - a):
            if letters[k]:
                rows.append((columns[pointers[k] : pointers[k + 1]], value[pointers[k] : pointers[k + 1]]))
                targets.append(labels.index(langs[a + k]))
    if not rows:
        return None
    learner = Ftrl(COLUMNS, len(labels), **penalties)
    held = len(rows) // 5
    shuffled = np.random.default_rng(7)
    for _ in range(epochs):
        for k in held + shuffled.permutation(len(rows) - held):
            learner.update(*rows[k], targets[k])
    weights, bias = learner.weights()
    temperature = 1.0
    if held:
        logits = np.array([v @ weights[c] + bias for c, v in rows[:held]])
        temperature = calibrate(logits, np.array(targets[:held]))
    return Model(labels, idf.astype(np.float32), weights.astype(np.float32), bias, temperature)


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs, then lang_pred and score, from the text alone.

    A text that is null or has no letters (of marks, digits or signs alone) is `und` with score 0; so is every text without a model. Of
    equally likely languages the one first in order of names is given. Repeated rows give equal rows; rows without an id are
    kept; a text of any length is read whole. Clashing column names are replaced. An empty table gives an empty result.
    """
    sent = spark.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*others)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    text_at = others.index("text")

    def run(batches):
        model = sent.value
        for batch in batches:
            for a, b, data, offs in T.chunks(batch.column(text_at), CHUNK):
                pointers, columns, counts, letters = chunk_features(data, offs)
                if model is None:
                    letters = np.zeros(b - a, bool)
                    p = np.zeros((b - a, 1))
                else:
                    p = softmax(model.logits(pointers, columns, counts) / model.temperature)
                names = [model.labels[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(axis=1), letters)]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), pa.array(np.where(letters, p.max(axis=1), 0.0))], names=[*own.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", modulus: int = 3, remainder: int = 1):
    """Whether the crc32 of the id as text leaves the remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus)) == remainder


def identify(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """All columns of docs, then lang_pred and score; the model is learnt from the documents that are not held out."""
    model = fit(spark, docs.where(~held_out()).select("doc_id", "text", "lang"), **options)
    return predict(spark, docs, model)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL").select("doc_id", "text", "lang")
    model = fit(spark, docs.where(~held_out()))
    return predict(spark, docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")

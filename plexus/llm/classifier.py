"""Quality classifier: logistic regression over hashed word n-grams, FTRL-proximal.

A text's features are its lower-cased words and marks and their pairs, hashed
into 2 ** 18 places, each weighted by the root of its count and the whole scaled
to length one. Weights are learnt by follow-the-regularised-leader updates and
broadcast as one array of fixed size (1 MB); a text's score is the logistic of a
sparse dot product.

Training reads labelled rows only, TRAIN_ROWS at most: those with the smallest
hash of their doc_id, which is the same choice at any size; of rows that share a
doc_id, the one with the smallest hash of its text. It runs in one task.

Defined results: a text without words (null and empty ones too) has the score of
the bias alone; labels that are null are ignored, of repeated labels of a
document the largest counts; without any label every score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, serve

BITS = 18
TRAIN_ROWS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
TOKENS = re.compile(r"\w+|[^\w\s]+")
CACHE = 200_000


class Hasher(dict):
    """word -> 32-bit hash, kept by each worker up to CACHE words."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode())
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


_hasher = Hasher()


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places and their values."""
    words = TOKENS.findall(text.lower()) if text else []
    h = np.fromiter(map(_hasher.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x85EBCA77) >> np.uint64(13)
    place, count = np.unique(np.concatenate([h * np.uint64(0xC2B2AE3D) >> np.uint64(7), pairs]) & np.uint64((1 << bits) - 1), return_counts=True)
    value = np.sqrt(count)
    return place.astype(np.int64), value / max(1e-9, np.sqrt((value**2).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, after FTRL-proximal updates in the rows' order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for place, value, label in rows:
            at, x = np.append(place, size - 1), np.append(value, 1.0)
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            squares = gradient**2
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squares
    return weights(np.arange(size))


def is_held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exclude_held_out: bool = True) -> np.ndarray:
    """Weights learnt from at most ``rows`` labelled documents."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    if exclude_held_out:
        known = known.where(~is_held_out("doc_id"))
    chosen = bounded_sample(known, "doc_id", rows)
    # The chosen rows are bound by ``rows``, so this side may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # A repeated doc_id gives one row: partial minima keep a row an id and task, so no id gathers its rows.
    texts = texts.groupBy("doc_id").agg(F.min_by(F.struct("text", "quality"), F.xxhash64("text")).alias("one")).select("doc_id", "one.text", "one.quality")

    def encode(batches):
        serve("classifier", _hasher.clear)
        for batch in batches:
            pairs = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()), pa.array([p.tolist() for p, _ in pairs], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in pairs], pa.list_(pa.float32()))],
                ["doc_id", "quality", "place", "value"],
            )

    def learn(batches):
        held = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (np.array(x.as_py(), np.int64) for x in batch.column(2)), (np.array(x.as_py()) for x in batch.column(3)), strict=True)
        held.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()[::-1]), r[0]))
        yield pa.RecordBatch.from_arrays([pa.array([train([(p, v, y) for _, y, p, v in held]).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    encoded = texts.mapInArrow(encode, "doc_id long, quality int, place array<int>, value array<float>")
    learnt = encoded.repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(learnt[0].weights, np.float32) if learnt else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and others), and score: double."""
    table = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches):
        serve("classifier", _hasher.clear)
        w = table.value.astype(np.float64)
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                place, value = features(text)
                out.append(1 / (1 + np.exp(-np.clip(w[place] @ value + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    weights = fit(docs, labels, rows)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights)
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

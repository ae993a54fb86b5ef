"""Deterministic hashed text embeddings, for offline use and tests."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
LONGEST_COUNTED = 16
GRAM = 3
GRAM_SHARE = 0.35
GRAM_PREFIX = "ng:"
DIGEST_BYTES = 8

CACHE = 100_000


def _place(feature: str) -> tuple[int, float]:
    """A feature's 32-bit hash and its sign."""
    d = hashlib.blake2b(feature.encode(), digest_size=DIGEST_BYTES).digest()
    return int.from_bytes(d[:4], "little"), -1.0 if d[4] & 1 else 1.0


class Embedder:
    """Keeps the sparse vectors of words it has met."""

    def __init__(self, dimensions: int):
        if dimensions <= 0:
            raise ValueError("hash embedding dimensions must be greater than zero")
        self.dimensions = dimensions
        self.words: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def word(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.words.get(word)
        if found is None:
            weight = 1.0 + min(len(word), LONGEST_COUNTED) / LONGEST_COUNTED
            grams = [word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))]
            places = [_place(word), *(_place(GRAM_PREFIX + g) for g in grams)]
            weights = np.array([weight] + [weight * GRAM_SHARE] * len(grams))
            found = np.array([p % self.dimensions for p, _ in places]), weights * [s for _, s in places]
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.dimensions)
        for word in re.findall(r"\w+", (text or "").casefold()):
            at, value = self.word(word)
            np.add.at(out, at, value)
        norm = np.sqrt(out @ out)
        if norm == 0.0:
            out[:] = 0.0
            out[0] = norm = 1.0
        return out / norm


def embed(df: DataFrame, dimensions: int = 128) -> DataFrame:
    """(id, vector) of each row's (id, text)."""

    def run(batches):
        model = Embedder(dimensions)
        for b in batches:
            rows = [model(t).astype(np.float32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], ["id", "vector"])

    return df.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, vector array<float>")

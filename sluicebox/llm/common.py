"""What the operators here share: batch settings, stable word hashes, staged tables."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

__all__ = ["LOWER", "ascii_words", "fold", "mix64", "prepare", "pick", "shingle_set", "stage", "table", "WordHashes"]

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so other columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but space and the controls 9 to 13."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


class WordHashes(dict):
    """Word to a stable 64-bit hash; forgets everything when full, so memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash for each place of arrays of equal length."""
    out = np.full(parts[0].shape, seed, np.uint64)
    for part in parts:
        out = out * _MULTIPLIER + part
    return mix64(out)


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one run."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    width = min(width, len(h))
    last = len(h) - width + 1
    return np.unique(fold([h[i : i + last] for i in range(width)], width))

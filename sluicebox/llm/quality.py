"""Document quality: ridge regression on random Fourier features of document statistics, calibrated isotonically.

One pass over the texts takes ``STATISTICS`` numbers of each. Random cosines of them approximate a Gaussian kernel. The normal
equations are sums over rows, taken in each partition and added up in a tree, so the driver gets a few matrices of fixed
size whatever the number of labelled rows. Three quarters of the labelled rows fit the weights; on the others, counts by bin of raw score
give a monotone map from raw scores to shares of label 1 (pool adjacent violators).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fold, pick, stage

STATISTICS = 20
FEATURES = 256
RIDGE = 1e-4
BINS = 512
_FAN = 64


def statistics(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Lengths, shares of kinds of characters, and repetition of words, runs of words and lines; zeros for no text."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(STATISTICS, np.float32)
    words = data.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    share = counts / len(data)
    used = share[share > 0]
    h = hashes.of(words)
    distinct, times = np.unique(h, return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    runs = fold([h[:-2], h[1:-1], h[2:]], 3) if len(h) > 2 else h[:0]
    letters = share[65:91].sum() + share[97:123].sum() + share[128:].sum()
    symbols = share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()
    out[:] = (
        np.log1p(len(data)), np.log1p(len(words)), len(data) / len(words), letters, share[48:58].sum(), share[65:91].sum(), share[9:14].sum() + share[32],
        symbols, share[ord("!")] + share[ord("?")], share[[ord(c) for c in "#$%&*|~^_=+@<>"]].sum(), share[ord(",")] + share[ord(".")],
        -(used * np.log(used)).sum(), len(distinct) / len(h), times.max() / len(h), (h[1:] == h[:-1]).mean() if len(h) > 1 else 0,
        1 - len(np.unique(runs)) / len(runs) if len(runs) else 0, 1 - len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)),
        np.log1p(len(words) / (1 + counts[[46, 33, 63]].sum())), share[128:].sum(),
    )
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, row, stats array<float>) of every row; a null or blank text has zeros. ``row`` is the column ``row_col``, or the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [statistics(t, hashes) for t in batch.column("text").to_pylist()]
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.float32))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.ListArray.from_arrays(ends, values)], ["doc_id", "row", "stats"])

    source = pick(docs, id=id_col, row=row_col or id_col, text=text_col)
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"doc_id {kinds['id']}, row {kinds['row']}, stats array<float>")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, STATISTICS).astype(np.float64)


def _summed(rows: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of ``of(batch)``: in each partition, then by ``_FAN`` partitions, then by ``_FAN`` of those, then here.

    A task adds up at most ``_FAN`` sums, and one sum for ``_FAN`` ** 2 partitions reaches the driver.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(rows: pa.Table) -> pa.Table:
        return pa.table({"total": pa.array([np.sum([np.frombuffer(x) for x in rows.column("total").to_pylist()], axis=0).tobytes()], pa.binary())})

    def step(key: tuple, rows: pa.Table) -> pa.Table:
        return add(rows).append_column("branch", pa.array([key[0].as_py() // _FAN], pa.int32()))

    sums = rows.mapInArrow(parts, "total binary").withColumn("branch", F.floor(F.spark_partition_id() / _FAN).cast("int"))
    for _ in range(2):
        sums = sums.groupBy("branch").applyInArrow(step, "total binary, branch int")
    return np.sum([np.frombuffer(r["total"]) for r in sums.select("total").collect()] or [np.zeros(shape).ravel()], axis=0).reshape(shape)


def isotonic(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to positive / count in the weighted squares; bins without rows are interpolated."""
    filled = np.flatnonzero(count > 0)
    blocks: list[list[float]] = []
    for p, n in zip(positive[filled], count[filled], strict=True):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + n, blocks[-1][2] + k]
    values = np.concatenate([np.full(int(k), p / n) for p, n, k in blocks]) if blocks else np.array([0.5])
    return np.interp(np.arange(len(count)), filled if len(filled) else [0], values)


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(x), 1)), x / 6, np.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.phases)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    @staticmethod
    def bins(raw: np.ndarray) -> np.ndarray:
        return np.clip((raw + 0.5) / 2, 0, 1) * (BINS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated shares; a thousandth of the raw order is mixed in, so that equal levels keep it."""
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(self.bins(raw), np.arange(BINS), self.levels) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit(labelled: DataFrame, seed: int = 7) -> QualityModel:
    """A model of (doc_id, stats, label 0 or 1). Without labelled rows every score is one half."""
    to_fit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) != 0
    rows = stage(labelled.select("stats", F.col("label").cast("double").alias("label"), to_fit.alias("fit")), "labelled")
    part = rows.where("fit")
    moments = _summed(part, lambda b: np.vstack([np.ones(STATISTICS) * b.num_rows, (x := _numbers(b)).sum(0), (x**2).sum(0)]), (3, STATISTICS))
    n = max(moments[0, 0], 1.0)
    mean = moments[1] / n
    spread = np.sqrt(np.maximum(moments[2] / n - mean**2, 1e-12)) + 1e-9
    draw = np.random.default_rng(seed)
    model = QualityModel(
        mean, spread, draw.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.full(BINS, 0.5)
    )
    width = 1 + STATISTICS + FEATURES

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_numbers(batch))
        return np.vstack([z.T @ z, z.T @ batch.column("label").to_numpy()])

    sums = _summed(part, equations, (width + 1, width))
    model.weights = np.linalg.solve(sums[:-1] + RIDGE * n * np.eye(width), sums[-1])

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        at, y = np.rint(model.bins(model.raw(_numbers(batch)))).astype(int), batch.column("label").to_numpy()
        return np.vstack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    model.levels = isotonic(*_summed(rows.where("not fit"), counts, (2, BINS)))
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, teach: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None
) -> DataFrame:
    """(doc_id, row, score): how likely label 1 is for every row of ``docs``, learned from the rows of ``labels`` where ``teach`` holds.

    Null labels, ids without a text and texts without a label teach nothing. Blank and null texts get a score like any other.
    Repeated rows get equal scores; ``row`` is the column ``row_col``, or the id. ``teach`` is a condition on the labels' ``doc_id``.
    """
    stats = stage(document_statistics(docs, id_col, text_col, row_col), "statistics")
    known = pick(labels, doc_id=id_col, label=label_col).where(teach).where("label IN (0, 1)")
    model = fit(stats.join(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(model.score(_numbers(batch)))], ["doc_id", "row", "score"])

    kinds = dict(stats.dtypes)
    return stats.mapInArrow(run, f"doc_id {kinds['doc_id']}, row {kinds['row']}, score double")

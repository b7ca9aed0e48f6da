"""Exact nearest neighbours by a block matrix join with int8 tiles.

Candidates and queries are dealt into blocks, and every pair of a query block and a candidate block is one tile, a task's
work. In a tile each vector becomes int8 numbers times a scale, and its own rounding error is known. The matrix product of the
int8 numbers then bounds each distance from both sides. A candidate survives for a query if its lower bound is not above the k-th
smallest upper bound; survivors are computed again from the original vectors in double precision. A heap keeps the k
best of a tile, and heaps merge those of all tiles in two steps, so no result misses a neighbour.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

CANDIDATE_BLOCK, QUERY_BLOCK, MERGED_BLOCKS = 4096, 2048, 64
_FOUND = "query_id long, place long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and finite components that are not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = pick(vectors, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("vector").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return rows.column("vec_id").to_numpy(), values.reshape(rows.num_rows, -1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scales, and the norms of what rounding takes away."""
    scale = np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny) / 127
    numbers = np.rint(x / scale[:, None]).astype(np.int8)
    return numbers, scale, np.sqrt(((x - numbers * scale[:, None]) ** 2).sum(axis=1))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances from x to the rows of y, summed from the first component to the last."""
    return np.sqrt(np.add.accumulate((y - x) ** 2, axis=1)[:, -1])


def tile(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the k nearest candidates of each query, without those of the query's id."""
    (query_ids, x), (ids, y) = queries, candidates
    (p, p_scale, p_error), (q, q_scale, q_error) = quantised(x), quantised(y)
    kind = np.float32 if x.shape[1] <= 1024 else np.float64  # sums of products below 2^24 are exact in either
    q_wide, q_norm = q.astype(kind).T, q_scale**2 * (q.astype(np.float64) ** 2).sum(axis=1)
    reach, out = np.sqrt((y**2).sum(axis=1)), []
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        product = (p[part].astype(kind) @ q_wide).astype(np.float64)
        norm = p_scale[part] ** 2 * (p[part].astype(np.float64) ** 2).sum(axis=1)
        middle = np.sqrt(np.maximum(norm[:, None] + q_norm - 2 * p_scale[part, None] * q_scale * product, 0))
        spread = p_error[part, None] + q_error + 1e-7 * (np.sqrt((x[part] ** 2).sum(axis=1))[:, None] + reach)
        own = query_ids[part, None] == ids
        upper = np.where(own, np.inf, middle + spread)
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(upper), np.inf)
        survives = (middle - spread <= bound[:, None]) & ~own
        for i in range(len(upper)):
            near = np.flatnonzero(survives[i])
            scores = exact(x[at + i], y[near])
            out += [(int(query_ids[at + i]), v, s) for s, v in heapq.nsmallest(k, zip(scores.tolist(), ids[near].tolist(), strict=True))]
    return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` of each row of ``queries``, by Euclidean distance.

    Exact: nearest first, ties to the smaller id, fewer where there are fewer. Rows whose id is null or whose vector is null, empty, zero, or holds null or
    non-finite components take no part. Only vectors of the query's length are candidates; those with its own id are not. Rows of
    ``vectors`` that repeat an id are candidates of their own; a repeated query is answered once.
    """
    found, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    blocks = max(1, -(-found.count() // CANDIDATE_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.select(
            "vec_id", "vector", F.size("vector").alias("width"), F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other),
        ).groupBy("width", "query_block", "block")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = tile(_matrix(left), _matrix(right), k) if left.num_rows and right.num_rows else []
        return _table([(q, key[2].as_py(), v, s) for q, v, s in rows])

    tiles = dealt(asked, "query_block", query_blocks, "block", blocks).cogroup(dealt(found, "block", blocks, "query_block", query_blocks))
    near = tiles.applyInArrow(run, _FOUND)

    def best(key: tuple, rows: pa.Table) -> pa.Table:
        heap = heapq.nsmallest(k, zip(rows.column("score").to_pylist(), rows.column("vec_id").to_pylist(), strict=True))
        return _table([(key[0].as_py(), i + 1, v, s) for i, (s, v) in enumerate(heap)])

    some = near.groupBy("query_id", F.floor(F.col("place") / MERGED_BLOCKS)).applyInArrow(best, _FOUND)
    ranked = some.groupBy("query_id").applyInArrow(best, _FOUND) if blocks > MERGED_BLOCKS else some
    return ranked.select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")


def _table(rows: list[tuple[int, int, int, float]]) -> pa.Table:
    kinds = {"query_id": pa.int64(), "place": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})

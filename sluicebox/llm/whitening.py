"""Whitening of embeddings by a bidiagonal qd solver.

Centred rows are reduced to a triangle R by QR, block by block and then in a tree, so that no task holds more than a block or a few triangles.
R becomes bidiagonal by Householder reflections. The differential qd algorithm with shifts (dqds) finds the singular values of the bidiagonal matrix, each to
high relative accuracy, and twisted factorisations give the right singular vectors of the largest ones: the whitening directions.

The covariance is that of the distinct vectors of whole numbers floor(``SCALE`` * c). It is never formed; its eigenvalues are the squares of
the singular values over the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stage

SCALE, COMPONENTS = 256, 4
BLOCK, FAN_IN = 4096, 16
#: Singular values below this share of the largest are taken as zero.
RANK = 1e-13
_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


# The solver: numpy on one triangle, whose size depends on the dimensions only.


def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, length): I - 2 v v' takes x to (length, 0, ..., 0); v is a unit vector, or zero where x is already there."""
    rest = np.abs(x[1:]).max(initial=0.0)
    if rest == 0:
        return np.zeros_like(x), float(x[0])
    scaled = x / max(rest, abs(x[0]))
    length = -math.copysign(float(np.sqrt(scaled @ scaled)), scaled[0])
    scaled[0] -= length
    return scaled / np.sqrt(scaled @ scaled), length * max(rest, abs(x[0]))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(d, f, right): the diagonal and the upper one of U' R V, and the reflections whose product is V."""
    a, n, right = r.astype(float).copy(), len(r), []
    for k in range(n):
        v, _ = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, _ = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def back(right: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """V z."""
    z = z.copy()
    for k in reversed(range(len(right))):
        z[k + 1 :] -= 2 * right[k] * (right[k] @ z[k + 1 :])
    return z


def _dqd(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One differential qd step; the third value is the smallest remainder, negative where the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            new_e[i], d = 0.0, q[i + 1] - shift
        else:
            ratio = q[i + 1] / new_q[i]
            new_e[i], d = e[i] * ratio, d * ratio - shift
        least = min(least, d)
        if d < 0 and shift:
            return new_q, new_e, least
    new_q[n - 1] = d
    return new_q, new_e, least


def _smallest(q: np.ndarray, e: np.ndarray) -> float:
    """A shift that is likely below the smallest eigenvalue: Newton's bound at the end of the array, or the last two by two block."""
    if len(q) == 2:
        a, b, c = q[0] + e[0], math.sqrt(max(q[1] * e[0], 0.0)), q[1]
    else:
        a, b, c = q[-2] + e[-2], math.sqrt(max(q[-1] * e[-2], 0.0)) if e[-2] > 0 else 0.0, q[-1] + e[-1]
    middle, half = (a + c) / 2, math.hypot((a - c) / 2, b)
    return max(0.0, middle - half)


def singular_values(d: np.ndarray, f: np.ndarray) -> np.ndarray:
    """All singular values of the upper bidiagonal matrix, falling, by dqds with deflation and splitting."""
    found: list[float] = []
    todo = [(np.asarray(d, float) ** 2, np.asarray(f, float) ** 2, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        least, failed = 0.0, 0
        while len(q):
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            small = np.flatnonzero(e <= _EPS**2 * (np.minimum(q[:-1], q[1:]) + moved))
            if len(small):
                at = int(small[-1]) + 1
                todo.append((q[:at], e[: at - 1], moved))
                q, e = q[at:], e[at:]
                least = 0.0
                continue
            if q[0] < q[-1]:  # graded the wrong way: the matrix in reverse order has the same values and converges faster
                q, e = q[::-1], e[::-1]
            shift = 0.0 if failed > 4 else min(_smallest(q, e) * (0.999 if failed == 0 else 0.25**failed), least or math.inf)
            shift = shift if math.isfinite(shift) else 0.0
            new_q, new_e, left = _dqd(q, e, shift)
            if shift and left < 0:
                failed += 1
                continue
            q, e, moved, failed = new_q, new_e, moved + shift, 0
            least = max(0.0, left)
    return np.sqrt(np.maximum(np.sort(np.array(found))[::-1], 0.0))


def twisted(d: np.ndarray, f: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B for the eigenvalue ``value``, by the twisted factorisation of B'B - value.

    The stationary transform goes down, the progressive one goes up; where they meet with the smallest remainder, the vector is largest, and
    multiplications away from there give the other entries.
    """
    n, q, e = len(d), d * d, f * f
    if n == 1:
        return np.ones(1)
    down, up = np.empty(n), np.empty(n)  # pivots of the two factorisations of the tridiagonal matrix
    s, p = -value, q[n - 1] - value
    lows, highs = np.empty(n - 1), np.empty(n - 1)
    remainder_down, remainder_up = np.empty(n), np.empty(n)
    for i in range(n - 1):
        remainder_down[i] = s
        down[i] = s + q[i]
        down[i] = down[i] if down[i] else -_EPS * max(q[i], value, _TINY)
        lows[i] = d[i] * f[i] / down[i]
        s = e[i] * (s / down[i]) - value
    remainder_down[n - 1] = s
    for i in range(n - 2, -1, -1):
        remainder_up[i + 1] = p
        up[i + 1] = e[i] + p
        up[i + 1] = up[i + 1] if up[i + 1] else -_EPS * max(e[i], value, _TINY)
        highs[i] = d[i] * f[i] / up[i + 1]
        p = p * (q[i] / up[i + 1]) - value
    remainder_up[0] = p
    meeting = np.abs(remainder_down + remainder_up + value)
    at = int(np.argmin(np.where(np.isfinite(meeting), meeting, np.inf)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -lows[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -highs[i] * z[i]
    z /= np.abs(z).max()
    return z / np.sqrt(z @ z)


def directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the largest ``count`` singular values of R that are not zero, and their right singular vectors as rows."""
    d, f, right = bidiagonal(r)
    top = max(np.abs(d).max(initial=0.0), np.abs(f).max(initial=0.0))
    if top == 0:
        return np.zeros(0), np.zeros((0, len(r)))
    f = np.where(np.abs(f) <= _EPS * top * 1e-3, 0.0, f)
    cuts = [0, *(np.flatnonzero(f == 0) + 1).tolist(), len(d)]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # parts that do not touch have values of their own
        found += [(value, a, b) for value in singular_values(d[a:b], f[a : b - 1])]
    found.sort(key=lambda x: -x[0])
    found = [x for x in found[:count] if x[0] > RANK * found[0][0]]
    made: list[np.ndarray] = []
    for i, (value, a, b) in enumerate(found):
        z = np.zeros(len(d))
        z[a:b] = twisted(d[a:b], f[a : b - 1], value * value)
        for j in range(i):  # vectors of values that nearly agree are made orthogonal
            if found[j][0] - value <= 1e-3 * found[j][0]:
                z -= made[j] * (made[j] @ z)
        if z @ z < 1e-4:  # the same vector twice: any one orthogonal to the others will do
            z = _other(made, len(d), a, b)
        made.append(z / np.sqrt(z @ z))
    vectors = np.array([back(right, z) for z in made])
    return np.array([x[0] for x in found]), vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _other(made: list[np.ndarray], n: int, a: int, b: int) -> np.ndarray:
    rest = np.eye(n)[a:b]
    for z in made:
        rest = rest - np.outer(rest @ z, z)
    return rest[np.argmax((rest * rest).sum(axis=1))]


# The Spark side: whole numbers, exact sums, triangles in a tree, and the rows' results.


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n vectors with exact sums by dimension, and for each component its eigenvalue, share of the variance and direction."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    explained: tuple[float, ...]
    vectors: np.ndarray
    identity_error: float


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of every entry, of the rows that take part.

    A vector that is null, empty, or holds null or non-finite entries takes no part; neither does one with an entry too large for a long.
    """
    entries = pick(vectors, vec_id=id_col, vector=vector_col).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    fits = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale))
    rows = entries.where(F.coalesce(fits & (F.size("vector") > 0), F.lit(False)))
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * scale)).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by dimension of a partition, as high and low halves that cannot overflow."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), len(batch.column("x")[0]))
            part = [int(h) * 2**32 + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
            total, n = part if total is None else [a + b for a, b in zip(total, part, strict=True)], n + len(x)
    if total is not None:
        kinds = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array(total, kinds), pa.array([n] * len(total), pa.int64())], ["dim", "total", "n"]
        )


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n with the whole part of the mean taken off in whole numbers."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR factorisation, always square."""
    r, width = np.linalg.qr(rows, mode="r"), rows.shape[1]
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def fit(numbers: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of ``numbers``, all of one length; None where there is none."""
    points = stage(numbers.select("x").distinct(), "points")
    exact = points.mapInArrow(_sums, "dim int, total decimal(38,0), n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = sorted(exact.collect())  # one row a dimension
    if not found:
        return None
    n, sums, width = found[0]["n"], [int(r["total"]) for r in found], len(found)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = triangle(np.vstack([r, _centred(_matrix(batch.column("x").slice(at, BLOCK), width), n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["place", "r"])

    def stacked(rows: pa.Table) -> np.ndarray:
        return triangle(np.vstack([np.frombuffer(r, float).reshape(width, width) for r in rows.sort_by("place").column("r").to_pylist()]))

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"place": pa.array([rows.column("place")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([stacked(rows).tobytes()], pa.binary())})

    def solve(rows: pa.Table) -> pa.Table:
        r = stacked(rows)
        values, vectors = directions(r, components)
        energies, total = values**2 / n, float((r * r).sum()) / n
        return pa.table({
            "component": pa.array(range(1, len(values) + 1), pa.int32()), "value": pa.array(energies), "explained": pa.array(energies / total if total else energies),
            "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())),
        })

    triangles = stage(points.mapInArrow(blocks, "place long, r binary"), "triangles")
    most = triangles.agg(F.max("place")).first()[0]
    while most >= FAN_IN:
        triangles = triangles.groupBy(F.floor(F.col("place") / FAN_IN)).applyInArrow(merge, "place long, r binary")
        most //= FAN_IN
    solved = triangles.groupBy(F.floor(F.col("place") / FAN_IN)).applyInArrow(solve, "component int, value double, explained double, vector array<double>").collect()
    solved.sort(key=lambda r: r["component"])
    vectors = np.array([r["vector"] for r in solved]).reshape(len(solved), width)
    done = Whitening(n, tuple(sums), tuple(r["value"] for r in solved), tuple(r["explained"] for r in solved), vectors, 0.0)
    return Whitening(done.n, done.sums, done.values, done.explained, vectors, _identity_error(points, done))


def _identity_error(points: DataFrame, by: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity, from sums by partition."""
    k = len(by.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = project(_matrix(batch.column("x"), len(by.sums)), by)
                total, first = total + w.T @ w, first + w.sum(axis=0)
        sums = [*total.ravel().tolist(), *first.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["place", "total"])

    found = dict(points.mapInArrow(products, "place int, total double").groupBy("place").agg(F.sum("total")).collect())  # k * k + k rows
    sums = np.array([found[i] for i in range(k * k + k)]) / by.n
    mean = sums[k * k :]
    return float(np.abs(sums[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def project(x: np.ndarray, by: Whitening) -> np.ndarray:
    """Whitened rows: projections of the centred rows over the square roots of the eigenvalues."""
    return _centred(x, by.n, by.sums) @ by.vectors.T / np.sqrt(by.values)


def _deviations(x: np.ndarray, by: Whitening) -> list[int | None]:
    """The sum of (n * x - S)^2 of each row, exact; None where it needs more than a long."""
    most = max(int(np.abs(x).max(initial=0)) * by.n, max(map(abs, by.sums)))
    if len(by.sums) * (2 * most) ** 2 < 2**63:
        return ((by.n * x - np.array(by.sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((by.n * x.astype(object) - np.array(by.sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row that takes part, by component.

    Components are numbered from 1 by falling eigenvalue; there are as many as the fit list has dimensions with variance, ``components`` at most, so a table
    with fewer than two different vectors gives no rows. All vectors must have one length: those of another than the most common (of equally common
    ones the largest) take no part, nor do those that ``whole_numbers`` leaves out. Repeated rows each get their rows and count once in the fit. ``deviation`` is the exact
    sum over dimensions of (n * x - S)^2, null where that needs more than a long. Directions have either sign, the same for all rows.
    """
    numbers = stage(whole_numbers(vectors, id_col, vector_col), "numbers")
    schema = f"vec_id {dict(numbers.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = numbers.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    rows = numbers.where(F.size("x") == (width[0]["width"] if width else 0))
    by = fit(rows, components)
    if by is None or not by.values:
        return numbers.limit(0).select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", ")[1:])])
    k = len(by.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), len(by.sums))
            m, each = len(x), np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, by.n)),
                 pa.array(_deviations(x, by), pa.int64()).take(pa.array(each)), pa.array(project(x, by).ravel()), pa.array(np.tile(by.explained, m)),
                 pa.array(np.full(m * k, by.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)

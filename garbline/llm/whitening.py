"""Whitening of embeddings through a bidiagonal qd solver.

Entries become whole numbers, so counts and sums over all rows are exact in any order. Every task
reduces its rows, less the mean, to a triangle by QR block by block; triangles meet in groups of
``FAN_IN`` until few are left, so what reaches the driver is a few squares of the dimension, whatever
the number of rows. The last triangle is brought to two diagonals by Householder reflections from
both sides. The differential qd algorithm with shifts (dqds) then finds its singular values,
small ones too, to high relative accuracy, and their squares over the number of rows are the
eigenvalues of the covariance, which is never formed. A component's direction comes from the twisted
factorisation of the shifted product of the bidiagonal with its transpose: the stationary
transform from the top and the progressive one from the bottom meet where the pivot is smallest.
Directions of values that lie close together are made orthogonal to each other in further steps.

Rows whose vector is NULL, empty or holds a NULL, a NaN or an infinity are dropped; so are vectors
of another length than the most frequent one (of equally frequent ones the longest), and entries of
``2**40`` and more, which leave no exact sums. Rows that repeat, and rows without an id, count and
are returned. Components without variance (equal vectors, fewer rows than dimensions) have
``explained`` 0 and NULL in ``whitened``; they do not count in ``identity_error``. A deviation that no
long can hold is NULL. No rows give no rows. Other columns are ignored. Four passes over
the table, one small shuffle of triangles; dimensions are taken to fit one task as a square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.llm.common import table
from garbline.llm.registry import query

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
FAN_IN = 32  # triangles that one task merges
LARGEST = 2.0**40
TINY = np.finfo(float).eps
CLOSE = 1e-3  # relative distance of eigenvalues whose directions are made orthogonal


def whole_vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their vectors as whole numbers (rows by dimensions)."""
    column = batch.column(1).cast(pa.large_list(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy())
    fits = (lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    column = column.filter(pa.array(fits))
    values = column.flatten()
    vectors = values.to_numpy(zero_copy_only=False).reshape(-1, dim)  # NULL becomes NaN
    good = (np.abs(vectors) < LARGEST).all(axis=1)
    fits[np.flatnonzero(fits)[~good]] = False
    return fits, np.floor(SCALE * vectors[good]).astype(np.int64) + OFFSET


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of a QR factorisation, filled up with zeros."""
    dim = rows.shape[1]
    out = np.zeros((dim, dim))
    r = np.linalg.qr(rows, mode="r")
    out[: len(r)] = r
    return out


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and the right reflections' product ``w`` of ``r = u b w.T``."""
    b, n = r.copy(), len(r)
    w = np.eye(n)
    for k in range(n):
        v = mirror(b[k:, k])
        b[k:, k:] -= np.outer(2 * v, v @ b[k:, k:])
        if k + 2 < n:
            v = mirror(b[k, k + 1 :])
            b[k:, k + 1 :] -= np.outer(b[k:, k + 1 :] @ v, 2 * v)
            w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, 2 * v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), w


def mirror(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection turns ``x`` to the first axis (zeros where it lies there)."""
    v = x / (np.abs(x).max() or 1.0)
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    size = np.linalg.norm(v)
    return v / size if size > 0 and np.abs(x[1:]).max(initial=0) > 0 else np.zeros_like(v)


def qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """One differential qd transform with a shift, and whether all quantities stayed positive."""
    n = len(q)
    q_new, e_new, d = np.empty(n), np.empty(max(n - 1, 0)), q[0] - shift
    for i in range(n - 1):
        q_new[i] = d + e[i]
        if d < 0 or not q_new[i] > 0:
            if shift > 0:
                return q, e, False
            q_new[i], e_new[i], d = 0.0, 0.0, q[i + 1]  # a zero value splits the matrix here
            continue
        ratio = q[i + 1] / q_new[i]
        e_new[i], d = e[i] * ratio, d * ratio - shift
    q_new[n - 1] = d
    return q_new, e_new, d >= 0


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (``a`` on, ``b`` above the diagonal), falling."""
    out: list[float] = []
    q, e = a * a, b * b
    scale = max(q.max(initial=0), e.max(initial=0))
    if scale == 0:
        return np.zeros(len(a))
    q, e, moved, guess = q / scale, e / scale, 0.0, 0.0
    blocks = [(q, e, moved)]
    while blocks:
        q, e, moved = blocks.pop()
        guess = 0.0
        while len(q):
            small = np.flatnonzero(e <= TINY * TINY * (q[:-1] + q[1:] + moved)) if len(e) else []
            if len(small):
                cut = int(small[-1])
                if cut < len(q) - 2:
                    blocks.append((q[: cut + 1], e[:cut], moved))
                    q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                    continue
                out.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                guess = 0.0
                continue
            if len(q) == 1:
                out.append(q[0] + moved)
                break
            # the smaller value of the last two rows is a shift that may be too large, never by much
            x, y = q[-2] + e[-1] + (e[-2] if len(e) > 1 else 0.0), q[-1]
            half, off = 0.5 * (x + y), math.sqrt(q[-2] * e[-1]) if len(q) > 1 else 0.0
            low = (x * y - off * off) / (half + math.sqrt(max(0.0, (0.5 * (x - y)) ** 2 + off * off))) if half > 0 else 0.0
            guess, done = max(0.0, min(low, y)) * (1 - 8 * TINY), False
            for share in (1.0, 0.75, 0.25):
                q_new, e_new, done = qd_step(q, e, guess * share)
                if done:
                    moved += guess * share
                    break
            if not done:
                q_new, e_new, _ = qd_step(q, e, 0.0)
            # the transform turns the matrix over in time: keep small values at the end
            if q_new[0] * 1.5 < q_new[-1]:
                q_new, e_new = turned(q_new, e_new)
            q, e = q_new, e_new
    return scale * np.sort(np.maximum(out, 0))[::-1]


def turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The qd array of the same matrix with rows and columns in reverse order."""
    return q[::-1].copy(), e[::-1].copy()


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of ``B.T B`` for one eigenvalue, by a twisted factorisation of ``B.T B - value``."""
    n = len(a)
    q, low = a * a, TINY * max(value, np.finfo(float).tiny)
    # B.T B = L D L.T with pivots q and multipliers b / a
    mult = np.divide(b, a[:-1], out=np.zeros(n - 1), where=a[:-1] != 0)
    top, down, s = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -value
    for i in range(n - 1):  # stationary: from the top
        top[i] = s[i] + q[i]
        top[i] = top[i] if abs(top[i]) > low else math.copysign(low, top[i])
        down[i] = q[i] * mult[i] / top[i]
        s[i + 1] = down[i] * mult[i] * s[i] - value
    top[n - 1] = s[n - 1] + q[n - 1]
    bottom, up, p = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):  # progressive: from the bottom
        bottom[i + 1] = q[i] * mult[i] ** 2 + p[i + 1]
        bottom[i + 1] = bottom[i + 1] if abs(bottom[i + 1]) > low else math.copysign(low, bottom[i + 1])
        up[i] = q[i] * mult[i] / bottom[i + 1]
        p[i] = p[i + 1] * q[i] / bottom[i + 1] - value
    twist = s + p + value
    at = int(np.argmin(np.abs(twist)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def solve_shifted(a: np.ndarray, b: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """A unit solution of ``(B.T B - value) x = right``, with exchanges of rows, for one more step of iteration."""
    n, diagonal, off = len(a), a * a - value, a[:-1] * b
    diagonal[1:] += b * b
    u0, u1, u2, x = diagonal.copy(), np.append(off, 0.0), np.zeros(n), right.copy()
    low = TINY * max(abs(value), np.abs(diagonal).max())
    for i in range(n - 1):
        below0, below1, below2 = off[i], diagonal[i + 1], off[i + 1] if i + 2 < n else 0.0
        if abs(below0) > abs(u0[i]):
            u0[i], below0 = below0, u0[i]
            u1[i], below1 = below1, u1[i]
            u2[i], below2 = below2, u2[i]
            x[i], x[i + 1] = x[i + 1], x[i]
        u0[i] = u0[i] if abs(u0[i]) > low else math.copysign(low, u0[i])
        ratio = below0 / u0[i]
        u0[i + 1], u1[i + 1], x[i + 1] = below1 - ratio * u1[i], below2 - ratio * u2[i], x[i + 1] - ratio * x[i]
    for i in range(n - 1, -1, -1):
        u0[i] = u0[i] if abs(u0[i]) > low else math.copysign(low, u0[i])
        x[i] = (x[i] - (u1[i] * x[i + 1] if i + 1 < n else 0) - (u2[i] * x[i + 2] if i + 2 < n else 0)) / u0[i]
    return x / np.linalg.norm(x)


def components(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling squares of the singular values of ``r``, and the right directions of the first ``most`` that are not zero."""
    a, b, w = bidiagonal(r)
    values = dqds(a, b)
    most = min(most, int((values > (len(a) * TINY) ** 2 * values.max(initial=0)).sum()))
    scale, vectors, first = math.sqrt(values[0]) if len(values) and values[0] > 0 else 1.0, [], 0
    a, b = a / scale, b / scale
    for i in range(most):
        value = values[i] / scale**2
        z = twisted(a, b, value)
        if i and values[i - 1] - values[i] > CLOSE * values[i - 1]:
            first = i
        for turn in range(3 if first < i else 0):
            for other in vectors[first:]:
                z = z - (other @ z) * other
            if np.linalg.norm(z) < 0.1:  # the twist found a direction that is taken
                z = np.cos(np.arange(1, len(a) + 1) * (i + 1.0 + turn))
                for other in vectors[first:]:
                    z = z - (other @ z) * other
            z = solve_shifted(a, b, value, z / np.linalg.norm(z))
        for _ in range(2 if first < i else 0):
            for other in vectors[first:]:
                z = z - (other @ z) * other
            z = z / np.linalg.norm(z)
        vectors.append(z)
    return values, w @ np.array(vectors).T if vectors else np.zeros((len(a), 0))


def dimension(embeddings: DataFrame) -> int:
    """The most frequent length of vectors, 0 if there is none."""
    sizes = embeddings.where("size(v) > 0").groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).head(1)
    return most[0]["n"] if most else 0


def totals(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number and exact sums of the vectors that count; one row for each task reaches the final sum."""

    def run(batches):
        n, sums = 0, np.zeros(dim, object)
        for batch in batches:
            _, x = whole_vectors(batch, dim)
            n, sums = n + len(x), sums + x.sum(axis=0).astype(object)  # a batch is far below 2**12 rows of 2**50
        yield pa.RecordBatch.from_arrays([pa.array([n] * dim, pa.int64()), pa.array(range(dim), pa.int32()), pa.array([str(s) for s in sums])], names=["n", "at", "s"])

    told = vectors.mapInArrow(run, "n long, at int, s string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = sorted(told.collect(), key=lambda row: row["at"])
    return (rows[0]["n"], [int(row["s"]) for row in rows]) if rows else (0, [0] * dim)


def one_triangle(vectors: DataFrame, dim: int, mean: np.ndarray) -> np.ndarray:
    """The triangle of all vectors less ``mean``, merged in groups of ``FAN_IN`` tasks."""

    def of_rows(batches):
        r, some = np.zeros((dim, dim)), False
        for batch in batches:
            _, x = whole_vectors(batch, dim)
            if len(x):
                r, some = triangle(np.vstack([r, x - mean])), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def of_triangles(batches):
        r, some = np.zeros((dim, dim)), False
        for batch in batches:
            for one in batch.column(0):
                r, some = triangle(np.vstack([r, np.frombuffer(one.as_py()).reshape(dim, dim)])), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    found, tasks = vectors.mapInArrow(of_rows, "r binary"), vectors.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        found = found.repartition(tasks).mapInArrow(of_triangles, "r binary")
    r = np.zeros((dim, dim))
    for row in found.toLocalIterator():
        r = triangle(np.vstack([r, np.frombuffer(bytes(row["r"])).reshape(dim, dim)]))
    return r


def whitened_covariance(vectors: DataFrame, dim: int, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Covariance of the whitened vectors, from each task's centred products."""
    k = turn.shape[1]

    def run(batches):
        n, middle, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = whole_vectors(batch, dim)
            if len(x):
                y = (x - mean) @ turn
                n, middle, products = joined((n, middle, products), (len(y), y.mean(axis=0), (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([middle.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], names=["n", "middle", "products"])

    def joined(one, two):
        (n, a, p), (m, b, q) = one, two
        return n + m, a + (b - a) * (m / (n + m)), p + q + np.outer(b - a, b - a) * (n * m / (n + m))

    # a task's figures are k * k numbers; they come one task at a time
    whole = (0, np.zeros(k), np.zeros((k, k)))
    for row in vectors.mapInArrow(run, "n long, middle binary, products binary").toLocalIterator():
        whole = joined(whole, (row["n"], np.frombuffer(bytes(row["middle"])), np.frombuffer(bytes(row["products"])).reshape(k, k)))
    return whole[2] / max(whole[0], 1)


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Rows (``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``) for ``embeddings`` (vec_id, embedding)."""
    vectors = embeddings.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    shape = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = dimension(vectors)
    n, sums = totals(vectors, dim) if dim else (0, [])
    if not n:
        return embeddings.sparkSession.createDataFrame([], shape)
    mean = np.array([s / n for s in sums])  # quotients of whole numbers, rounded once
    r = one_triangle(vectors, dim, mean)
    values, directions = components(r, most)
    trace = float((r * r).sum())
    real, count = directions.shape[1], min(most, dim)
    turn = directions / np.sqrt(values[:real] / n)
    error = float(np.abs(whitened_covariance(vectors, dim, mean, turn) - np.eye(turn.shape[1])).max()) if real else 0.0
    explained = [float(v / trace) for v in values[:real]] + [0.0] * (count - real)
    exact = np.array(sums, object)

    def run(batches):
        for batch in batches:
            fits, x = whole_vectors(batch, dim)
            ids, rows = batch.column(0).filter(pa.array(fits)), len(x)
            if not rows:
                continue
            white = (x - mean) @ turn
            most_off = n * int(np.abs(x).max()) + int(max(abs(s) for s in sums))
            if dim * most_off**2 < 1 << 63:
                off = n * x - np.array(sums, np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = n * x.astype(object) - exact
                deviation = [d if d < 1 << 63 else None for d in (off * off).sum(axis=1)]
            again = np.repeat(np.arange(rows), count)
            shown = np.full((rows, count), np.nan)
            shown[:, :real] = white
            hidden = np.tile(np.arange(count) >= real, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(again)),
                    pa.array(shown.ravel(), mask=hidden),
                    pa.array(np.tile(np.array(explained), rows)),
                    pa.array(np.full(rows * count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, shape)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))

"""The qd solver against a library's singular values, and the query against exact arithmetic."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from garbline.llm import registry
from garbline.llm.whitening import COMPONENTS, components, dqds, triangle, whiten

RNG = np.random.default_rng(12)


def squares(kind, n):
    if kind == "plain":
        return np.triu(RNG.normal(size=(n, n)))
    if kind == "graded":
        return np.triu(RNG.normal(size=(n, n))) * np.logspace(0, -12, n)
    if kind == "few rows":
        return triangle(RNG.normal(size=(max(n // 2, 1), n)))
    if kind == "equal values":
        return np.eye(n) * 3
    if kind == "whole diagonal":
        return np.diag(RNG.integers(0, 3, n).astype(float))
    if kind == "clusters":
        turn = np.linalg.qr(RNG.normal(size=(n, n)))[0]
        return triangle(turn * np.repeat([5.0, 5.0 + 1e-9, 1.0], (n + 2) // 3)[:n] @ np.linalg.qr(RNG.normal(size=(n, n)))[0])
    return np.zeros((n, n))


@pytest.mark.parametrize("kind", ["plain", "graded", "few rows", "equal values", "whole diagonal", "clusters", "zero"])
def test_solver(kind):
    for n in [1, 2, 3, 5, 8, 21, 64]:
        r = squares(kind, n)
        values, turn = components(r, 8)
        want = np.linalg.svd(r, compute_uv=False) ** 2
        top = want[0] or 1.0
        assert np.abs(values - want).max() <= 1e-13 * top
        assert np.abs(r.T @ (r @ turn) - turn * values[: turn.shape[1]]).max(initial=0) <= 1e-12 * top
        assert np.abs(turn.T @ turn - np.eye(turn.shape[1])).max(initial=0) <= 1e-11
        assert turn.shape[1] == min(8, int((want > (n * 2.3e-16) ** 2 * top).sum()))


def test_small_values_are_relatively_right():
    """A graded bidiagonal, whose small singular values a covariance would lose."""
    a, b = 10.0 ** -np.arange(12), 10.0 ** -np.arange(11) * 0.3
    on, above = [Fraction(float(x)) for x in a], [Fraction(float(x)) for x in b]
    diagonal = [on[i] ** 2 + (above[i - 1] ** 2 if i else 0) for i in range(12)]

    def below(bound):
        """Eigenvalues of the product under a bound: signs of exact pivots."""
        pivot, count = diagonal[0] - bound, 0
        for i in range(12):
            count += pivot < 0
            if i < 11:
                pivot = diagonal[i + 1] - bound - (on[i] * above[i]) ** 2 / pivot
        return count

    for place, value in enumerate(dqds(a, b)):
        low, high = (Fraction(float(value)) * (1 + Fraction(sign, 10**12)) for sign in (-1, 1))
        assert (below(low), below(high)) == (11 - place, 12 - place)


def exact(rows):
    """Rows that count as whole numbers, their sums, and deviations, with rational numbers."""
    kept = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, dim = len(kept), len(kept[0][1]) if kept else 0
    sums = [sum(x[d] for _, x in kept) for d in range(dim)]
    return kept, n, sums, [sum((n * x[d] - sums[d]) ** 2 for d in range(dim)) for _, x in kept]


def check(got, rows):
    kept, n, sums, deviations = exact(rows)
    if not kept:
        assert got == []
        return
    dim = len(sums)
    count = min(COMPONENTS, dim)
    assert len(got) == len(kept) * count and sorted((r["vec_id"] is None, r["vec_id"], r["component"]) for r in got if r["vec_id"] is not None) == sorted(
        (False, i, k + 1) for i, _ in kept for k in range(count) if i is not None
    )
    assert {r["n"] for r in got} <= {n}
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for _, x in kept])
    v = y.T @ y / n
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    by_id = {i: (d, y[k]) for k, ((i, _), d) in enumerate(zip(kept, deviations))}
    for r in got:
        d, own = by_id[r["vec_id"]]
        assert r["deviation"] == (d if d < 1 << 63 else None)
        if r["explained"]:
            assert abs(r["explained"] - want[r["component"] - 1] / np.trace(v)) <= 1e-4 * r["explained"]
            assert r["whitened"] is not None and r["identity_error"] <= 1e-4
        else:
            assert r["whitened"] is None
    for k in range(count):
        w = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        if None not in w.values():
            side = np.array([w[i] for i, _ in kept])
            direction = y.T @ side / n / np.sqrt(want[k])  # the unit eigenvector, if it is one
            assert abs(np.linalg.norm(direction) - 1) < 1e-6 and np.abs(v @ direction - want[k] * direction).max() < 1e-6 * want[0]


def test_query(spark, small_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    check(registry.queries()["op12_embedding_whitening"](spark, small_dir).collect(), rows)


NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [0.5, -1.25, 3.0]), (2, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [NAN, 0.0, 0.0]), (7, [INF, 1.0, 1.0]),
    (8, [-0.75, 0.0, 1000.5]), (9, [1.0, 2.0]), (10, [1e300, 0.0, 0.0]), (11, [2.0**12, 1.0, 0.0]), (None, [3.0, 1.0, 2.0]),
]


@pytest.mark.parametrize("double", [True, False])
def test_odd_vectors(spark, tmp_path, double):
    kind = pa.float64() if double else pa.float32()
    odd = ODD if double else [(i, [c if c is None or abs(c) < 1e30 else NAN for c in v] if v else v) for i, v in ODD]
    names = ["vec_id", "embedding", "n", "component"]
    table = pa.table([pa.array([i for i, _ in odd], pa.int64()), pa.array([v for _, v in odd], pa.list_(kind)), pa.array(["x"] * len(odd)), pa.array([None] * len(odd), pa.int32())], names=names)
    pq.write_table(table, tmp_path / "embeddings.parquet")
    used = [(i, [NAN] if v and (len(v) != 3 or any(c is not None and 1e299 < abs(c) < INF for c in v)) else v) for i, v in odd]
    if not double:
        used = [(i, [float(np.float32(c)) if c is not None else None for c in v] if v else v) for i, v in used]
    check(registry.queries()["op12_embedding_whitening"](spark, str(tmp_path)).collect(), used)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0])], [(i, [1.0, 1.0, 1.0]) for i in range(5)], [(i, [float(i), -2.0 * i]) for i in range(9)]])
def test_few_and_equal_vectors(spark, rows):
    check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), rows)


def test_deviation_beyond_a_long(spark):
    rows = [(1, [2.0**30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    assert got == {i: d if d < 1 << 63 else None for (i, _), d in zip(rows, exact(rows)[3])} and None in got.values()

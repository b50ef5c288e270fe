"""Whitening against NumPy and exact arithmetic, and its edge cases."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from playledger.llm import whitening
from playledger.llm.queries import op12_whitening

X = "vec_id BIGINT, x ARRAY<BIGINT>, width STRING, n STRING"


def spread(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 50, 40), 2.0 ** np.arange(24), [5, 5, 5, 2, 1, 1, 0.5], 1 + 1e-9 * np.arange(20),
    [7, 7 - 1e-10, 7 - 2e-10, 3, 3, 1e-3, 1e-6, 0], [0, 0, 0], [4],
])
def test_eigenvectors_to_double_precision(values):
    a = spread(values, 1)
    found, x = whitening.eigenvectors(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.all(np.diff(found) <= 0) and np.allclose(found, sorted(values, reverse=True), atol=1e-13 * size, rtol=1e-13)
    long = x.astype(np.longdouble)
    assert np.abs(long.T @ long - np.eye(len(a))).max() < 4e-16
    assert np.abs(a.astype(np.longdouble) @ long - long * found).max() < 1e-15 * size * len(a)


def test_float32_alone_would_not_do():
    a = spread(np.linspace(1, 2, 60), 3)
    found, x = whitening.eigenvectors(a)
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert np.abs(np.abs((x * rough).sum(axis=0)) - 1).max() > 1e-10
    better = np.linalg.eigh(a)[1][:, ::-1]
    assert np.abs(np.abs((x * better).sum(axis=0)) - 1).max() < 1e-13


def check(got, vectors, components):
    """Rows against exact sums and NumPy. `vectors`: (vec_id, list) in any order, distinct ids."""
    rows = defaultdict(dict)
    for r in got:
        assert r.component not in rows[r.vec_id]
        rows[r.vec_id][r.component] = r
    assert set(rows) == {i for i, x in vectors if x}
    x = [v for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    centred = np.array([[float(Fraction(n * v[j] - sums[j], n)) for j in range(d)] for v in x])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, d)
    white = np.array([[rows[i][c].whitened for c in range(1, k + 1)] for i, _ in vectors], dtype=float)
    for i, v in vectors:
        for r in rows[i].values():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9)
            assert r.identity_error < 1e-9
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9
    # Back from components: the directions are eigenvectors.
    back = (centred.T @ white / n)
    assert np.allclose(cov @ back, back * values[:k], rtol=0, atol=1e-9 * values[0] ** 1.5)


def test_equals_exact_arithmetic(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 13)
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(300, 9)) @ np.diag(np.arange(1, 10)) * 40).astype(int) + 1_000_000
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(*v, "w", "n") for v in vectors], X).repartition(6)
    check(whitening.whiten(frame, 5).collect(), vectors, 5)
    check(whitening.whiten(frame, 32).collect(), vectors, 32)


def test_lengths_nulls_repeats_and_no_variance(spark):
    vectors = [(1, [1, 2]), (1, [1, 2]), (2, [3, 5]), (None, [9, 4]), (3, None), (4, []), (5, [7]), (6, [7]),
               (7, [1, 1, 1]), (8, [2, 2, 2])]
    got = whitening.whiten(spark.createDataFrame([(*v, "w", "n") for v in vectors], X)).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert len(by_id[1]) == 4 and len(by_id[None]) == 2 and 3 not in by_id and 4 not in by_id
    assert [(r.whitened, r.explained, r.deviation, r.n) for r in by_id[5]] == [(None, 0.0, 0, 2)]
    assert sorted((r.component, r.whitened is None) for r in by_id[7]) == [(1, False), (2, True), (3, True)]
    assert all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(spark.createDataFrame([], X)).collect() == []


def test_large_numbers_stay_exact(spark):
    top = 2 ** 51
    vectors = [(i, [top - i * 3, -top + i * i, 5]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame([(*v, "w", "n") for v in vectors], X)).collect()
    sums = [sum(v[j] for _, v in vectors) for j in range(3)]
    for r in got:
        assert r.deviation == sum((50 * a - s) ** 2 for a, s in zip(vectors[r.vec_id][1], sums))
    far = [(0, [top]), (1, [-top])]
    got = whitening.whiten(spark.createDataFrame([(*v, "w", "n") for v in far], X)).collect()
    assert [r.deviation for r in got] == [None, None] and {round(r.whitened, 12) for r in got} == {1.0, -1.0}


def test_fixed_point(spark):
    frame = spark.createDataFrame(
        [([0.5, -0.51, 1.0],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],), ([3e38],)],
        "e ARRAY<FLOAT>")
    got = [r.x for r in frame.select(whitening.fixed_point("e", 64, 100).alias("x")).collect()]
    assert got == [[132, 67, 164], None, None, None, None, [], None]


def test_query(spark):
    rows = op12_whitening(spark, "/root/testdata/sf0.001").collect()
    vectors = [(r.vec_id, [math.floor(64 * float(c)) + 1_000_000 for c in r.embedding])
               for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(rows, vectors, 32)

"""Whitened embeddings against numpy on all rows, and the exact integers against Python's."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import whiten


def want(vectors, k):
    """(x, eigenvalues, components, trace) from numpy alone."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    mean = np.array([sum(col) / len(x) for col in x.T])
    c = x.astype(np.float64) - mean
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    return x, e[::-1][:k], u[:, ::-1][:, :k], np.trace(v)


def compared(spark, vectors, k, extra=(), **fit):
    rows = [(i, [float(np.float32(c)) for c in v], "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>, whitened string").withColumn("vec", F.lit(3)).repartition(3)
    got = {r.vec_id: r for r in whiten.with_whitened(df, k, **fit).collect()}
    x, e, u, trace = want(vectors, k)
    n, sums = len(x), [sum(col) for col in x.T]
    assert set(got) == set(range(n))
    z = np.array([got[i].whitened for i in range(n)])
    reference = (x.astype(np.float64) - np.array([s / n for s in sums])) @ u / np.sqrt(e)
    signs = np.sign((z * reference).sum(0))
    assert np.abs(z - reference * signs).max() < 1e-6
    assert np.allclose(got[0].explained, e / trace, rtol=1e-9)
    assert got[0].identity_error < 1e-9 and {r.identity_error for r in got.values()} == {got[0].identity_error}
    for i in range(n):
        exact = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert got[i].n == n and got[i].deviation == (exact if exact < 1 << 63 else None)
    return df


def test_flat_spectrum_takes_all_dimensions(spark):
    rng = np.random.default_rng(1)
    bad = [(-1, None, "x"), (-2, [1.0] * 15 + [None], "x"), (-3, [float("nan")] + [0.0] * 15, "x"), (-4, [float("inf")] + [0.0] * 15, "x")]
    vectors = list(rng.standard_normal((700, 16)))
    vectors += [vectors[5]] * 200
    df = compared(spark, vectors, 6, bad, oversample=2)
    model = whiten.fit_whitening(whiten.usable(df), 16, 6, oversample=2)
    assert model.full and model.passes == 4


def test_falling_spectrum_needs_no_more_than_the_range(spark):
    rng = np.random.default_rng(2)
    vectors = list(rng.standard_normal((600, 30)) * 6.0 ** -np.arange(30).clip(0, 12)[None, :] * 1e9)
    df = compared(spark, vectors, 3, oversample=3, passes=4)
    model = whiten.fit_whitening(whiten.usable(df), 30, 3, oversample=3, passes=4)
    assert not model.full and model.passes <= 4


def test_same_on_any_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((300, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = ({r.vec_id: r for r in whiten.with_whitened(df.repartition(p), 8).collect()} for p in (1, 7))
    assert all(np.allclose(a[i].whitened, b[i].whitened, atol=1e-9) and a[i].deviation == b[i].deviation for i in a)


def test_deviation_beyond_64_bits(spark):
    model = whiten.Whitening(2, 3, [3 << 40, 0], np.ones(1), np.ones((2, 1)), 1.0, 1, True)
    x = np.array([[1 << 55, 7], [5, -9], [1 << 40, 0]], np.int64)
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for r in x]
    assert model.deviation(x) == [None if v >= 1 << 63 else v for v in exact] and None in model.deviation(x)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [float("nan")])]])
def test_nothing_to_fit(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whiten.with_whitened(df).count() == 0


def test_lengths_ties_and_empty_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [5.0, 5.0]), (4, [1.0]), (5, [3.0]), (6, []), (None, [0.0, 0.0])]
    got = {r.vec_id: r for r in whiten.with_whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 7 and len(got[1].whitened) == 2 and got[1].n == 4 and len(got[4].whitened) == 1 and got[4].n == 2 and got[6].whitened == []
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [(r.whitened, r.deviation) for r in whiten.with_whitened(alike).collect()] == [([], 0)] * 5

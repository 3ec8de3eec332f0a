"""Whitening against numpy's symmetric eigensolver and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import whitening as W
from fleetgauge.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, component string, n int, x string"


def brute(x):
    """Eigenvalues and vectors of the covariance, and the exact deviations, of a matrix of whole numbers."""
    n, sums = len(x), [sum(int(v) for v in c) for c in x.T]
    y = np.array([[(n * int(v) - s) / n for v, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return values[::-1], vectors[:, ::-1], y, [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def agrees(rows, ids, x, most=8):
    values, vectors, y, deviations = brute(x)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(ids) * most == len(got)
    for c in range(most):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        want = y @ vectors[:, c] / math.sqrt(values[c])
        assert np.abs(mine - want * np.sign(mine @ want)).max() < 1e-6
        assert np.allclose([got[i, c + 1].explained for i in ids], values[c] / values.sum(), rtol=1e-9)
    assert [got[i, 1].deviation for i in ids] == deviations
    assert {r.n for r in rows} == {len(x)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_over_the_table(spark, sf):
    data = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in r.embedding] for r in data])
    agrees(QUERIES["op11_embedding_whitening"](spark, f"/root/testdata/{sf}").collect(), [r.vec_id for r in data], x)


@pytest.mark.parametrize("parts", [1, 5])
def test_a_third_are_one_vector(spark, parts):
    rng = np.random.default_rng(parts)
    x = rng.integers(-500, 500, (300, 12)) * np.arange(1, 13) + 10**12
    x[:100] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<long>").repartition(parts)
    agrees(W.whiten(df, 5).collect(), list(range(300)), x, 5)


def test_factor_and_rotation():
    rng = np.random.default_rng(2)
    for size, rank in ((1, 1), (7, 7), (20, 6), (33, 33), (5, 0)):
        a = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-1, 2, rank)
        a = a @ a.T
        factor, order = W.pivoted_cholesky(a)
        assert factor.shape == (size, rank) and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12 * max(1, np.abs(a).max(initial=0)))
        assert np.allclose(np.triu(factor, 1), 0)
        values, vectors = W.components(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-12 * np.abs(a).max(initial=0)) and (np.diff(values) <= 0).all()
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-10)


def test_equal_eigenvalues():
    values, vectors = W.components(np.eye(9) * 4)
    assert np.allclose(values, 4) and np.allclose(vectors.T @ vectors, np.eye(9))


def test_what_is_left_out(spark):
    rows = [(i, [0.1 * i, float(i % 3), 1.5], "c", 0, "y") for i in range(20)]
    bad = [(100, None), (101, [None, 1.0, 2.0]), (102, [math.nan, 1.0, 2.0]), (103, [math.inf, 0.0, 0.0]), (104, [1.0]), (105, []), (106, [1e30, 0.0, 0.0])]
    rows += [(i, v, "c", 0, "y") for i, v in bad] + [(None, [0.5, 1.0, 1.5], "c", 0, "y"), (3, [0.3, 0.0, 1.5], "c", 0, "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", W.whole_numbers("embedding"))
    out = W.whiten(df).collect()
    # The last entry never varies, so there are two components.
    assert len(out) == 2 * 22 and {r.n for r in out} == {22} and {r.component for r in out} == {1, 2}
    assert not {r.vec_id for r in out} & {i for i, _ in bad} and sum(r.vec_id == 3 for r in out) == 4 and sum(r.vec_id is None for r in out) == 2
    for none in (df.limit(0), df.filter("vec_id = 5"), df.filter("vec_id = 105")):
        assert W.whiten(none).count() == 0 and W.whiten(none).columns == W.whiten(df).columns


def test_exact_beyond_a_long(spark):
    x = np.array([[0, 1], [2**41, 5], [-(2**41), 7]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<long>")
    out = W.whiten(df).filter("component = 1").orderBy("vec_id").collect()
    want = brute(x)[3]
    assert [r.deviation_text for r in out] == list(map(str, want))
    assert [r.deviation for r in out] == [w if w < 2**63 else None for w in want] and out[1].deviation is None


def test_whole_numbers_are_floors(spark):
    df = spark.createDataFrame([([0.1, -0.1, 0.0, -1e-7],)], "v array<float>").select(W.whole_numbers(F.col("v")).alias("x"))
    assert df.first().x == [100_102, 99_897, 100_000, 99_999]

"""Whitening against exact arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from habitloom.llm import whitening
from habitloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 5, 300, 2 ** 40, 2 ** 52])
@pytest.mark.parametrize("rows", [1, 63, 200])
def test_bit_planes_give_exact_products(size, rows):
    matrix = np.random.default_rng(size % 7 + rows).integers(-size, size, (rows, 7))
    product, total = whitening.cross_products(matrix)
    exact = matrix.astype(object)
    assert (product == exact.T @ exact).all() and (total == exact.sum(axis=0)).all()


def test_query_equals_exact_arithmetic(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r.embedding for r in table], float)).astype(int).astype(object) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    covariance = np.array([[float(Fraction(int(c), n ** 3)) for c in row] for row in apart.T @ apart])
    values, axes = np.linalg.eigh(covariance)
    found = QUERIES["op11_bit_sliced_scatter"](spark, SF_DIR).collect()
    assert len(found) == 32 * n and {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, 33))
    deviation = dict(zip((r.vec_id for r in table), (apart ** 2).sum(axis=1)))
    assert all(r.deviation == deviation[r.vec_id] for r in found)
    place = {r.vec_id: i for i, r in enumerate(table)}
    whitened = np.zeros((n, 32))
    for r in found:
        whitened[place[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained / (values[-r.component] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(np.cov(whitened.T, bias=True) - np.eye(32)).max() < 1e-9
    expected = (apart / n).astype(float) @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.abs(np.abs(whitened) - np.abs(expected)).max() < 1e-6


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (None, [3.0, 5.0]), (4, [float("inf"), 1.0]), (5, []), (6, [2.0, 2.0]), (7, [5.0]), (8, [float("nan"), 0.0])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS n", "'y' AS component")
    found = whitening.whiten(docs.repartition(3), 32).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in found) == sorted(
        [("1", c, 4) for c in (1, 2, 1, 2)] + [("None", c, 4) for c in (1, 2)] + [("6", c, 4) for c in (1, 2)] + [("7", 1, 1)])
    alone = next(r for r in found if r.vec_id == 7)
    assert alone.whitened is None and alone.explained == 0 and alone.deviation == 0 and alone.identity_error == 0
    assert whitening.whiten(docs.where("false"), 32).collect() == []
    # Beyond 64 bits, and entries too large for a whole number.
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 5.0])], "vec_id bigint, embedding array<double>")
    found = whitening.whiten(huge, 1).collect()
    # The two great entries cancel, so the third row's own sum is 128 ** 2 + 576 ** 2.
    assert {r.vec_id: r.deviation for r in found} == {1: None, 2: None, 3: 348160} and all(r.identity_error < 1e-4 for r in found)

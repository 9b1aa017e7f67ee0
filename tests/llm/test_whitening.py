"""op13: moments, the eigen-solve and whole results against exact or library arithmetic."""

import math

import numpy as np
import pytest

from flowtide.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n=150, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ np.diag(np.linspace(3, 0.2, dims)) @ rng.normal(size=(dims, dims))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(mixed)]


def odd():
    good = vectors()
    bad = [(900, None), (901, [1.0] * 11), (902, [None] + [0.0] * 11), (903, [math.nan] * 12), (904, [math.inf] + [0.0] * 11), (905, []), (906, [1e30] * 12)]
    return good + bad + [good[0], (None, good[5][1])]


def whole(rows, dims=12):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 2**30 for c in v)]
    return [i for i, _ in kept], [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]


def test_query_against_exact_arithmetic(spark, tmp_path):
    spark.createDataFrame(odd(), SCHEMA).selectExpr("*", "1 AS n", "2 AS row", "3 AS vector").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_embedding_whitening(spark, str(tmp_path)).collect()
    ids, x = whole(odd())
    n, dims = len(x), 12
    sums = [sum(col) for col in zip(*x)]
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    deviation = {(i, sum((n * v - s) ** 2 for v, s in zip(row, sums))) for i, row in zip(ids, x)}
    assert {(r.vec_id, r.deviation) for r in got} == deviation
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    wanted = centred @ axes / np.sqrt(values)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(centred.T @ centred / n), rel=1e-9)
    for c in range(8):
        mine = np.array([by_id[i][c + 1] for i in ids])
        sign = np.sign(mine @ wanted[:, c])
        assert np.allclose(mine * sign, wanted[:, c], atol=1e-8)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_symmetric_qr_equals_the_library():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 8, 64):
        a = rng.normal(size=(d, d))
        a = a @ a.T
        values, vectors_ = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * np.trace(a))
        assert np.allclose(a @ vectors_, vectors_ * values, atol=1e-11 * np.trace(a)) and np.allclose(vectors_.T @ vectors_, np.eye(d), atol=1e-13)
    values, vectors_ = whitening.symmetric_qr(np.diag([2.0, 5.0, 2.0, 0.0]))
    assert values.tolist() == [5.0, 2.0, 2.0, 0.0] and np.allclose(vectors_.T @ vectors_, np.eye(4))


def test_merged_moments_equal_one_pass():
    x = np.random.default_rng(2).normal(size=(300, 5)) + 1e5
    parts = []
    for chunk in (x[:1], x[1:90], x[90:90], x[90:]):
        parts.append(whitening.Moments.zero(5))
        parts[-1].add(chunk)
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(p)
    assert total.n == 300 and np.allclose(total.covariance, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-12)


def test_little_or_no_variation(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], SCHEMA)).collect()
    assert len(line) == 27 and all((r.whitened is None) == (r.component > 1) for r in line)
    assert line[0].explained == pytest.approx(1.0) and line[0].identity_error < 1e-9


def test_deviations_beyond_int64():
    moments = whitening.Moments(3, [0, 0], np.zeros(2), np.eye(2))
    model = whitening.Whitening(2, moments, np.ones(2), np.eye(2), 2.0)
    x = np.array([[1 << 40, 5], [7, 1]])
    assert model.deviations(x) == [None, 9 * 50]
    moments.n = 1 << 40
    assert model.deviations(np.array([[1 << 40, 1]])) == [None]

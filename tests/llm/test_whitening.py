"""Jacobi-Davidson and the whitened vectors against dense linear algebra."""

import math

import numpy as np
import pytest

from lookalike.llm import whitening


@pytest.mark.parametrize("kind", ["gaps", "flat", "ties", "rank", "zero", "large"])
def test_eigenvectors_to_double_precision(kind):
    r = np.random.default_rng(2)
    d = 400 if kind == "large" else 60
    spectrum = {
        "gaps": 2.0 ** -np.arange(d),
        "flat": 1 + r.random(d) / 5,
        "ties": np.r_[[5.0] * 12, [1.0] * (d - 12)],
        "rank": np.r_[[3.0, 2.0, 1.0], np.zeros(d - 3)],
        "zero": np.zeros(d),
        "large": np.r_[20 + r.random(6), r.random(d - 6) * 19],
    }[kind]
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    passes = []
    values, vectors = whitening.leading_eigenvectors(lambda m: passes.append(m.shape[1]) or a @ m, d, 8)
    assert np.allclose(values, np.sort(spectrum)[::-1][:8], atol=1e-12 * max(1, spectrum.max()))
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * max(spectrum.max(), 1e-300)
    # never the whole operator at once
    assert max(passes) <= 12


def test_corrections_shorten_the_search():
    """Plain power iteration with as many passes is far from double precision."""
    r = np.random.default_rng(4)
    d = 300
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    a = (q * np.r_[10 + np.arange(8) / 50, r.random(d - 8) * 9.9]) @ q.T
    passes = []
    whitening.leading_eigenvectors(lambda m: passes.append(0) or a @ m, d, 8)
    x = r.standard_normal((d, 12))
    for _ in passes:
        x = np.linalg.qr(a @ x)[0]
    first = x[:, :1]
    assert np.linalg.norm(a @ first - first * (first.T @ a @ first)) > 1e-6


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS deviation", "'x' AS ids")


def rows_of(count=400, d=24, seed=0):
    r = np.random.default_rng(seed)
    m = r.standard_normal((count, d)) @ np.diag(np.linspace(1, 3, d)) * 0.2 + r.standard_normal(d)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(m)]
    rows += [(7, rows[7][1]), (None, rows[8][1])] + [(10_000 + i, rows[9][1]) for i in range(200)]
    return rows + [(900, None), (901, [float("nan")] * d), (902, [None] * d), (903, [float("inf")] * d), (904, [1e30] * d), (905, [0.5] * (d - 3)), (906, [])]


def taking_part(rows, d):
    for key, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) and abs(np.float32(c)) < 1e12 for c in v):
            yield key, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (d - len(v))


def test_query_against_dense_algebra(spark):
    rows, d = rows_of(), 24
    given = list(taking_part(rows, d))
    x = np.array([v for _, v in given])
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    cov = c.T @ c / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    got = whitening.report(frame(spark, rows).repartition(4)).collect()
    assert len(got) == 8 * n
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = np.sort(np.abs(c @ basis / np.sqrt(values)), axis=0)
    for k in range(8):
        own = [r for r in got if r.component == k + 1]
        assert abs(own[0].explained - values[k] / np.trace(cov)) < 1e-12
        assert np.allclose(np.sort([abs(r.whitened) for r in own]), want[:, k], atol=1e-6)
    dev = sorted((str(k), int(((n * np.array(v, object) - s.astype(object)) ** 2).sum())) for k, v in given)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == dev


def test_sums_in_groups_are_the_same(spark, monkeypatch):
    df = frame(spark, rows_of(seed=3)).repartition(9)
    alone = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.report(df).collect()}
    monkeypatch.setattr(whitening, "FAN", 0)
    grouped = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.report(df).collect()}
    assert alone.keys() == grouped.keys() and all(abs(alone[k] - grouped[k]) < 1e-6 for k in alone)


def test_few_vectors(spark):
    one = [(1, [1.0, 2.0])]
    assert whitening.report(frame(spark, one)).count() == 0
    assert whitening.whiten(frame(spark, one)).select("whitened", "deviation", "n").collect() == [([], 0, 1)]
    assert whitening.report(frame(spark, [])).count() == 0 and whitening.report(frame(spark, [(1, [])])).count() == 0
    two = whitening.report(frame(spark, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [
        (1, 1, 2 * 1024**2, 1.0, 1.0), (2, 1, 2 * 1024**2, 1.0, 1.0)
    ]


def test_deviation_beyond_a_long():
    x = np.array([[1 << 50, 0], [0, 1 << 50]])
    got = whitening._deviation(x, 2, np.array([1 << 50, 1 << 50], object))
    assert got.tolist() == [2 << 100, 2 << 100]
    assert whitening._deviation(np.array([[5], [7]]), 2, np.array([12], object)).tolist() == [4, 4]

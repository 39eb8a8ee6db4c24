import math

import numpy as np
import pytest
from numpy.polynomial import chebyshev as cheb

from gridlake.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def frame(spark, rows, schema=SCHEMA, parts=5):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], schema).repartition(parts)


def plain(rows, width):
    """Integer vectors of the rows that count, the fit list's exact sums and its covariance."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in good]
    fit = np.array(sorted({v for _, v in x}), float).reshape(-1, width)
    centred = fit - fit.mean(axis=0)
    return x, fit, centred.T @ centred / max(len(fit), 1)


def embeddings(rng, count, width, spread):
    made = rng.standard_normal((count, width)) * spread * 0.1
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(made)]


ODD = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [0.5, 0.5]), (905, []), (None, [0.25] * 12), (7, [-0.0] * 12)]


@pytest.mark.parametrize("width, spread", [(12, 1.0), (40, np.linspace(3, 1, 40)), (60, np.r_[9, 8, np.ones(58)])])
def test_against_an_eigendecomposition(spark, width, spread):
    rng = np.random.default_rng(width)
    rows = embeddings(rng, 700, width, spread)
    rows += [(1000 + k, rows[3][1]) for k in range(300)] + [rows[5]] + (ODD if width == 12 else [])
    x, fit, v = plain(rows, width)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = wh.whiten(frame(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert len(found) == 4 * len(x)
    assert {r.n for r in found} == {len(fit)}
    assert max(r.identity_error for r in found) < 1e-10 and len({r.identity_error for r in found}) == 1
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    wanted, signs = {}, {}
    for i, vector in x:
        white = (np.array(vector, float) - fit.mean(axis=0)) @ vectors[:, :4] / np.sqrt(values[:4])
        deviation = sum((n * a - s) ** 2 for a, s in zip(vector, sums))
        wanted.setdefault((i, deviation), white)
    for r in found:
        k = r.component - 1
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-10
        white = wanted[r.vec_id, r.deviation][k]
        if abs(white) > 0.05:
            assert signs.setdefault(k, np.sign(white * r.whitened)) == np.sign(white * r.whitened)
        assert abs(abs(r.whitened) - abs(white)) < 1e-8


def test_components_are_certified_in_few_passes(spark):
    rng = np.random.default_rng(2)
    rows = embeddings(rng, 3000, 64, 1.0)
    fit = wh.integer_vectors(frame(spark, rows), "vec_id", "embedding").select("x").distinct().cache()
    covariance = wh.Covariance(fit, *wh.column_sums(fit, 64))
    found = wh.leading_components(covariance)
    _, _, v = plain(rows, 64)
    values, vectors = np.linalg.eigh(v)
    assert np.allclose(found.values, values[::-1][:4], rtol=1e-12)
    assert np.allclose(np.abs(np.sum(found.vectors * vectors[:, ::-1][:, :4], axis=0)), 1, atol=1e-12)
    assert found.residuals.max() <= 1e-12 * found.values[0]
    assert np.allclose(v @ found.vectors, found.vectors * found.values, atol=1e-11 * found.values[0])
    assert found.passes == covariance.passes <= 160


@pytest.mark.parametrize("degree", [1, 2, 5, 9])
def test_the_filter_is_the_chebyshev_polynomial(degree):
    rng = np.random.default_rng(degree)
    basis, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    values = np.array([0.0, 0.3, 1.0, 1.7, 2.0, 2.5, 3.0, 4.0, 5.0])
    v = (basis * values) @ basis.T
    q = rng.standard_normal((9, 3))
    got = wh.chebyshev(lambda y: v @ y, q, v @ q, degree, cut=2.0, top=5.0)
    polynomial = cheb.Chebyshev.basis(degree)
    scaled = polynomial((values - 1.0) / 1.0) / polynomial(4.0)
    assert np.allclose(got, (basis * scaled) @ basis.T @ q, atol=1e-10)


def test_rank_deficient_small_and_empty(spark):
    flat = [(k, [k / 256, 2 * k / 256, 0.0, 1.0, -1.0, 0.5]) for k in range(20)]
    found = wh.whiten(frame(spark, flat)).collect()
    assert {(r.component, r.whitened is None, r.explained > 0.999) for r in found} == {(1, False, True), (2, True, False), (3, True, False), (4, True, False)}
    assert found[0].identity_error < 1e-10
    one = wh.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    narrow = wh.whiten(frame(spark, [(k, [k / 8]) for k in range(9)])).collect()
    assert {r.component for r in narrow} == {1} and {r.explained for r in narrow} == {1.0}
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, None), (2, []), (3, [None])])).count() == 0


def test_large_entries_stay_exact(spark):
    schema = "vec_id string, embedding array<double>, component string, n string"
    far = [("a", [3e12, 1.0]), ("b", [-3e12, 2.0]), ("c", [1e300, -1e300]), ("d", [5.0, -7.5])]
    found = {r.vec_id: r.deviation for r in wh.whiten(frame(spark, far, schema)).collect()}
    limit = 2**63
    x = {"a": (768 * 10**12, 256), "b": (-768 * 10**12, 512), "c": (limit - 1, -limit), "d": (1280, -1920)}
    sums = [sum(v[k] for v in x.values()) for k in range(2)]
    for key, vector in x.items():
        exact = sum((4 * a - s) ** 2 for a, s in zip(vector, sums))
        assert found[key] == (exact if exact < limit else None)
    near = {r.vec_id: r.deviation for r in wh.whiten(frame(spark, far[:2], schema)).collect()}
    assert near == {"a": None, "b": None}
    middle = [("a", [4e4, 1.0]), ("b", [-4e4, 2.0]), ("c", [5.0, -7.5])]
    got = {r.vec_id: r.deviation for r in wh.whiten(frame(spark, middle, schema)).collect()}
    x = {"a": (10_240_000, 256), "b": (-10_240_000, 512), "c": (1280, -1920)}
    sums = [sum(v[k] for v in x.values()) for k in range(2)]
    assert got == {k: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for k, v in x.items()}

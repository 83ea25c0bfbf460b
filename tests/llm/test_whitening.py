"""Whitening: spectral divide and conquer against a direct method, exact sums,
brute force, edge cases."""

import math

import numpy as np
import pytest

from tally.llm import whitening as W


def random_symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


SPECTRA = {"spread": np.linspace(1, 100, 40), "wide": np.logspace(-8, 6, 30), "equal": np.full(12, 3.0),
           "clusters": np.repeat([9.0, 4.0, 4.0, 1e-3], 5), "deficient": np.r_[np.zeros(7), np.linspace(1, 9, 9)],
           "one": np.array([2.5]), "near": 1 + 1e-9 * np.arange(10), "signs": np.linspace(-5, 5, 11)}


@pytest.mark.parametrize("name", sorted(SPECTRA))
def test_components_of_a_symmetric_matrix(name):
    rng = np.random.default_rng(1)
    values = SPECTRA[name]
    a = random_symmetric(rng, values)
    e, v = W.spectral_components(a)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-12 * scale * len(values)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-12 * scale


def test_eigenvectors_are_those_of_the_direct_method():
    a = random_symmetric(np.random.default_rng(2), np.linspace(1, 50, 64) ** 1.5)
    e, v = W.spectral_components(a)
    direct = np.linalg.eigh(a)[1][:, ::-1]
    assert np.abs(np.abs((v * direct).sum(axis=0)) - 1).max() < 1e-13
    assert np.abs(v * np.sign((v * direct).sum(axis=0)) - direct).max() < 1e-11


def test_diagonal_and_block_matrices():
    for a in (np.diag([3.0, 1.0, 2.0]), np.array([[1.0, 0.5], [0.5, 1.0]]), np.zeros((4, 4)),
              np.kron(np.eye(3), np.array([[2.0, 1.0], [1.0, 2.0]]))):
        e, v = W.spectral_components(a)
        assert np.allclose(v @ np.diag(e) @ v.T, a, atol=1e-13) and (np.diff(e) <= 0).all()


def test_polar_factor():
    a = random_symmetric(np.random.default_rng(3), np.array([-7.0, -1e-6, 1e-7, 2, 900]))
    u = W.polar_factor(a)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-12
    h = u @ a
    assert np.abs(h - h.T).max() < 1e-9 and np.linalg.eigvalsh((h + h.T) / 2).min() > 0


def test_moments_join_exactly():
    rows = np.random.default_rng(4).standard_normal((500, 6)) + 100
    m = W.Moments(6)
    for part in np.array_split(rows, [0, 1, 7, 200]):
        m.add(part)
    c = rows - rows.mean(axis=0)
    assert m.n == 500 and np.allclose(m.products, c.T @ c, rtol=1e-9, atol=1e-9)


def brute(rows, k):
    """Rows (id, vector) to {(id, component)}: deviation, |whitened|, share."""
    own = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    n, s = len(own), [sum(c) for c in zip(*(v for _, v in own), strict=True)]
    x = np.array([[c - t / n for c, t in zip(v, s, strict=True)] for _, v in own])
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u = e[::-1], u[:, ::-1]
    z = x @ u[:, :k] / np.sqrt(e[:k])
    return [(i, c + 1, n, sum((n * a - t) ** 2 for a, t in zip(v, s, strict=True)), abs(z[r, c]), e[c] / e.sum())
            for r, (i, v) in enumerate(own) for c in range(k)]


def check(got, want):
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got)
    want = sorted(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-9)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_brute_force_with_hostile_rows(spark):
    rng = np.random.default_rng(6)
    mix = rng.standard_normal((5, 5))
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(5) @ mix * 3]) for i in range(120)]
    good += [good[0], good[1], (7, good[50][1])]  # repeated rows and ids
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [1.0, 2.0, 3.0, 4.0, float("inf")]),
           (204, []), (205, [1.0, 2.0]), (206, [1e30] * 5), (207, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<float>, n string").repartition(3)
    rows = W.whitened_components(df, 32).collect()
    check(rows, brute(good, 5))
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-12
    top = W.whitened_components(df, 2).collect()
    check(top, [w for w in brute(good, 5) if w[1] <= 2])


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [float("nan")])], [(1, [])]):
        out = W.whitened_components(spark.createDataFrame(rows, schema))
        assert out.collect() == [] and out.columns[:2] == ["vec_id", "component"]


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i % 7), 5.0, float(i % 7)]) for i in range(40)]
    got = W.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 40 and got[0].explained == pytest.approx(1)


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(i) * 1e10, 1.0]) for i in range(5)]
    got = W.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [math.floor(64 * r[1][0]) + 1_000_000 for r in rows]
    exact = [(5 * c - sum(x)) ** 2 for c in x]
    assert {r.vec_id: r.deviation for r in got} == {i: e if e < 1 << 63 else None for i, e in enumerate(exact)}
    assert any(e >= 1 << 63 for e in exact)

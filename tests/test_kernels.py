import math
from itertools import product
from statistics import NormalDist

import numpy as np
import pytest

from varloom.functions import codec, special
from varloom.functions.strength import names, register_strength, strength
from varloom.operators import assoc, finemap, linalg


def test_erfc():
    x = np.concatenate([np.linspace(-6, 6, 999), np.linspace(6, 26.5, 300)])
    want = np.array([math.erfc(v) for v in x])
    assert np.max(np.abs(special.erfc(x) / want - 1)) < 1e-12
    assert special.erfc(37.0) == 0


def test_quantiles():
    p = 10.0 ** np.linspace(-299, -1e-3, 200)
    assert np.allclose(special.norm_ppf(p), [NormalDist().inv_cdf(v) for v in p], rtol=1e-12)
    assert np.allclose(special.chi2_isf([0.5, 0.05, 5e-8, 1e-300]), [0.454936, 3.841459, 29.716785, 1373.87], rtol=1e-5)


def test_columns_agree_with_numpy(spark):
    x = [-3.0, -0.2, 0.0, 0.3, 1.0, 5.0, 20.0]
    p = [1e-300, 1e-8, 0.04, 0.5, 0.97]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", special.erfc_col(special.F.col("x")).alias("e")).toPandas()
    assert np.allclose(df.e, special.erfc(df.x), rtol=1e-13)
    dp = spark.createDataFrame([(v,) for v in p], "p double").select("p", special.chi2_isf_col(special.F.col("p")).alias("c")).toPandas()
    assert np.allclose(dp.c, special.chi2_isf(dp.p), rtol=1e-12)


@pytest.mark.parametrize("n", range(1, 10))
def test_codec(n):
    c = np.random.default_rng(n).integers(0, 4, (5, n)).astype(np.uint8)
    raw = codec.pack(c)
    assert raw.shape == (5, codec.width(n)) and (codec.unpack(raw, n) == c).all()
    assert raw[0, 0] >> 6 == c[0, 0]
    if n % 4:
        assert (raw[:, -1] & ((1 << (2 * (4 - n % 4))) - 1) == 0).all()
    assert (codec.counts(raw, n) == np.stack([(c == k).sum(1) for k in range(4)], 1)).all()


def test_stats_edges():
    assert codec.variant_stats([np.nan, np.nan]) == (0.0, 0.0, 0.0, True)
    assert codec.variant_stats([1, 1, 1])[1] == 0
    assert codec.variant_stats([0, 2.4, 1])[3] and codec.variant_stats([0, 2.4, 1])[0] == 0.5
    mu, sxx, maf = codec.stats_of_counts(np.array([[3, 2, 5, 1], [0, 0, 0, 4]]))
    d = np.array([0] * 3 + [1] * 2 + [2] * 5)
    assert np.allclose([mu[0], sxx[0], maf[0]], [d.mean(), ((d - d.mean()) ** 2).sum(), min(d.mean() / 2, 1 - d.mean() / 2)])
    assert mu[1] == sxx[1] == maf[1] == 0
    assert list(codec.codes_of([0, 1.6, 2.4, -1, np.nan])) == [0, 2, 3, 3, 3]


def test_hwe(spark):
    from varloom.operators.stats import with_hwe

    df = spark.createDataFrame([(25, 50, 25), (50, 0, 50), (96, 4, 0)], "n_geno0 long, n_geno1 long, n_geno2 long")
    r = with_hwe(df).toPandas()
    assert r.hwe_chi2[0] == 0 and r.hwe_p[0] == 1
    assert r.hwe_chi2[1] == pytest.approx(100)
    assert math.isnan(r.hwe_chi2[2]) and math.isnan(r.hwe_p[2])


def _design(n=100, p=8, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p))
    y = x @ np.r_[1.0, -0.7, np.zeros(p - 2)] + r.normal(size=n) * 0.3
    x, y = x - x.mean(0), y - y.mean()
    return x, y, x.T @ x / n, x.T @ y / n


@pytest.mark.parametrize("positive", [False, True])
def test_lasso_kkt(positive):
    _, _, g, b = _design()
    alpha = 0.05
    th = linalg.fista(g, b, alpha, positive=positive, max_iter=20000, tol=1e-12)
    grad = b - g @ th
    for t, d in zip(th, grad, strict=True):
        if t != 0:
            assert d == pytest.approx(alpha * np.sign(t), abs=1e-6)
        else:
            assert (d <= alpha + 1e-6) if positive else abs(d) <= alpha + 1e-6
    assert not positive or (th >= 0).all()


def test_ridge_and_logistic():
    _, _, g, b = _design()
    assert np.allclose((g + 0.1 * np.eye(8)) @ linalg.ridge_solve(g, b, 0.1), b)
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), r.normal(size=400)])
    y = (r.random(400) < 1 / (1 + np.exp(-(0.3 + x[:, 1])))).astype(float)
    w = linalg.logistic(x, y, 0.0)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w)))).max() < 1e-6
    assert len(linalg.lambda_grid(np.zeros(3), 5)) == 5


def test_spa_against_enumeration():
    n = 12
    r = np.random.default_rng(3)
    mu = np.full(n, 0.2)
    g = r.integers(0, 3, n).astype(float)
    w = mu * (1 - mu)
    gc = g - (g * w).sum() / w.sum()
    combos = np.array(list(product([0, 1], repeat=n)))
    prob = np.prod(np.where(combos == 1, mu, 1 - mu), axis=1)
    us = (combos - mu) @ gc
    u = np.quantile(us, 0.985)
    exact = prob[np.abs(us) >= abs(u) - 1e-9].sum()
    p = assoc.spa_pvalues(gc[:, None], mu, np.array([u]))[0]
    assert 0.3 < p / exact < 3
    far = assoc.spa_pvalues(gc[:, None], mu, np.array([us.max() * 0.999]))[0]
    assert 0 < far < p


def test_susie():
    r = np.random.default_rng(5)
    x = r.normal(size=(800, 20))
    y = 0.5 * x[:, 7] + r.normal(size=800)
    x, y = x - x.mean(0), y - y.mean()
    s = finemap.Sufficient(x.T @ x / 800, x.T @ y / 800, float(y @ y / 800), 800, np.full(20, 0.3))
    pips, alpha, sets = finemap.susie(s, 5)
    assert np.allclose(alpha.sum(1), 1) and (pips >= 0).all() and (pips <= 1 + 1e-12).all()
    assert pips.argmax() == 7 and any(c["members"] == [7] for c in sets)
    models = [frozenset({7}), frozenset({7, 3}), frozenset({1})]
    bma = finemap.model_average(models, s)
    assert bma[7] > 0.99
    assert finemap.joint_r2(s, [7]) > 0.1
    st = finemap.stability_from_stats(s, pairs=5, n_lambda=5)
    assert st.freq[7] >= st.freq.max() - 1e-9


def test_credible_prefix_of_alpha():
    c = finemap.credible_set(np.array([0.1, 0.6, 0.3]), 0.85)
    assert c["members"] == [1, 2] and c["coverage"] == pytest.approx(0.9)


def test_strength_registry():
    assert {"r2_se", "r2", "beta_abs", "z_abs", "chi2"} <= set(names())
    register_strength("mine", lambda slope, sxx, maf, n, syy: slope)
    assert callable(strength("mine"))
    with pytest.raises(ValueError):
        strength("none")

"""Kernels and distribution functions against plain numpy, closed forms and the standard library."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import kernels
from tidemark.functions import special
from tidemark.operators import portfolio as pf


def test_special_functions(spark):
    rows = spark.createDataFrame([(z,) for z in (-3.0, -0.5, 0.0, 1.2)], "z double")
    got = rows.select("z", special.norm_cdf(F.col("z")).alias("p"), special.norm_ppf(special.norm_cdf(F.col("z"))).alias("q")).collect()
    for r in got:
        assert math.isclose(r["p"], NormalDist().cdf(r["z"]), abs_tol=1e-9)
        assert math.isclose(r["q"], r["z"], abs_tol=1e-6)
    t, chi, f = spark.range(1).select(special.t_two_sided(F.lit(2.0), F.lit(1.0)), special.chi2_sf(F.lit(3.841458820694124), 1), special.f_sf(F.lit(1.0), F.lit(2.0), F.lit(2.0))).first()
    assert math.isclose(t, 1 - 2 / math.pi * math.atan(2.0), abs_tol=1e-9)
    assert math.isclose(chi, 0.05, abs_tol=1e-9) and math.isclose(f, 0.5, abs_tol=1e-9)


def test_tick_sides():
    assert kernels.tick_sides(np.array([5.0, 5, 6, 6, 5, 5, 7])).tolist() == [1, 1, 1, 1, -1, -1, 1]


def test_ewm_volatility_equals_pandas():
    px = np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.02, 80)))
    k = kernels.EwmVolatility(12)
    got = [k.push(p) for p in px]
    want = pd.Series(px).pct_change().ewm(span=12, adjust=False).std()
    assert np.allclose([np.nan if g is None else g for g in got], want, equal_nan=True)


def test_ffd_weights_and_first_difference():
    w = kernels.ffd_weights(1.0)
    assert np.allclose(w, [-1, 1])
    x = np.random.default_rng(2).normal(size=50)
    assert np.allclose(kernels.ffd(x, 1.0)[1:], np.diff(x))


def test_recursive_regression_equals_refitting():
    y = np.cumsum(np.random.default_rng(3).normal(size=60))
    got = kernels.bsadf(y, 1)
    w = kernels.least_window(len(y), 1)
    for end in (30, 45, 59):
        # the window over changes [s, m) uses levels s .. m + 1
        want = max(kernels.adf_t(y[s : end + 1], 1) for s in range(0, end - 1 - w + 1))
        assert math.isclose(got[end], want, rel_tol=1e-6)
    assert np.nanmax(got) >= np.nanmax(kernels.bsadf(y, 1, starts=1))


def test_runs_and_imbalance_bars_by_hand():
    k = kernels.ImbalanceBars(kernels.ImbalanceConfig(exp_ticks=3, span_ticks=3, span_imbalance=3), 1.0)
    assert [k.push(1.0) for _ in range(3)] == [False, False, True]
    r = kernels.RunsBars(kernels.RunsConfig(exp_ticks=4), 0.5, 1.0, 1.0)
    assert [r.push(s, 1.0) for s in (1, -1, 1)] == [False, False, True]


def test_average_cost_conserves_value():
    rng = np.random.default_rng(5)
    q, p = rng.integers(-5, 6, 200).astype(float), rng.uniform(10, 20, 200)
    pos, cost, pnl, cash = zip(*kernels.average_cost(q, p, np.zeros(200)), strict=True)
    for i in range(200):
        assert math.isclose(cash[i] + pos[i] * cost[i], pnl[i], abs_tol=1e-6)


def test_adaptive_alphas_cover():
    s = np.abs(np.random.default_rng(7).normal(size=1500))
    for widths, alphas in (kernels.adaptive_alphas(s, 0.1, 0.01, 200), kernels.dynamically_tuned(s, 0.1, window=200)):
        assert 0.86 < np.mean(s[200:] <= widths[200:]) < 0.95
        assert np.isinf(widths[:10]).all() and (alphas >= 0.001).all()


def test_lempel_ziv_and_match_length():
    assert kernels.lz78("aaaa") == 3 and kernels.lz78("ab") == 2 and kernels.lz78("") == 0
    rnd = "".join(np.random.default_rng(1).choice(list("01"), 400))
    assert kernels.match_length_entropy(rnd) > 4 * kernels.match_length_entropy("01" * 200)


def test_hrp_nco_and_clusters():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 2))
    x = np.column_stack([base[:, i // 3] + 0.3 * rng.normal(size=400) for i in range(6)])
    m = np.cov(x.T)
    assert pf.best_clusters(np.corrcoef(x.T)).tolist() in ([0, 0, 0, 1, 1, 1], [1, 1, 1, 0, 0, 0])
    for w in (pf.hrp_weights(m), pf.nco_weights(m)):
        assert math.isclose(w.sum(), 1.0) and len(w) == 6
    assert (pf.hrp_weights(m) > 0).all()
    assert np.allclose(pf.hrp_weights(np.diag([1.0, 2.0])), [2 / 3, 1 / 3])


def test_marchenko_pastur():
    assert math.isclose(pf.mp_edge(0.25), 2.25)
    grid = np.linspace(1e-6, 3, 20001)
    assert math.isclose(pf.mp_density(grid, 0.25, 1.0).sum() * (grid[1] - grid[0]), 1.0, abs_tol=0.01)
    x = np.random.default_rng(3).normal(size=(1000, 50))
    assert abs(pf.fit_sigma2(np.linalg.eigvalsh(np.corrcoef(x.T)), 0.05) - 1) < 0.2


@pytest.mark.parametrize("bad", [0, -1])
def test_thresholds_are_checked(bad):
    with pytest.raises(ValueError):
        kernels.ThresholdBars(bad)


def test_sequential_bootstrap_prefers_unique_spans():
    starts, ends = np.array([0, 0, 0, 10]), np.array([4, 4, 4, 12])
    out = [kernels.sequential_bootstrap(starts, ends, 13, np.random.default_rng(s).random(4)) for s in range(200)]
    assert np.mean([(o == 3).sum() for o in out]) > 1.05


def test_prices_that_cannot_be_used_are_passed_over():
    cusum, vol = kernels.Cusum(0.5), kernels.EwmVolatility(5)
    assert [cusum.push(p) for p in (1.0, 0.0, float("nan"), None, 2.0)] == [False, False, False, False, True]
    clean = kernels.EwmVolatility(5)
    want = [clean.push(p) for p in (1.0, 1.1, 1.0)]
    assert [x for x, p in zip(map(vol.push, (1.0, 0.0, 1.1, None, 1.0)), (1, 0, 1, 0, 1), strict=True) if p] == want

"""Kernels against plain loops, and properties that hold for any input."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import information as I
from tidemark.operators import kernels as K
from tidemark.operators import learning as L
from tidemark.operators import metrics as M
from tidemark.operators import patterns as P
from tidemark.operators import portfolio as PF
from tidemark.operators import regimes as G
from tidemark.operators import risk as R
from tidemark.operators import search as S
from tidemark.operators import simulation as SI
from tidemark.operators import splits as SP


@pytest.fixture
def bars():
    rng = np.random.default_rng(0)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    start = np.concatenate(([100.0], close[:-1]))
    spread = rng.random(300)
    return {"open": start, "close": close, "high": np.maximum(start, close) + spread, "low": np.minimum(start, close) - spread, "volume": np.ones(300)}


@pytest.fixture
def x():
    rng = np.random.default_rng(3)
    return rng.multivariate_normal([0.001, 0.0005, 0.0002, 0.0008], [[4e-4, 1e-4, 0, 0], [1e-4, 3e-4, 0, 0], [0, 0, 1e-4, 5e-5], [0, 0, 5e-5, 2e-4]], 400)


def test_ewm_is_pandas():
    v = np.array([np.nan, 1.0, 2.0, np.nan, np.nan, 5.0, 4.0])
    assert np.allclose(K.ewm(v, 0.3), pd.Series(v).ewm(alpha=0.3, adjust=False).mean().to_numpy(), equal_nan=True)


def test_indicators_stay_in_their_ranges(bars):
    found = K.indicator_set(bars)
    for name in ("rsi", "adaptive_rsi", "adaptive_stoch", "laguerre_rsi", "adx"):
        v = found[name][np.isfinite(found[name])]
        assert (v >= -1e-9).all() and (v <= 100 + 1e-9).all(), name
    assert (found["period"][30:] >= 1).all() and (found["period"] <= 25 + 1e-9).all()


def test_cycle_finds_a_sine():
    period = K.dominant_period(100 + np.sin(2 * np.pi * np.arange(400) / 20), 1.0)
    assert abs(np.median(period[200:]) - 20) < 2


def test_zigzag_alternates_and_knows_no_future(bars):
    z = K.zigzag(bars, np.full(300, 2.0))
    at = np.flatnonzero(z["pivot"])
    assert len(at) > 3 and (np.diff(z["pivot"][at]) != 0).all() and (z["pivot_known"][at] > at).all()
    cut = {k: v[:200] for k, v in bars.items()}
    early = K.zigzag(cut, np.full(200, 2.0))
    known = at[z["pivot_known"][at] < 200]
    assert (early["pivot"][known] == z["pivot"][known]).all()


def test_weights_are_portfolios(x):
    for name, work in PF.STRATEGIES.items():
        w = work(x, np.cov(x, rowvar=False))
        assert abs(w.sum() - 1) < 1e-6 and (w >= -1e-9).all(), name
    cov = np.cov(x, rowvar=False)
    best = PF.minimum_variance(cov)
    rng = np.random.default_rng(1)
    assert all(best @ cov @ best <= w @ cov @ w + 1e-12 for w in rng.dirichlet(np.ones(4), 500))
    w = PF.risk_parity(cov)
    assert np.allclose(w * (cov @ w) / (w @ cov @ w), 0.25, atol=1e-6)
    sharpe = lambda w: (w @ x.mean(axis=0)) / math.sqrt(w @ cov @ w)
    assert sharpe(PF.max_sharpe(x.mean(axis=0) * 252, cov * 252)) >= max(sharpe(w) for w in rng.dirichlet(np.ones(4), 500)) - 2e-3


def test_bounded_simplex():
    w = PF.bounded_simplex(np.array([3.0, 0.2, -1.0]), 0.1, 0.6)
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0.1 - 1e-12 and w.max() <= 0.6 + 1e-12


def test_rules_halve_stop_and_restore():
    days = np.repeat(np.arange(6), 2)
    equity, used = PF.apply_rules(np.array([0.0, -0.05, 0.0, -0.04, -0.01, 0.05, 0.03, 0.02, 0.0, 0.0, 0.0, 0.0]), days)
    assert used[0] == 1 and used[2] == 1 and used[4] == 0.5 and equity[-1] > 0
    assert PF.apply_rules(np.array([-0.05, -0.5]), np.array([0, 0]))[1].tolist() == [1.0, 0.0]


def test_allocator_keeps_bounds_and_turnover():
    rng = np.random.default_rng(5)
    train = {k: rng.normal(0.0004, 0.01, 300) for k in "ABC"}
    a = PF.RiskAllocator().fit(train)
    m = a.compute({k: v[-100:] for k, v in train.items()})
    base = {"A": 0.5, "B": 0.3, "C": 0.2}
    assert all(0.5 <= v <= 1.5 for v in m.values())
    w = a.overlay(base, {"A": 0.1, "B": 3.0, "C": 2.0}, base)
    assert abs(sum(w.values()) - 1) < 1e-9 and max(w.values()) <= 0.7 and sum(abs(w[k] - base[k]) for k in base) <= 0.1 + 1e-9
    assert a.compute({"D": np.zeros(3)})["D"] == 1.0


def test_covariance_tools(x):
    bad = np.array([[1, 0.9, 0.9], [0.9, 1, -0.9], [0.9, -0.9, 1.0]])
    good = R.project_correlation(bad)
    assert np.linalg.eigvalsh(good)[0] > -1e-9 and np.allclose(np.diag(good), 1)
    assert np.linalg.eigvalsh(R.shift_to_psd(bad))[0] >= -1e-9
    cov = np.cov(x, rowvar=False)
    assert np.allclose(np.diag(R.marchenko_pastur(cov, len(x))), np.diag(cov))
    shrunk, k = R.ledoit_wolf(x)
    assert 0 <= k <= 1 and np.trace(shrunk) == pytest.approx(np.trace(np.cov(x, rowvar=False, bias=True)))
    assert R.onc(np.kron(np.eye(2), np.full((3, 3), 0.9)) + 0.1 * np.eye(6)).members == [[0, 1, 2], [3, 4, 5]]


def test_garch_finds_the_level():
    rng = np.random.default_rng(0)
    h, out = 1e-4, []
    for _ in range(1500):
        e = math.sqrt(h) * rng.standard_normal()
        out.append(e)
        h = 5e-6 + 0.08 * e * e + 0.87 * h
    v = R.garch_variance(np.array(out), 500)
    assert 4e-5 < v < 2.5e-4
    assert R.garch_variance(np.arange(5.0), 3) == pytest.approx(np.arange(5.0).var(ddof=1))


def test_bootstrap_and_p_values():
    rng = np.random.default_rng(0)
    i = SI.stationary_indices(rng, 100, 1000, 10)
    assert i.min() >= 0 and i.max() < 100 and 0.8 < ((np.diff(i) == 1) | (np.diff(i) == -99)).mean() < 0.97
    v = rng.normal(0, 0.01, 200)
    assert np.allclose(np.sort(SI.simulate(v, "iid", rng)), np.sort(v))
    shape, scale = SI.fit_gpd(rng.exponential(2.0, 20_000))
    assert abs(shape) < 0.05 and abs(scale - 2) < 0.1
    assert SI.chi2_survival(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert SI.combine_p_values([0.5, 0.5], "stouffer") == pytest.approx(0.5)
    assert SI.combine_p_values([0.01, 0.02]) < 0.01 and math.isnan(SI.combine_p_values([]))
    assert SI.permutation_p_value(2.0, np.array([1.0, 2.0, 3.0])) == 0.75
    ar = np.zeros(2000)
    for k in range(1, 2000):
        ar[k] = 0.8 * ar[k - 1] + rng.standard_normal()
    assert SI.optimal_block(ar) > SI.optimal_block(rng.standard_normal(2000))


def test_permuted_bars_are_bars(bars):
    days = np.arange(300) // 10
    for method in ("permutation", "stationary"):
        p = SI.permute_bars(bars, days, np.random.default_rng(1), method)
        assert (p["high"] >= np.maximum(p["open"], p["close"]) - 1e-9).all() and (p["low"] <= np.minimum(p["open"], p["close"]) + 1e-9).all()


def test_information():
    v = np.random.default_rng(0).standard_normal(4000)
    assert I.discrete_mi(v, v) > 1.0 and I.discrete_mi(v, np.roll(v, 7)) < 0.02
    lead = np.concatenate(([0.0], v[:-1]))
    assert I.transfer_entropy(v, lead) > 1 > 0.1 > I.transfer_entropy(lead, v)
    assert I.jensen_shannon(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1.0)
    assert I.kl_divergence(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == pytest.approx(0.0)


def test_models_learn():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((600, 5))
    y = (z[:, 1] + 0.3 * rng.standard_normal(600) > 0).astype(float)
    model, gain = L.boosted_trees(z[:400], y[:400])
    assert ((model(z[400:]) > 0.5) == y[400:]).mean() > 0.85 and gain.argmax() == 1
    found = L.permutation_importance(model, z[400:], y[400:], repeats=4)
    assert found["mean"].idxmax() == 1 and L.select_features(found, least=2)[0] == 1
    p = 1 / (1 + np.exp(-3 * z[:, 1]))
    best = L.Calibrator.best(p, y)
    assert ((best.transform(p) - y) ** 2).mean() <= ((p - y) ** 2).mean()
    assert ((L.bagged(z[:400], y[:400], 3, trees=10)(z[400:]) > 0.5) == y[400:]).mean() > 0.8


def test_hidden_markov_finds_states():
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 2, 0, 2], 80)
    z = np.array([[0, 0], [4, 1], [8, -1]])[truth] + rng.standard_normal((400, 2))
    m = G.HiddenMarkov(3).fit(z)
    assert (G.align(m.posterior(z), z).argmax(axis=1) == truth).mean() > 0.97 and m.converged
    assert (G.align(G.gaussian_mixture(z), z).argmax(axis=1) == truth).mean() > 0.9
    assert np.allclose(G.hmm_ensemble(z, 3, align_states=True).sum(axis=1), 1)


def test_replay_and_score():
    b = {k: np.array(v, dtype=float) for k, v in {"open": [10, 11, 12, 13], "close": [11, 12, 13, 14], "high": [11, 12, 13, 14], "low": [10, 11, 12, 13]}.items()}
    equity, trades = S.replay(b, np.array([1, 1, -1, 0.0]), spread=0.2, cash=100.0)
    assert [(t[0], t[1], t[2]) for t in trades] == [(1, 3, 1.0), (3, 3, -1.0)]
    assert trades[0][5] == pytest.approx(13 - 0.1 - 11.1) and equity[-1] == pytest.approx(100 + sum(t[5] for t in trades))


def test_adf_tells_walks_from_noise():
    rng = np.random.default_rng(0)
    noise = rng.standard_normal(600)
    assert S.adf(noise) < -5 and S.adf(np.cumsum(noise)) > -2.86


def test_zones_merge():
    z = pd.DataFrame([("s", 1.0, 2.0, 3, 10, 50), ("s", 1.1, 2.1, 5, 5, 60), ("s", 4.0, 5.0, 3, 1, 9)], columns=["symbol", "zone_low", "zone_high", "touches", "first_idx", "expires_idx"])
    assert P.merge_zones(z).values.tolist() == [["s", 1.0, 2.1, 5, 5, 60], ["s", 4.0, 5.0, 3, 1, 9]]
    assert P.detect_zones(np.array([1.0, 1.05, 1.1, 5.0]), np.array([1, 2, 3, 4]), 0.2, 3, 10, 100) == [(3, 1.0, 1.1, 3)]


def test_walk_forward_windows():
    w = SP.MonthWalkForward(10, 3).windows(0, 18)
    assert w == [(0, 0, 9, 10, 12), (1, 3, 12, 13, 15), (2, 6, 15, 16, 18)]
    assert SP.MonthWalkForward(10, 3, anchored=True).windows(0, 18)[2][:3] == (2, 0, 15)


def test_steps_and_expected_maximum():
    assert [M.clean_step(v) for v in (0.3, 1.0, 2.2, 7.0, 11.0)] == [0.5, 1.0, 2.5, 10.0, 20.0]
    rng = np.random.default_rng(0)
    assert M.expected_max_sharpe(50) == pytest.approx(rng.standard_normal((4000, 50)).max(axis=1).mean(), abs=0.05)
    assert NormalDist().cdf(0) == 0.5


def test_shrinkage_and_spectral_scores(x):
    rng = np.random.default_rng(2)
    noise = rng.standard_normal((200, 80))
    raw, shrunk = np.cov(noise, rowvar=False), R.nonlinear_shrinkage(noise)
    assert np.linalg.norm(shrunk - np.eye(80)) < 0.3 * np.linalg.norm(raw - np.eye(80))
    assert np.allclose(R.spectral_scores(x, communality=True), 1)


def test_neighbour_information_of_gaussians():
    rng = np.random.default_rng(0)
    a = rng.standard_normal(1500)
    b = 0.8 * a + 0.6 * rng.standard_normal(1500)
    assert I.knn_mutual_information(a, b) == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.08)
    assert I.knn_mutual_information(a, rng.standard_normal(1500)) < 0.06


def test_single_features_and_kendall():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((400, 3))
    y = (z[:, 2] > 0).astype(float)
    assert L.single_feature_scores(z, y).argmax() == 2
    assert L.kendall(np.arange(5.0), np.array([0.0, 1, 2, 4, 3])) == pytest.approx(0.8)

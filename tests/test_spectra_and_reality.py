"""Fitted noise spectra, rolling spectra against dense decompositions, and reality checks against plain recomputation."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.operators import reality, risk, simulation, spectra
from tidemark.plans import registry
from tidemark.plans.research import daily_returns
from tidemark.sources import views


@pytest.mark.parametrize("columns, rows, variance, spikes", [(400, 1000, 1.0, 0), (400, 1600, 0.6, 8), (500, 800, 1.7, 20)])
def test_planted_noise_is_found(columns, rows, variance, spikes):
    """Ratio and variance within 5 %, whatever the start, with some large eigenvalues among them."""
    rng = np.random.default_rng(columns + spikes)
    x = math.sqrt(variance) * rng.standard_normal((rows, columns))
    for k in range(spikes):
        x[:, k] *= 6
    values = np.linalg.eigvalsh(x.T @ x / rows)
    for start in (columns / rows, 1.5 * columns / rows, 0.4 * columns / rows):
        q, v = spectra.fit_noise(values, start)
        assert q == pytest.approx(columns / rows, rel=0.05) and v == pytest.approx(variance, rel=0.05)
    _, signal = spectra.cleaned_values(values, columns / rows)
    # without any signal the largest tenth stays
    assert abs(int(signal.sum()) - spikes) <= 4 or (not spikes and signal.sum() == columns // 10)


def test_law_is_a_density():
    for q, v in ((0.2, 1.0), (0.9, 0.5), (0.5, 2.0)):
        at = np.linspace(v * (1 - math.sqrt(q)) ** 2, v * (1 + math.sqrt(q)) ** 2, 400_001)
        density = spectra.law(at, q, v)
        assert np.trapezoid(density, at) == pytest.approx(1, abs=1e-3) and np.trapezoid(density * at, at) == pytest.approx(v, abs=1e-3)


def test_denoising_chooses_by_the_ratio():
    assert [spectra.choose("auto", n, t) for n, t in ((9, 900), (20, 30), (20, 41))] == ["shrinkage", "shrinkage", "fitted"]
    assert [spectra.choose("fitted", n, t) for n, t in ((9, 900), (20, 24), (20, 30))] == ["shrinkage", "shrinkage", "fitted"]
    with pytest.raises(ValueError):
        spectra.choose("other", 20, 100)
    rng = np.random.default_rng(2)
    factor = rng.standard_normal((300, 3))
    x = factor @ rng.standard_normal((3, 60)) + rng.standard_normal((300, 60)) * 2
    cov = np.cov(x, rowvar=False)
    got = spectra.denoise(cov, x)
    assert np.allclose(np.diag(got), np.diag(cov)) and np.linalg.eigvalsh(got).min() > -1e-8
    assert np.linalg.cond(risk.correlation(got)) < np.linalg.cond(risk.correlation(cov))
    assert np.allclose(spectra.denoise(cov[:5, :5], x[:, :5]), risk.ledoit_wolf(x[:, :5])[0])
    assert np.allclose(spectra.denoise(cov, x, "nonlinear"), risk.nonlinear_shrinkage(x))
    # no eigenvalue above the edge: the largest tenth stays
    values, signal = spectra.cleaned_values(np.linspace(0.9, 1.1, 30), 0.3)
    assert signal.sum() >= 3 and values[~signal].std() < 1e-12


@pytest.mark.parametrize("p, k", [(3, 3), (12, 3), (40, 5)])
def test_window_spectra_equal_dense_decompositions(p, k):
    rng = np.random.default_rng(p)
    x = rng.standard_normal((400, p)) + np.outer(rng.standard_normal(400), np.linspace(0, 1, p)) + 50
    x[100:170, 0] = 3.0
    got = spectra.window_spectra(x, 60, k)
    assert got.shape == (341, k)
    for i in range(0, 341, 7):
        w = x[i : i + 60]
        live = w.std(axis=0) > 0
        want = np.sort(np.linalg.eigvalsh(np.corrcoef(w[:, live], rowvar=False)))[::-1][:k]
        np.testing.assert_allclose(got[i][: len(want)], want, atol=1e-7)


def test_rolling_spectrum_query(spark):
    folder = f"{DATA}/sf0.01"
    got = registry.queries()["rolling_spectrum"](spark, folder).toPandas()
    wide = daily_returns(spark, folder).toPandas().assign(ts=lambda d: d.ts.dt.normalize()).pivot_table(index="ts", columns="asset", values="ret", aggfunc="mean").fillna(0.0).sort_index()
    top = got.pivot(index="day", columns="component", values="value").sort_index()
    assert len(top) == len(wide) - 59
    for i in range(0, len(top), 25):
        want = np.linalg.eigvalsh(np.corrcoef(wide.to_numpy()[i : i + 60], rowvar=False))[::-1][:3]
        np.testing.assert_allclose(top.iloc[i].to_numpy(), want, atol=2e-6)


def table(spark, x):
    return spark.createDataFrame([(k, t, float(v)) for t, row in enumerate(x) for k, v in enumerate(row)], "strategy long, ts long, value double").repartition(5)


@pytest.mark.parametrize("per_task", [2, 100])
def test_check_over_a_table(spark, per_task):
    """Blocks of strategies give what one array gives."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 9)) + np.linspace(-1, 0.15, 9)
    x[:, 4] = 0.0
    got = reality.reality_check(table(spark, x), 300, per_task=per_task).first()
    want = reality.array_check(x, 300)
    assert (got.strategies, got.times) == (9, 120) and {k: got[k] for k in want} == pytest.approx(want)
    assert got.lower <= got.consistent <= got.upper
    assert reality.reality_check(table(spark, x).limit(0)).count() == 0


def test_check_from_its_definition():
    """Replicates by drawing rows, kind by kind, without weights or products."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 4)) + [0.3, 0.0, -0.2, -2.0]
    drawn = np.array([x[simulation.stationary_indices(np.random.default_rng([7, b]), 80, 80, 5.0)].mean(axis=0) for b in range(200)])
    mean, sd = x.mean(axis=0), drawn.std(axis=0)
    statistic = max((mean / sd).max(), 0)
    bound = -sd * math.sqrt(2 * math.log(math.log(80)))
    want = {"plain": ((drawn - mean).max(axis=1) >= mean.max()).mean()}
    for kind, centre in (("lower", np.maximum(mean, 0)), ("consistent", np.where(mean < bound, 0, mean)), ("upper", mean)):
        want[kind] = np.mean([max(((d - centre) / sd).max(), 0) >= statistic for d in drawn])
    assert reality.array_check(x, 200, 5.0) == pytest.approx(want)


def test_p_values_are_uniform_without_skill_and_small_with():
    rng = np.random.default_rng(5)
    found = np.array([reality.array_check(rng.standard_normal((100, 4)), 150, 1.0, seed=s)["upper"] for s in range(250)])
    ordered = np.sort(found)
    assert np.abs(ordered - (np.arange(250) + 0.5) / 250).max() < 0.1
    skilled = rng.standard_normal((500, 5)) + 0.3
    assert max(reality.array_check(skilled, 300).values()) < 0.01
    assert simulation.reality_check(skilled) < 0.01 and simulation.reality_check(skilled, recenter=False) > 0.3


def test_reality_query(spark):
    folder = f"{DATA}/sf0.01"
    got = registry.queries()["reality_check"](spark, folder).first()
    t = views.trades(spark, folder).select("strategy", "entry_time", "return_pct").toPandas()
    wide = t.assign(month=t.entry_time.dt.strftime("%Y-%m")).pivot_table(index="month", columns="strategy", values="return_pct", aggfunc="mean").fillna(0.0)
    assert (got.strategies, got.times) == (wide.shape[1], wide.shape[0])
    want = reality.array_check(wide.to_numpy())
    assert {k: got[k] for k in want} == pytest.approx(want, abs=2e-3)

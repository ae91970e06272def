"""Queries without SQL: what their results have to satisfy, recomputed in numpy where that is possible."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.operators import information as I
from tidemark.operators import portfolio as PF
from tidemark.operators import risk as RK
from tidemark.operators import spectra
from tidemark.plans import registry
from tidemark.plans.research import daily_returns

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def returns(spark):
    """Daily returns, days by assets, gaps as nan."""
    return daily_returns(spark, SF).toPandas().pivot(index="ts", columns="asset", values="ret").sort_index()


@pytest.fixture(scope="module")
def vectors(spark):
    return np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], dtype=np.float64)


def square(df, value="cov"):
    m = df.pivot(index="asset_i", columns="asset_j", values=value)
    return m.sort_index().sort_index(axis=1).to_numpy()


def covariance(df, returns, vectors):
    m = square(df)
    assert m.shape == (5, 5) and np.allclose(m, m.T) and np.linalg.eigvalsh(m)[0] > -1e-9
    sample = np.cov(returns.fillna(0.0).to_numpy(), rowvar=False)
    assert np.abs(np.log(np.diag(m) / np.diag(sample))).max() < 4


def spectrum(df, returns, vectors):
    want = np.linalg.eigvalsh(np.corrcoef(vectors.T))[::-1]
    assert np.allclose(df.sort_values("component").eigenvalue, want) and abs(df.share.sum() - 1) < 1e-9


def clusters(df, returns, vectors):
    assert sorted(df.feature) == list(range(vectors.shape[1])) and df.silhouette.between(-1, 1).all()


def loadings(df, returns, vectors):
    r = np.corrcoef(vectors.T)
    first = df[df.component == 1].sort_values("rank")
    w = np.linalg.eigh(r)[1][:, -1]
    assert np.allclose(first.loading.abs(), np.sort(np.abs(w))[::-1][:10]) and len(df) == 10 * len(r)


def eigenvalues(df, returns, vectors):
    x = returns.fillna(0.0).to_numpy()
    top = df.columns[df.columns.str.contains("eigen|top")][0]
    last = df.sort_values(df.columns[0]).iloc[-1]
    assert df[top].between(1 - 1e-9, 5).all()
    assert abs(last[top] - np.linalg.eigvalsh(np.corrcoef(x[-60:].T))[-1]) < 0.5


def dependence(df, returns, vectors):
    assert df.groupby(["a", "b"]).size().nunique() == 1 and len(df.groupby(["a", "b"])) == 10
    a, b = sorted(returns.columns)[:2]
    own = df[(df.a == a) & (df.b == b)].sort_values("ts")
    both = returns[[a, b]].dropna()
    x, y = both[a].to_numpy()[:252], both[b].to_numpy()[:252]
    first = own.iloc[0]
    assert abs(first["corr"] - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(first["mi"] - I.discrete_mi(x, y)) < 1e-9


def weights(df, returns, vectors):
    sums = df.groupby(["date", "strategy"]).weight.sum()
    assert np.allclose(sums, 1, atol=1e-5) and df.weight.between(-1e-9, 1 + 1e-9).all() and df.groupby("date").size().eq(50).all()


def curve(df, returns, vectors):
    for _, g in df.groupby("strategy"):
        g = g.sort_values("ts")
        assert np.allclose(g.equity, 100_000 * np.cumprod(1 + g.ret), rtol=1e-3) and len(g) > 100


def simulated(df, returns, vectors):
    assert len(df) == 20 and (df.p05 <= df.p25).all() and (df.p25 <= df.p50).all() and (df.p50 <= df.p75).all() and (df.p75 <= df.p95).all()
    assert df["rank"].between(0, 1).all()
    end = df[(df.metric == "terminal")].set_index("asset").real
    whole = returns.apply(lambda x: np.prod(1 + x.dropna()))
    assert np.allclose(end.sort_index(), whole.sort_index(), rtol=1e-6) or np.allclose(end.sort_index() + 1, whole.sort_index(), rtol=1e-6)


def permuted(df, returns, vectors):
    assert (df.n == 200).all() and df.p_value.between(1 / 201, 1).all() and len(df) == 5


def tails(df, returns, vectors):
    own = df.set_index("asset").evt_var
    for a in returns:
        x = -returns[a].dropna().to_numpy()
        assert 0.3 * np.quantile(x, 0.95) < own[a] < 1.5 * x.max()
    assert (df.block >= 1).all()


def regimes(df, returns, vectors):
    assert set(df.regime) <= {0, 1, 2} and set(df.next_regime) <= {0, 1, 2} and df.confidence.between(1 / 3 - 1e-9, 1 + 1e-9).all()
    share = df.groupby("symbol").fitted.mean()
    assert share.between(0.65, 0.75).all()


def calibrated(df, returns, vectors):
    assert sorted(df.feature) == list(range(vectors.shape[1])) and (df.brier < 0.26).all() and (df.log_loss < 0.72).all()


def votes(df, returns, vectors):
    assert len(df) == 4 * vectors.shape[1] and (df.se >= 0).all() and not df[df["mean"] >= 0].harmful.any()


def schedule(df, returns, vectors):
    g = df.groupby("date")
    assert np.allclose(g.weight.sum(), 1) and (g.moved.first().iloc[1:] <= 0.1 + 1e-9).all() and df.multiplier.between(0.5 - 1e-9, 1.5 + 1e-9).all()


def fraction(df, returns, vectors):
    assert df.fraction.between(0, 2.5).all() and df.freedom.between(2, 200).all() and len(df) == 35


def search(df, returns, vectors):
    same = df.groupby("params").value.nunique(dropna=False)
    assert len(df) == 24 and (same == 1).all()


def study(df, returns, vectors):
    assert df["rank"].tolist() == list(range(1, len(df) + 1)) and df.composite.is_monotonic_decreasing and df.tier.isin([1, 2, 3, 4]).all()
    assert df.near_stability.between(0, 1).all() and df.boot_stability.between(0, 1).all()


def models(df, returns, vectors):
    assert sorted(df.strategy) == ["garch", "marchenko_pastur", "sample", "shrinkage"] and (df.max_drawdown > 0).all()
    assert df[df.strategy == "sample"].sharpe_delta.iloc[0] == 0 and not df[df.strategy == "sample"].better.iloc[0]


def importance(df, returns, vectors):
    assert abs(df.importance.sum() - 1) < 1e-9


def signals(df, returns, vectors):
    assert df.signal.isin([-1, 0, 1]).all() and not df.duplicated(["symbol", "ts"]).any()


def zones(df, returns, vectors):
    assert df.in_zone.isin([-1, 0, 1, 2]).all() and (df.in_zone != 0).mean() < 0.5 and not df.duplicated(["symbol", "ts"]).any()


def differences(df, returns, vectors):
    assert df.d.between(0, 1).all() and len(df) == 5


def members(df, returns, vectors):
    assert (df.members == 24).all() and (df.kept + df.failed + df.not_converged + df.unstable == 24).all() and (df.kept > 12).all()


def information(df, returns, vectors):
    """All pairs, held to brute force in test_neighbours."""
    assert len(df) == vectors.shape[1] * (vectors.shape[1] - 1) // 2 and (df.n == len(vectors)).all() and (df.mi >= 0).all()


def boosting(df, returns, vectors):
    """Trees and losses are held to those of one array in test_boosting."""
    train = df[df.part == "train"].sort_values("round").loss.tolist()
    assert set(df.part) == {"train", "dev", "test"} and train == sorted(train, reverse=True) and df.groupby("part").size().nunique() == 1


def parts(df, returns, vectors):
    assert df.n.sum() == len(vectors) and (df.positive + df.negative == df.n).all() and df.set_index("part").accuracy["train"] > 0.6


def moved(df, returns, vectors):
    assert sorted(df.group) == list(range(vectors.shape[1])) and (df.se >= 0).all() and df["mean"].between(-1, 1).all()


def trials(df, returns, vectors):
    """Scores are held to a full run in test_tuning."""
    df = df.sort_values("place")
    assert len(df) == 8 and df.rung.is_monotonic_decreasing and (df.rung == 2).sum() == 2 and (df.objective <= df["mean"] + 1e-9).all()


def curve_of_sizes(df, returns, vectors):
    df = df.sort_values("share")
    assert df.rows.is_monotonic_increasing and len(df) == 5 and df.train.iloc[0] - df.test.iloc[0] > df.train.iloc[-1] - df.test.iloc[-1]


def components(df, returns, vectors):
    """Held to dense decompositions in test_spectra_and_reality."""
    assert set(df.component) == {0, 1, 2} and (df.groupby("day").value.sum() <= 5 + 1e-6).all() and df.value.ge(-1e-9).all()


def levelled(df, returns, vectors):
    df = df.sort_values("place")
    assert df.value.is_monotonic_decreasing and np.allclose(df.value, np.linalg.eigvalsh(np.corrcoef(vectors, rowvar=False))[::-1], atol=1e-5)
    assert df[~df.signal].cleaned.nunique() == 1 and (df[df.signal].value > df.edge.iloc[0]).all() and df.cleaned.sum() == pytest.approx(vectors.shape[1], abs=1e-4)


def luck(df, returns, vectors):
    """Held to plain recomputation in test_spectra_and_reality."""
    assert len(df) == 1 and df[["plain", "lower", "consistent", "upper"]].iloc[0].between(0, 1).all() and df.lower.iloc[0] <= df.upper.iloc[0]


def matrix(df, returns, vectors):
    """Held to pandas and to other operators in test_matrices."""
    assert df.shape[1] == 2 + 28 + 11 + 3 and not df.isna().any().any() and df.bb_position_b.between(0, 1).all() and df.atr_adaptive_b.between(0, 1).all()


def denoised(df, returns, vectors):
    """All three methods from sums, against those of the rows themselves."""
    cov, k = np.cov(vectors, rowvar=False), vectors.shape[1]
    want = {"auto": spectra.denoise(cov, vectors), "shrinkage": RK.ledoit_wolf(vectors)[0], "nonlinear": RK.nonlinear_shrinkage(vectors)}
    for method, own in df.groupby("method"):
        assert np.allclose(own.sort_values(["i", "j"])["cov"].to_numpy().reshape(k, k), want[method], atol=1e-7), method


def diagnosed(df, returns, vectors):
    x = returns.fillna(0.0).to_numpy()
    for how, own in df.groupby("how"):
        want = PF.diagnose(x, how).set_index("strategy")
        got = own.set_index("strategy").loc[want.index]
        for n in ("share", "mean", "sd", "correlation"):
            assert np.allclose(got[n], want[n], atol=1e-6), (how, n)


def perturbed(df, returns, vectors):
    base = duckdb.sql(f"select p_partkey as param_id, p_size as size0, p_brand as brand0, p_retailprice / 100 as score0 from '{SF}/part.parquet'").df()
    both = df.merge(base, on="param_id")
    assert len(both) == 3 * len(base) and both.p_size.between(1, 50).all() and ((both.p_size - both.size0).abs() <= 5).all() and both.p_size.ne(both.size0).mean() > 0.7
    assert ((both.score - both.score0).abs() <= 10 + 1e-9).all() and both.p_brand.isin([f"Brand#{k}" for k in range(1, 26)]).all()
    assert 0.05 < both.p_brand.ne(both.brand0).mean() < 0.15


def selected(df, returns, vectors):
    whole, inside = df[df.feature.isna()], df[df.feature.notna()]
    assert whole.cluster.is_unique and inside.feature.is_unique and set(inside.cluster) <= set(whole[whole["mean"] > 0].cluster)
    assert (inside[inside.kept]["mean"] > 0).all() and not whole.kept.any() and inside.gain.between(0, 1).all()


CHECKS = {
    "denoised_vectors": denoised, "ensemble_diagnosis": diagnosed, "perturbed_trials": perturbed, "selection_report": selected,
    "meta_label_matrix": matrix,
    "rolling_spectrum": components, "noise_spectrum": levelled, "reality_check": luck,
    "tuned_trials": trials, "learning_curve": curve_of_sizes,
    "boosting_losses": boosting, "boosting_metrics": parts, "permuted_importance": moved,
    "ensemble_members": members, "neighbour_information": information,
    "garch_covariance": covariance, "denoised_covariance": covariance, "pca_spectrum": spectrum, "onc_clusters": clusters, "component_loadings": loadings,
    "rolling_eigenvalues": eigenvalues, "rolling_dependence": dependence, "portfolio_weights": weights, "scheme_weights_ewma": weights, "portfolio_backtest": curve,
    "allocator_backtest": curve, "allocator_schedule": schedule, "rolling_optimal_fraction": fraction, "monte_carlo_iid": simulated, "monte_carlo_stationary": simulated,
    "monte_carlo_semiparametric": simulated, "permutation_test": permuted, "tail_value_at_risk": tails, "detected_regimes": regimes, "ensemble_regimes": regimes,
    "calibrated_metrics": calibrated, "feature_votes": votes, "learned_search": search, "stability_study": study, "risk_model_pilot": models, "trial_importance": importance,
    "spring_signals": signals, "zone_entries": zones, "optimal_difference": differences,
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_properties(spark, returns, vectors, name):
    CHECKS[name](registry.queries()[name](spark, SF).toPandas(), returns, vectors)


def test_covariances_agree_with_numpy(spark, returns):
    names, m = RK.matrix(RK.sample_covariance(daily_returns(spark, SF)))
    assert names == list(returns.columns) and np.allclose(m, np.cov(returns.fillna(0.0).to_numpy(), rowvar=False))


def test_ewma_starts(spark, returns):
    """Both starts over the table are those of the matrix of rows."""
    for start in ("sample", "diagonal"):
        _, m = RK.matrix(RK.ewma_covariance(daily_returns(spark, SF), start=start))
        assert np.allclose(m, RK.ewma_matrix(returns.to_numpy(), start=start), atol=1e-12)
    few = np.array([[0.01, -0.02], [0.03, 0.01], [0.0, 0.02]])
    assert not np.allclose(RK.ewma_matrix(few), RK.ewma_matrix(few, start="diagonal"))
    with pytest.raises(ValueError):
        RK.ewma_covariance(daily_returns(spark, SF), start="other")

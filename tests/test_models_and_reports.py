"""Models that know no future, weights under every risk model, persistence, and report operators without SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark.operators import learning as L
from tidemark.operators import portfolio as PF
from tidemark.operators import regimes as G
from tidemark.operators import reports as RP
from tidemark.operators import risk as RK
from tidemark.operators import search as SE
from tidemark.operators import simulation as SI
from tidemark.operators import studies
from tidemark.sources import files

SF = f"{DATA}/sf0.001"


@pytest.fixture
def bars_frame():
    rng = np.random.default_rng(3)
    state = np.repeat(rng.integers(0, 3, 30), 20)
    x = rng.normal(state, 0.4)
    return pd.DataFrame({"symbol": "s|1", "ts": pd.date_range("2024-01-01", periods=600, freq="h"), "close": 100 + x, "a": x, "b": rng.normal(size=600) + 0.5 * state, "state": state})


@pytest.mark.parametrize("ensemble", [0, 4])
def test_later_bars_change_no_regime_before_them(spark, bars_frame, ensemble):
    df = spark.createDataFrame(bars_frame)
    options = {"names": ["a", "b"], "train_until": "2024-01-13 12:00:00", "ensemble": ensemble}
    whole = G.detect(df, **options).toPandas().sort_values("ts", ignore_index=True)
    head = G.detect(df.where("ts < '2024-01-20'"), **options).toPandas().sort_values("ts", ignore_index=True)
    assert len(head) < len(whole) and whole.iloc[: len(head)].equals(head)
    assert whole.fitted.sum() == 301 and set(whole.next_regime) <= {0, 1, 2}
    if not ensemble:
        late = ~whole.fitted
        assert (whole.regime[late] == bars_frame.state[late]).mean() > 0.85
        # stays are long: the regime now is mostly the next one
        assert (whole.next_regime[:-1].to_numpy() == bars_frame.state[1:].to_numpy()).mean() > 0.75


def test_next_regime_learns_its_chain():
    rng = np.random.default_rng(5)
    regime, x = [0], rng.normal(size=(2000, 2))
    for i in range(1999):  # the first feature says where it goes
        regime.append((regime[-1] + (1 if x[i, 0] > 0 else 0)) % 3)
    regime = np.array(regime)
    model = G.NextRegime(3).fit(regime[:1500], x[:1500])
    path, sure = model.walk(int(regime[1500]), x[1500:1999])
    told = np.array([model.predict(int(regime[i]), x[i]).argmax() for i in range(1500, 1999)])
    assert (told == regime[1501:]).mean() > 0.8 and len(path) == 499
    stays, _ = model.walk(1, x[1500:1600], gate=1.1)
    assert (stays == 1).all() and (sure > 1 / 3).all()


@pytest.mark.parametrize("model", list(RK.MODELS))
def test_risk_models_reach_every_scheme(spark, model):
    rng = np.random.default_rng(2)
    days = pd.date_range("2023-01-02", periods=300, freq="D")
    wide = pd.DataFrame(rng.normal(0.0005, [0.005, 0.01, 0.02], (300, 3)), index=days, columns=list("abc"))
    tall = wide.stack().rename("ret").rename_axis(["ts", "asset"]).reset_index()
    returns, dates = spark.createDataFrame(tall), spark.createDataFrame([(days[-1].to_pydatetime(),)], "ts timestamp")
    found = PF.weights_at(returns, dates, risk_model=model).toPandas()
    sums = found.groupby("strategy").weight.sum()
    assert set(sums.index) == set(PF.STRATEGIES) and np.allclose(sums, 1) and (found.weight > -1e-9).all()
    x = wide.iloc[47:-1].to_numpy()  # the 252 rows before the date
    own = RK.MODELS[model](x)
    w = found[found.strategy == "inverse_vol"].set_index("asset").weight.reindex(list("abc")).to_numpy()
    want = 1 / np.sqrt(np.diag(own))
    assert np.allclose(w, want / want.sum())
    other = PF.weights_at(returns, dates, strategies=("minimum_variance",), risk_model=model, denoising="shrinkage").toPandas()
    assert abs(other.weight.sum() - 1) < 1e-9


def test_risk_matrices_against_their_aggregates(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.01, (120, 3))
    x[rng.random((120, 3)) < 0.1] = np.nan
    days = pd.date_range("2024-01-01", periods=120, freq="D")
    tall = pd.DataFrame(x, index=days, columns=list("abc")).stack(future_stack=True).rename("ret").rename_axis(["ts", "asset"]).reset_index()
    df = spark.createDataFrame([(t.to_pydatetime(), a, None if v != v else v) for t, a, v in tall.itertuples(index=False)], "ts timestamp, asset string, ret double")
    for matrix, work in ((RK.sample_matrix, RK.sample_covariance), (RK.pairwise_matrix, RK.pairwise_covariance), (RK.ewma_matrix, RK.ewma_covariance)):
        _, m = RK.matrix(work(df))
        assert np.allclose(matrix(x), m, atol=1e-12), matrix.__name__


def test_hold_against_a_loop(spark):
    rng = np.random.default_rng(7)
    days = pd.date_range("2024-01-01", periods=60, freq="D").to_pydatetime().tolist()
    rows = [(d, a, float(rng.normal())) for d in days for a in "xyz" if rng.random() > 0.2]
    plans = [(days[k], s, a, float(rng.random())) for k in (5, 20, 41) for s in ("p", "q") for a in "xyz"]
    held = PF.hold(spark.createDataFrame(rows, "ts timestamp, asset string, ret double"), spark.createDataFrame(plans, "date timestamp, strategy string, asset string, weight double")).collect()
    want: dict = {}
    for d, a, ret in rows:
        for s in ("p", "q"):
            past = [p for p in plans if p[1] == s and p[2] == a and p[0] <= d]
            if past:
                want[s, d] = want.get((s, d), 0.0) + past[-1][3] * ret
    assert len(held) == len(want) and all(abs(want[r.strategy, r.ts] - r.ret) < 1e-12 for r in held)


def test_allocator_schedule_knows_no_future(spark):
    rng = np.random.default_rng(33)
    days = pd.date_range("2023-01-02", periods=500, freq="B")
    tall = pd.DataFrame(rng.normal(0.0004, 0.01, (500, 3)), index=days, columns=["S1", "S2", "S3"]).stack().rename("ret").rename_axis(["ts", "asset"]).reset_index()
    df, start = spark.createDataFrame(tall), "2024-01-01"
    base = {"S1": 0.5, "S2": 0.3, "S3": 0.2}
    whole = PF.allocate(df, start, base).toPandas()
    early = PF.allocate(df.where("ts < '2024-06-01'"), start, base).toPandas()
    assert (whole.date >= start).all() and whole.groupby("date").weight.sum().sub(1).abs().max() < 1e-9
    assert (whole.weight <= 0.7 + 1e-9).all() and (whole.groupby("date").moved.first().iloc[1:] <= 0.1 + 1e-9).all()
    both = early.merge(whole, on=["date", "asset"], suffixes=("", "_whole"))
    assert len(both) == len(early) and np.allclose(both.weight, both.weight_whole)
    assert whole.multiplier.nunique() > 10 and np.allclose(PF.allocate(df, start, base, leverage=2.0).toPandas().weight, 2 * whole.weight)
    state = PF.RiskAllocator().fit({"S1": rng.normal(size=200)}).snapshot()
    assert state["S1"]["multiplier"] == 1.0 and len(state["S1"]["expected"]) == 4


def test_models_are_written_and_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    p = np.clip(y * 0.6 + 0.2 + 0.1 * rng.normal(size=400), 0.01, 0.99)
    models = [
        (L.Calibrator("stacking").fit(p, y), lambda m: m.transform(p)), (L.boosted_trees(x, y, trees=10)[0], lambda m: m(x)), (L.bagged(x, y, 3, trees=5), lambda m: m.predict(x, 0.4)),
        (G.HiddenMarkov(2).fit(x), lambda m: m.filtered(x)), (G.Ensemble(3).fit(x), lambda m: m.filtered(x)),
    ]
    for k, (model, use) in enumerate(models):
        files.save_model(spark, model, f"{tmp_path}/{k}")
        again = files.load_model(spark, f"{tmp_path}/{k}")
        assert type(again) is type(model) and np.allclose(use(again), use(model))
    assert models[4][0].convergence().shape == (3, 4)


def test_importance_finds_what_matters():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 5))
    y = (x[:, 2] + 0.2 * rng.normal(size=600) > 0).astype(float)
    model, _ = L.boosted_trees(x, y, trees=20)
    assert L.impurity_importance(x, y, 4)["mean"].idxmax() == 2
    whole, inside = L.clustered_importance(model, x, y, [[0, 1], [2, 3], [4]], top=1)
    assert whole["mean"].idxmax() == 1 and inside.sort_values("mean").feature.iloc[-1] == 2 and set(inside.feature) == {2, 3}
    best = L.tuned(x, y, {"depth": [1, 3], "trees": [5, 20], "rate": [0.1, 0.3]}, trials=6)
    assert best.loss.is_monotonic_increasing and len(best) == 6


def test_fitted_t_and_drawn_fraction():
    rng = np.random.default_rng(8)
    freedom, centre, scale = PF.fit_t(0.001 + 0.01 * rng.standard_t(4, 20_000))
    assert 3.4 < freedom < 4.8 and abs(centre - 0.001) < 3e-4 and abs(scale - 0.01) < 5e-4
    x = rng.normal(0.002, 0.01, 2000)
    assert PF.drawn_fraction(x, draws=20_000) == PF.drawn_fraction(x, draws=20_000) > 0
    assert PF.drawn_fraction(-np.abs(x)) == 0.0 and PF.drawn_fraction(np.abs(x)) == 0.0 and PF.drawn_fraction(np.zeros(5)) == 0.0
    shares = PF.diagnose(rng.normal(0, 0.01, (200, 4)), "hrp")
    assert len(shares) == 5 and abs(shares.share.sum() - 1) < 1e-9


def test_gram_of_ragged_tasks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(5, 2, (101, 7))
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,)], "v array<double>").repartition(5)
    corr = {(r.i, r.j): r.corr for r in RK.vector_correlation(df, "v").collect()}
    want = np.corrcoef(x.T)
    assert len(corr) == 49 and all(abs(corr[i, j] - want[i, j]) < 1e-12 for i, j in corr)
    z = RK.project(df.where("v is not null"), "v", want, x.mean(axis=0), x.std(axis=0), 2).select("scores").toPandas().scores
    assert abs(np.var(np.vstack(z)[:, 0]) - np.linalg.eigvalsh(want)[-1]) < 1e-9
    empty = df.where("v is null")
    assert RK.vector_correlation(empty, "v").count() == 0


def test_redundant_features_leave_two(spark):
    rows = [(k, k // 4, 0.1 * (k % 4)) for k in range(12)]
    gone = RK.redundant(spark.createDataFrame(rows, "feature int, cluster int, silhouette double")).collect()
    assert sorted(r.feature for r in gone) == [0, 1, 4, 5, 8, 9]
    votes = spark.createDataFrame([(1, 3), (2, 5), (3, 9)], "feature int, votes int")
    assert {r.feature for r in RP.near_threshold(votes, "votes", 4, 1).collect()} == {1, 2}


def test_learned_search_finds_the_best_value(spark):
    rng = np.random.default_rng(0)
    space = {"a": list(range(6)), "b": list(range(6))}
    history: list = []
    for _ in range(12):
        history += [(p, -((p["a"] - 4) ** 2) - (p["b"] - 1) ** 2) for p in SE.propose(history, space, 8, rng)]
    assert max(v for _, v in history) == 0
    late = [v for _, v in history[-24:]]
    assert np.mean(late) > np.mean([v for _, v in history[:16]])


def test_real_path_has_its_place_among_simulations(spark):
    df = spark.createDataFrame([("x", k, float(np.sin(k) / 50)) for k in range(120)], "asset string, ts int, ret double")
    sims = SI.monte_carlo(df, "asset", "ret", ["ts"], "stationary", paths=60, batch=20)
    found = {r.metric: r for r in SI.summarise(sims, "asset", SI.real_path(df, "asset", "ret", ["ts"])).collect()}
    values = [r.max_drawdown for r in sims.collect()]
    real = found["max_drawdown"].real
    assert abs(found["max_drawdown"].rank - np.mean([0.5 * (v == real) + (v < real) for v in values])) < 1e-12
    assert all(0 <= r.rank <= 1 for r in found.values())


def test_tree_importance(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(3 * a)) for a, b in rng.integers(0, 9, (200, 2))]
    found = {r.parameter: r.importance for r in RP.tree_importance(spark.createDataFrame(rows, "a double, b double, score double"), ["a", "b"]).collect()}
    assert found["a"] > 0.95 and abs(sum(found.values()) - 1) < 1e-9
    few = RP.tree_importance(spark.createDataFrame(rows[:5], "a double, b double, score double"), ["a", "b"]).collect()
    assert [r.importance for r in few] == [0.0, 0.0]


def test_cohesion_falls_where_a_feature_belongs():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 2))
    x = np.column_stack([base[:, [0]] + 0.3 * rng.normal(size=(500, 3)), base[:, [1]] + 0.3 * rng.normal(size=(500, 2)), rng.normal(size=(500, 1))])
    found = {j: loss for j, _, loss in RK.cohesion_loss(x, [[0, 1, 2], [3, 4, 5]])}
    assert min(found[j] for j in (0, 1, 2)) > 0.4 and abs(found[5]) < 0.1 < found[3]
    assert RK.cohesion_loss(x, [[0]]) == [(0, 0, 0.0)]


def test_detoned_correlation_has_no_market():
    rng = np.random.default_rng(4)
    market = rng.normal(size=(400, 1))
    first, second = rng.normal(size=(2, 400, 1))
    x = 0.8 * market + np.column_stack([first] * 4 + [second] * 4) + 0.5 * rng.normal(size=(400, 8))
    r = np.corrcoef(x.T)
    clean = RK.detone(r, 400)
    off = ~np.eye(8, dtype=bool)
    assert np.allclose(np.diag(clean), 1) and np.allclose(clean, clean.T) and r[off].mean() > 0.3 and abs(clean[off].mean()) < 0.25
    assert clean[:4, :4][~np.eye(4, dtype=bool)].min() > clean[4:, :4].max()


def test_gates_and_bets(spark):
    df = spark.createDataFrame([(0.2,), (0.6,), (0.8,), (None,)], "p double")
    assert [(r.gate_col, round(r.bet_col, 6)) for r in L.gate_and_bet(df, "p", 0.6).collect()] == [(0, 0.0), (1, 0.0), (1, 0.5), (0, 0.0)]


def test_pilot_from_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    days = pd.date_range("2022-01-03", periods=400, freq="B")
    pd.DataFrame(rng.normal(0.0004, [0.005, 0.01, 0.02], (400, 3)), index=days, columns=list("abc")).rename_axis("time").to_csv(tmp_path / "returns.csv")
    (tmp_path / "config.json").write_text('{"unit": "MONTH", "lookback": 120}')
    found = studies.pilot_from_files(spark, str(tmp_path / "returns.csv"), str(tmp_path / "out"), str(tmp_path / "config.json")).toPandas()
    assert sorted(found.strategy) == ["garch", "marchenko_pastur", "sample", "shrinkage"] and found.total_return.notna().all()


def test_suite_in_local_time(spark, bars_frame):
    one = bars_frame.assign(open=bars_frame.close, high=bars_frame.close, low=bars_frame.close, volume=1.0)[["symbol", "ts", "open", "high", "low", "close", "volume"]]
    bars = spark.createDataFrame(one)
    plain, local = (studies.suite(bars, {"hold": SE.buy_and_hold}, {"1d": "1 day"}, timezone=z).toPandas() for z in ("UTC", "Europe/Berlin"))
    assert len(plain) == len(local) == 1 and plain.sharpe[0] != local.sharpe[0]


def test_importances_side_by_side():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 4))
    y = (x[:, 1] + 0.3 * rng.normal(size=500) > 0).astype(float)
    table = L.importance_table(x, y)
    assert all(table[k].idxmax() == 1 for k in ("gain", "loss", "alone"))
    same = L.agreement(np.arange(5.0), np.arange(5.0), 2)
    assert same["pearson"] == pytest.approx(1) and same["kendall"] == pytest.approx(1) and same["shared"] == 1
    assert L.agreement(np.arange(5.0), -np.arange(5.0), 2)["shared"] == 0 and L.agreement(np.ones(3), np.arange(3.0))["pearson"] == 0
    both, how = L.gain_and_spectrum(x, y)
    assert list(both.columns) == ["feature", "gain", "spectral"] and set(how) == {"pearson", "kendall", "shared"}


def test_component_thresholds():
    rng = np.random.default_rng(13)
    base = rng.normal(size=(300, 2))
    x = np.column_stack([base @ rng.normal(size=(2, 6)) + 0.05 * rng.normal(size=(300, 6)), rng.normal(size=(300, 1))])
    rows = RK.pca_thresholds(x, [0.01, 0.1], [0.2, 0.4, 0.9])
    assert len(rows) == 6 and rows[0]["retained"] >= 0.9 and rows[0]["efficiency"] == max(r["efficiency"] for r in rows if r["retained"] >= 0.9)
    assert RK.retained(x, np.ones(7, dtype=bool)) == pytest.approx(1) and RK.retained(x, np.zeros(7, dtype=bool)) == 0
    assert sorted(RK.pca_remove(x) + np.flatnonzero(RK.pca_keep(x)).tolist()) == list(range(7))

"""Ensembles of hidden Markov models: planted regimes, rejected members, matched states, and what later rows may change."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ensembles as E
from tidemark.operators.regimes import HiddenMarkov

NAMES = [f"f{k}" for k in range(5)]
SPEC = E.EnsembleSpec(members=9, block=2, span=5, rounds=60, least_features=2, most_features=4, train_share=0.6)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(8)
    out = []
    for symbol in ("x", "y"):
        truth = np.repeat([0, 1, 0, 1, 0, 1], 60)
        x = rng.standard_normal((360, 5)) * 0.5 + np.outer(truth, [3, -2, 2, 1, -3])
        x[7, 1] = np.nan
        ts = pd.date_range("2024-01-01", periods=360, freq="h")
        out.append(pd.DataFrame(x, columns=NAMES).assign(symbol=symbol, ts=ts, close=100.0 + truth, truth=truth))
    return spark.createDataFrame(pd.concat(out)).repartition(4)


@pytest.fixture(scope="module")
def models(bars):
    return E.fit_members(bars, NAMES, SPEC)


def frame(df):
    return df.orderBy("symbol", "ts").toPandas()


def test_members_spread_and_find_planted_regimes(bars, models):
    got = models.toPandas()
    assert sorted(zip(got.symbol, got.member, strict=True)) == [(s, m) for s in "xy" for m in range(9)]
    assert (got.block == got.member // 2).all() and all(2 <= len(f) <= 4 for f in got.features)
    # one member is one fit, whatever block it is in
    x, head = SPEC.prepared(frame(bars.where("symbol = 'x'")), NAMES)
    alone = E.fit_member(SPEC, 3, x[:head])
    there = got[(got.symbol == "x") & (got.member == 3)].iloc[0]
    assert there.status == alone["status"] and there.likelihood == pytest.approx(alone["likelihood"])
    found = frame(E.ensemble_regimes(bars, NAMES, SPEC, models).join(bars.select("symbol", "ts", "truth"), ["symbol", "ts"]))
    assert len(found) == 720 and (found.regime == found.truth).mean() > 0.95 and (found.members > 4).all()


def test_a_bad_member_changes_nothing(spark, bars, models):
    """Members that are rejected have no say, whatever their state holds; and are counted."""
    want = frame(E.ensemble_regimes(bars, NAMES, SPEC, models))
    row = models.where("status = 'kept'").first().asDict()
    garbage = json.dumps(json.loads(row["state"]) | {"means": [[9.0] * len(row["features"])] * 2})
    bad = [row | {"member": 100 + k, "status": s, "state": garbage, "signature": [float(-k)] * 10} for k, s in enumerate(("failed", "not converged", "unstable"))]
    more = models.unionByName(spark.createDataFrame(bad, models.schema))
    pd.testing.assert_frame_equal(frame(E.ensemble_regimes(bars, NAMES, SPEC, more)), want)
    counts = {r.symbol: r for r in E.rejections(more).collect()}[row["symbol"]]
    assert (counts.failed, counts.not_converged) >= (1, 1) and counts.unstable >= 1
    assert counts.members == 12 == counts.kept + counts.failed + counts.not_converged + counts.unstable


def test_few_rounds_reject_all_and_leave_null_regimes(bars):
    short = E.EnsembleSpec(members=3, rounds=1, span=5)
    models = E.fit_members(bars, NAMES, short)
    assert {r.status for r in models.collect()} == {"not converged"}
    found = E.ensemble_regimes(bars, NAMES, short, models)
    assert found.count() == 720 and found.where("regime is null and confidence is null and members = 0").count() == 720
    after = E.expected_next(bars, NAMES, found, short)
    assert after.where("next_regime is null").count() == 720


def test_states_turned_round_are_matched(spark, bars, models):
    """Renaming the states of some members gives the same regimes."""
    want = frame(E.ensemble_regimes(bars, NAMES, SPEC, models))
    turned = models.toPandas()
    for i in turned.index[turned.member % 2 == 1]:
        s = json.loads(turned.at[i, "state"])
        for k in ("start", "means", "covs"):
            s[k] = s[k][::-1]
        s["moves"] = [r[::-1] for r in s["moves"][::-1]]
        turned.at[i, "state"] = json.dumps(s)
        turned.at[i, "signature"] = np.array(turned.at[i, "signature"]).reshape(2, -1)[::-1].ravel().tolist()
    got = frame(E.ensemble_regimes(bars, NAMES, SPEC, spark.createDataFrame(turned, models.schema)))
    assert (got.regime == want.regime).all()
    np.testing.assert_allclose(got.confidence, want.confidence, atol=1e-9)


def test_assignment_of_many_states():
    rng = np.random.default_rng(9)
    for k in (2, 5, 7, 10):
        middle = rng.standard_normal((k, 4)) * 10
        order = rng.permutation(k)
        assert (E.nearest_order(middle[np.argsort(order)] + 0.01 * rng.standard_normal((k, 4)), middle) == order).all()


def test_later_rows_change_nothing_before_them(bars):
    spec = E.EnsembleSpec(members=4, block=2, span=5, rounds=60, train_until="2024-01-08 12:00:00")
    cut = bars.where("ts < '2024-01-13'")
    whole = E.ensemble_regimes(bars, NAMES, spec).where("ts < '2024-01-13'")
    pd.testing.assert_frame_equal(frame(whole), frame(E.ensemble_regimes(cut, NAMES, spec)))


def test_weights_and_subsets():
    counts = {w: np.mean([len(E.EnsembleSpec(weights=w).subset(m, 20)) for m in range(2000)]) for w in ("uniform", "linear", "exponential", "quadratic")}
    assert counts["uniform"] > counts["linear"] > counts["quadratic"] and counts["uniform"] > counts["exponential"]
    assert E.EnsembleSpec().subset(1, 2) == [0, 1]


def test_stay_and_floor():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((300, 2)) * 0.01
    m = HiddenMarkov(2, spherical=True, floor=0.05, stay=0.85).fit(x)
    assert (np.diag(m.moves) >= 0.85 - 1e-12).all() and np.allclose(m.moves.sum(axis=1), 1)
    assert np.allclose(m.covs, [0.05 * np.eye(2)] * 2)


def test_empty(bars):
    none = bars.limit(0)
    models = E.fit_members(none, NAMES, SPEC)
    assert models.count() == 0 and E.ensemble_regimes(none, NAMES, SPEC, models).count() == 0
    assert E.rejections(models).agg(F.count("*")).first()[0] == 0

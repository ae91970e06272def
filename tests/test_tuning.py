"""Pruned search over purged paths against the full run on one array."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import learning as L
from tidemark.operators import tuning as T

SPACE = {"depth": [1, 3], "trees": [3, 12], "rate": [0.01, 0.3]}


def data(n=600):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((n, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int) ^ (rng.random(n) < 0.05)
    return x, y.astype(int)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data()
    return spark.createDataFrame([(i, float(i), int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, t double, label int, x array<double>").repartition(5)


def test_paths_are_purged(rows):
    got = T.purged_paths(rows, 4, embargo=7.0).toPandas()
    for _, p in got.groupby("path"):
        test, train = set(p[p.role == "test"].id), set(p[p.role == "train"].id)
        low, high = min(test), max(test)
        assert test == set(range(low, high + 1)) and train == {i for i in range(600) if i < low - 7 or i > high + 7}
    assert sorted(got[got.role == "test"].id) == list(range(600))


def test_scores():
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert T.score("auc", y, p) == pytest.approx(np.mean(pairs))
    said = p >= 0.5
    assert T.score("f1", y, p) == pytest.approx(2 * (said & (y == 1)).sum() / (said.sum() + y.sum()))
    assert T.score("accuracy", y, p) == (said == y).mean() and T.score("auc", np.ones(3), p[:3]) is None and T.score("f1", y[:0], p[:0]) is None
    with pytest.raises(ValueError):
        T.score("other", y, p)


def full_run(bounds, gap):
    """Objectives of all settings on all rows, by loops over one array."""
    x, y = data()
    out = {}
    for t, options in enumerate(T.grid(SPACE)):
        tests, trains = [], []
        for low, high in zip(bounds, bounds[1:], strict=False):
            test = np.zeros(600, dtype=bool)
            test[low:high] = True
            model, _ = L.boosted_trees(x[~test], y[~test], **options)
            tests.append(T.score("neg_log_loss", y[test], model(x[test])))
            trains.append(T.score("neg_log_loss", y[~test], model(x[~test])))
        out[t] = np.mean(tests) - 0.5 * np.std(tests) - gap * max(np.mean(trains) - np.mean(tests), 0)
    return out


def test_full_grid_and_halving(rows):
    """On all rows the objectives are those of the full run; halving fits less and finds the same winner."""
    assigned, trials, gap = T.purged_paths(rows, 4), T.grid(SPACE), 0.1
    test_ids = assigned.where("role = 'test'").toPandas().groupby("path").id.agg(["min", "max"])
    assert abs(test_ids["min"].to_numpy() - np.array([0, 150, 300, 450])).max() <= 1
    want = full_run([*test_ids["min"], 600], gap)
    scores, whole = T.halving(assigned, trials, shares=[1.0], gap=gap)
    got = {r.trial: r.objective for r in whole.collect()}
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)
    pruned_scores, pruned = T.halving(assigned, trials, gap=gap, per_task=3)
    fits = pruned_scores.groupBy("rung").count().orderBy("rung").collect()
    assert [r["count"] for r in fits] == [32, 16, 8]
    work = sum(r.rows for r in pruned_scores.collect())
    assert work < 0.8 * sum(r.rows for r in scores.collect())
    table = pruned.toPandas().sort_values("place")
    best = max(want, key=want.get)
    assert table.trial.iloc[0] == best == whole.where("place = 1").first().trial and json.loads(table.params.iloc[0]) == trials[best]
    assert sorted(table.trial) == list(range(8)) and table.rung.is_monotonic_decreasing
    shares = pruned_scores.toPandas().groupby("rung").rows.mean()
    assert abs(shares[0] / 450 - 0.25) < 0.06 and abs(shares[1] / 450 - 0.5) < 0.06


def test_bound_on_rows(rows):
    _, table = T.halving(T.purged_paths(rows, 3), T.grid(SPACE)[:2], shares=[1.0], rows=100)
    scores, _ = T.halving(T.purged_paths(rows, 3), T.grid(SPACE)[:2], shares=[1.0], rows=100)
    assert table.count() == 2 and all(50 < r.rows < 150 for r in scores.collect())


def test_learning_curve(rows):
    got = T.learning_curve(T.purged_paths(rows, 3), {"trees": 12, "rate": 0.3}, shares=[0.1, 0.5, 1.0]).toPandas().sort_values("share")
    assert got.rows.is_monotonic_increasing and got.test.iloc[2] > got.test.iloc[0] and got.train.iloc[0] - got.test.iloc[0] > got.train.iloc[2] - got.test.iloc[2]


def test_draws_nulls_and_one_label(spark, rows):
    assert len({json.dumps(d) for d in T.draws(SPACE, 8)}) == 8 == len(T.draws(SPACE, 100))
    assert len(T.draws({str(k): list(range(10)) for k in range(9)}, 5)) == 5
    odd = spark.createDataFrame([(i, None if i == 3 else datetime(2024, 1, 1) + timedelta(days=i), None if i == 5 else 1, [1.0]) for i in range(40)], "id long, t timestamp, label int, x array<double>")
    assigned = T.purged_paths(odd, 2, embargo=86400.0)
    assert assigned.where("role = 'test'").count() == 38
    _, table = T.halving(assigned, [{"trees": 2}], shares=[1.0])
    assert [r.objective for r in table.collect()] == [None]
    assert T.purged_paths(odd.limit(0), 3).count() == 0

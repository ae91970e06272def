"""Boosting over partitioned rows against the version on one array; losses, early stop, metrics and importance inside the plan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import boosting as B
from tidemark.operators import learning as L
from tidemark.sources import views


def data(seed=12, n=1500, width=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 - x[:, 2] * (x[:, 0] > 0) + 0.7 * rng.standard_normal(n) > 0.3).astype(int)
    return x, y, np.where(np.arange(n) % 5 == 4, "dev", np.where(np.arange(n) % 7 == 6, "test", "train"))


def table(spark, x, y, part):
    return spark.createDataFrame([(i, int(b), a.tolist(), str(p)) for i, (a, b, p) in enumerate(zip(x, y, part, strict=True))], "id long, label int, x array<double>, part string")


def shape(tree):
    return round(tree, 5) if not isinstance(tree, tuple) else (tree[0], tree[1], shape(tree[2]), shape(tree[3]))


@pytest.mark.parametrize("parts", [1, 7])
def test_trees_equal_those_of_one_array(spark, parts):
    x, y, part = data()
    rows = table(spark, x, y, part).repartition(parts)
    got = B.boost(rows, 5, watch=None, trees=6, keep=2)
    own = part == "train"
    want, gain = L.boosted_trees(x[own], y[own], trees=6, edges=got.forest.edges)
    assert list(map(shape, got.forest.trees)) == list(map(shape, want.trees)) and got.forest.base == pytest.approx(want.base)
    np.testing.assert_allclose(got.gain, gain, atol=1e-5)
    # losses of all rounds and parts
    for done, name, loss in got.losses:
        p = L.Forest(want.edges, want.base, want.trees[:done])(x[part == name]) if done else np.full((part == name).sum(), 1 / (1 + np.exp(-want.base)))
        assert loss == pytest.approx(B.log_loss(y[part == name], p).mean(), abs=1e-6)
    assert {(r, p) for r, p, _ in got.losses} == {(r, p) for r in range(7) for p in ("train", "dev", "test")}
    assert all(len(e) >= 25 for e in got.forest.edges)


def test_trees_of_the_embeddings(spark):
    folder = f"{DATA}/sf0.01"
    rows = views.vectors(spark, folder)
    got = B.boost(rows, 64, watch=None, trees=3)
    pdf = rows.where("part = 'train'").toPandas()
    want, _ = L.boosted_trees(np.vstack(pdf.x.to_numpy()), pdf.label.to_numpy(dtype=float), trees=3, edges=got.forest.edges)
    assert list(map(shape, got.forest.trees)) == list(map(shape, want.trees))


def test_early_stop(spark):
    """Labels without any sense in the dev part: its loss only rises, and no tree is kept beyond the best round."""
    x, y, part = data(n=600)
    y = np.where(part == "dev", np.random.default_rng(1).integers(0, 2, len(y)), y)
    got = B.boost(table(spark, x, y, part), 5, trees=40, rate=0.5, patience=3)
    dev = [loss for _, p, loss in got.losses if p == "dev"]
    assert len(dev) < 41 and got.best_round == int(np.argmin(dev)) == len(got.forest.trees) and len(dev) == got.best_round + 4
    train = [loss for _, p, loss in got.losses if p == "train"]
    assert train == sorted(train, reverse=True)


def test_predictions_and_metrics(spark):
    x, y, part = data()
    rows = table(spark, x, y, part)
    got = B.boost(rows, 5, trees=8)
    p = got.forest(x)
    found = B.predict(rows, got.forest)
    np.testing.assert_allclose([r.p for r in found.orderBy("id").collect()], p, atol=1e-12)
    for r in B.split_metrics(found).collect():
        own = part == r.part
        said, true = p[own] >= 0.5, y[own] == 1
        hit = (said & true).sum()
        assert (r.n, r.positive, r.negative) == (own.sum(), true.sum(), (~true).sum())
        assert r.accuracy == pytest.approx((said == true).mean()) and r.precision == pytest.approx(hit / said.sum()) and r.recall == pytest.approx(hit / true.sum())
        assert r.f1 == pytest.approx(2 * hit / (said.sum() + true.sum())) and r.log_loss == pytest.approx(B.log_loss(y[own], p[own]).mean())


@pytest.mark.parametrize("block_rows", [200, 100_000])
def test_importance_agrees_with_one_array(spark, block_rows):
    x, y, part = data()
    rows = table(spark, x, y, part).repartition(5)
    forest = B.boost(rows, 5, trees=15).forest
    got = {r.group: r for r in B.permutation_importance(rows, forest, repeats=8, block_rows=block_rows).collect()}
    want = L.permutation_importance(forest, x, y, repeats=8)
    for r in want.itertuples():
        assert got[r.feature].mean == pytest.approx(r.mean, abs=0.03 + 3 * (r.se + got[r.feature].se))
    assert max(got, key=lambda k: got[k].mean) == 0 and got[3].mean < 0.01
    base = B.permutation_losses(rows, forest, [[0]], 2, block_rows).collect()
    assert [r.n for r in base] == [1500, 1500] and all(r.base == pytest.approx(B.log_loss(y, forest(x)).mean(), abs=1e-6) for r in base)


def test_clusters_and_shift(spark):
    x, y, part = data()
    rows = table(spark, x, y, part)
    forest = B.boost(rows, 5, trees=15).forest
    got = B.clustered_importance(rows, forest, [[0, 2], [1], [3, 4]], repeats=4, top=1).toPandas()
    whole, inside = got[got.feature.isna()], got[got.feature.notna()]
    assert len(whole) == 3 and whole.set_index("cluster")["mean"].idxmax() == 0 and sorted(inside.feature) == [0, 2]
    train, dev = (B.permutation_importance(rows.where(F.col("part") == p), forest, repeats=4) for p in ("train", "dev"))
    shift = B.importance_shift(train, dev).toPandas()
    assert len(shift) == 5 and shift.rank_correlation.iloc[0] > 0.5 and sorted(shift.train_rank)[0] == 1
    worse = B.importance_shift(train, dev.withColumn("mean", F.col("mean") * 0.1)).toPandas()
    assert worse[worse.train_mean > 0].dropped.all()


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, None], "train"), (2, 0, None, "train"), (3, None, [1.0, 2.0], "train"), (4, 1, [float("nan"), 2.0], "dev")] * 15, "id long, label int, x array<double>, part string")
    got = B.boost(rows, 2, trees=2)
    assert B.predict(rows, got.forest).count() == 60
    with pytest.raises(ValueError):
        B.boost(rows.limit(0), 2)

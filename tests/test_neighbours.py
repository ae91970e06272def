"""Nearest-neighbour information against brute force, on grids of many cells and of one, with ties, gaps and hot values."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import information, neighbours
from tidemark.plans import registry
from tidemark.sources import views


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(x, y, k=3):
    """All distances of all pairs of rows."""
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    reach = np.sort(joint, axis=1)[:, k - 1][:, None]
    return max(0.0, psi(k) + psi(len(x)) - np.mean([psi(a) + psi(b) for a, b in zip((dx < reach).sum(1), (dy < reach).sum(1), strict=True)]))


def wide(features):
    return neighbours._scaled(features).groupBy("id").pivot("feature").agg(F.first("v")).toPandas()


def test_digamma():
    n = np.arange(1.0, 200.0)
    np.testing.assert_allclose(neighbours.digamma(n, np.log), [psi(int(i)) for i in n], atol=1e-10)


def test_nearest_distances():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 70, 500):
        p, q = rng.standard_normal((n, 2)), rng.standard_normal((40, 2)) * 3
        p[: n // 3] = p[0] if n else 0
        for own in (True, False):
            d = np.abs((p if own else q)[:, None, :] - p[None, :, :]).max(axis=2)
            if own:
                np.fill_diagonal(d, np.inf)
            want = np.sort(np.concatenate([d, np.full((len(d), 3), np.inf)], axis=1), axis=1)[:, :3]
            np.testing.assert_array_equal(neighbours.nearest_distances(p, p if own else q, 3, own), want)


@pytest.mark.parametrize("chunk,candidates", [(neighbours.CHUNK, neighbours.CANDIDATES), (64, 7)])
def test_nearest_inside(monkeypatch, chunk, candidates):
    """Strips and windows against all distances: even, tied, repeated, clustered, dependent and heavy-tailed points."""
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "CANDIDATES", candidates)
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 4, 37, 700):
        x, z = rng.standard_normal((2, n))
        tiny = 1e-10 * rng.random((2, n))
        spreads = [(x, z), (x, x + 1e-3 * z), (np.round(x, 1), np.round(z, 1)), (np.where(z < -0.4, 0.0, x) + tiny[0], rng.random(n)), rng.standard_cauchy((2, n)), rng.integers(0, 3, (2, n)) + tiny]
        for a, b in [*spreads, (np.zeros(n), np.zeros(n))]:
            p = np.column_stack((a, b))
            d = np.abs(p[:, None, :] - p[None, :, :]).max(axis=2)
            np.fill_diagonal(d, np.inf)
            for k in (1, 3, 5):
                want = np.sort(np.concatenate([d, np.full((n, k), np.inf)], axis=1), axis=1)[:, :k]
                np.testing.assert_array_equal(neighbours.nearest_inside(p, k), want)


def table(spark, columns):
    rows = [(i, name, None if v != v else float(v)) for name, x in columns.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, feature string, value double").repartition(5)


@pytest.mark.parametrize("cell_rows", [5, 60, 10_000])
def test_equals_brute_force(spark, cell_rows):
    """Independent, dependent, curved, tied and clustered features; the sparse cells of a diagonal; far outliers; a value of a third of all rows."""
    rng = np.random.default_rng(2)
    n = 400
    x = rng.standard_normal(n)
    columns = {
        "a": x, "b": x + 0.01 * rng.standard_normal(n), "c": x**2, "d": np.round(rng.standard_normal(n), 1), "e": np.where(rng.random(n) < 0.35, 0.0, rng.standard_normal(n)),
        "f": np.where(np.arange(n) < 2, 1e4, rng.random(n)), "g": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 3, n)), "flat": np.ones(n),
    }
    features = table(spark, columns)
    got = {(r.i, r.j): r for r in neighbours.neighbour_information(features, cell_rows=cell_rows).collect()}
    w = wide(features)
    names = "abcdefg"
    assert set(got) == {(i, j) for i in names for j in names if i < j}
    for (i, j), r in got.items():
        both = w[[i, j]].dropna()
        assert r.n == len(both)
        assert r.mi == pytest.approx(brute(both[i].to_numpy(), both[j].to_numpy()), abs=1e-9), (i, j)


def test_small_and_empty_tables(spark):
    features = table(spark, {"a": [1.0, 2.0, 4.0], "b": [1.0, 3.0, 2.0]})
    assert neighbours.neighbour_information(features).count() == 0
    assert [r.n for r in neighbours.neighbour_information(features, k=2).collect()] == [3]
    assert neighbours.neighbour_information(features.limit(0)).count() == 0
    assert neighbours.neighbour_matrix(features.limit(0)).count() == 0


def test_repeated_ids_in_packed_pairs_and_in_cells(spark):
    """Every value of an id meets every one of the other feature, whether pairs are packed or cut into cells."""
    rng = np.random.default_rng(6)
    rows = [(int(i), f, float(v)) for f in ("a", "b", "c") for i, v in zip(rng.integers(0, 150, 200), rng.standard_normal(200), strict=True)]
    features = spark.createDataFrame(rows, "id long, feature string, value double").repartition(5)
    got, cells = ({(r.i, r.j): (r.n, r.mi) for r in neighbours.neighbour_information(features, cell_rows=n).collect()} for n in (10_000, 20))
    scaled = neighbours._scaled(features).toPandas()
    for (i, j), (n, mi) in got.items():
        both = scaled[scaled.feature == i].merge(scaled[scaled.feature == j], on="id")
        assert n == len(both) == cells[i, j][0]
        # equal values of one id are equal in their feature's column, too
        assert mi == pytest.approx(brute(both.v_x.to_numpy(), both.v_y.to_numpy()), abs=1e-9), (i, j)
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_pairs_are_packed_and_their_time_grows_with_the_rows(spark):
    """No row per point of a pair is shuffled, and many pairs of some thousand rows end in good time."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 24))
    features = spark.createDataFrame(pd.DataFrame({"id": np.repeat(np.arange(6000), 24), "feature": np.tile(np.arange(24), 6000), "value": x.ravel()})).repartition(4)
    scaled = neighbours.written(neighbours._scaled(features))
    wide = scaled.groupBy("id").agg(F.collect_list(F.struct("feature", "v")).alias("all")).select("all.feature", "all.v")
    packed = wide.mapInArrow(neighbours._packed, "i long, j long, x binary, y binary")
    n, points = packed.agg(F.count("*"), F.sum(F.octet_length("x") / 8)).first()
    assert points == 276 * 6000 and n <= 276 * 4
    began = time.perf_counter()
    assert {r.n for r in neighbours.neighbour_information(features).collect()} == {6000}
    assert time.perf_counter() - began < 60


def test_matrix(spark):
    """Known information of normal pairs, and the normalised form from its definition."""
    rng = np.random.default_rng(3)
    n, rho = 3000, 0.8
    x, z, w = rng.standard_normal((3, n))
    features = table(spark, {"x": np.exp(x), "y": (rho * x + math.sqrt(1 - rho**2) * z) ** 3, "w": w, "few": [1.0, 2.0] + [math.nan] * (n - 2)})
    got = {(r.i, r.j): r for r in neighbours.neighbour_matrix(features, cell_rows=300).collect()}
    assert set(got) == {("w", "x"), ("w", "y"), ("x", "y")}
    assert got["x", "y"].mi == pytest.approx(-0.5 * math.log(1 - rho**2), abs=0.05) and got["w", "x"].mi < 0.05
    gauss = information.rank_gaussian(features.where("feature in ('x', 'y')"), "value", "feature").toPandas()
    h = [np.histogram(gauss[gauss.feature == f].gauss, bins=math.isqrt(n))[0] / n for f in "xy"]
    both = sum(-(p[p > 0] * np.log2(p[p > 0])).sum() for p in h)
    assert got["x", "y"].nmi == pytest.approx(2 * got["x", "y"].mi / both, abs=1e-6)


def test_query_equals_brute_force_on_all_embeddings(spark):
    folder = f"{DATA}/sf0.01"
    got = {(r.i, r.j): r.mi for r in registry.queries()["neighbour_information"](spark, folder).collect()}
    w = wide(views.features(spark, folder).select("id", "feature", "value"))
    assert len(got) == 64 * 63 // 2
    for i, j in list(got)[::40]:
        assert got[i, j] == pytest.approx(brute(w[str(i)].to_numpy(), w[str(j)].to_numpy()), abs=1e-6)

"""Registered simulations draw as many paths and permutations as the reference does by default."""

from __future__ import annotations

import pytest

from tests.conftest import DATA
from tidemark.operators import simulation
from tidemark.plans import registry

SF = f"{DATA}/sf0.001"


def test_permutations(spark):
    rows = registry.queries()["permutation_test"](spark, SF).collect()
    assert rows and all(r.n == 200 and 1 / 201 <= r.p_value <= 1 for r in rows)


@pytest.mark.parametrize("method", ["iid", "stationary", "semiparametric"])
def test_paths(spark, monkeypatch, method):
    drawn = []
    summarise = simulation.summarise
    monkeypatch.setattr(simulation, "summarise", lambda sims, key, actual=None: drawn.append(sims) or summarise(sims, key, actual))
    registry.queries()[f"monte_carlo_{method}"](spark, SF)
    counts = drawn[0].groupBy("asset").agg({"sim": "count"}).collect()
    assert counts and all(r[1] == 2000 for r in counts)

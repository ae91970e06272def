"""Feature queries cover every value of the embeddings, and agree with those that SQL checks."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def embeddings(spark):
    return np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], dtype=np.float64)


@pytest.mark.parametrize("name", ["rank_gaussian", "calibrated_metrics", "feature_votes", "rank_share", "auc", "classifier_metrics", "best_threshold"])
def test_all_features(spark, embeddings, name):
    found = {r[0] for r in registry.queries()[name](spark, SF).select("feature").distinct().collect()}
    assert found == set(range(embeddings.shape[1]))


@pytest.mark.parametrize("name", ["feature_correlation", "mutual_information"])
def test_all_pairs(spark, embeddings, name):
    n = embeddings.shape[1]
    rows = registry.queries()[name](spark, SF).collect()
    assert len(rows) == (n * n if name.startswith("feature") else n * (n - 1) // 2)
    want = np.corrcoef(embeddings.T)
    assert all(r["corr"] == pytest.approx(want[r.i, r.j], abs=2e-6) for r in rows)


@pytest.mark.parametrize("name", ["rank_share", "auc", "classifier_metrics", "best_threshold", "mutual_information"])
def test_same_as_checked_part(spark, name):
    part = {tuple(r) for r in registry.queries()[name](spark, SF).collect()}
    assert part <= {tuple(r) for r in registry.queries()[f"{name}"](spark, SF).collect()}

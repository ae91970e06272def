"""Search for the settings of boosted trees over purged paths, as a relation (trial, rung, path), with trials pruned by halving.

Time is cut into blocks of about equally many rows; a path tests one block and trains on the others, without the rows within
the embargo before and after the test block. Every rung fits the trials that are left on a larger share of the training rows, each
(path, block of trials) in a task of its own, and keeps the best part of them. A trial's objective is the mean score over
the paths less a part of its deviation and of the gap between training and test. What a task fits on is bounded: beyond ``rows``
training rows in all, the shares are of a part chosen by a hash of the id (a documented bound; tests use all rows of the test blocks
up to the same number).

Rows are (id, t, label, x): ``t`` a number or a time, labels 0 or 1. Rows with a null among t, label and x are left out. Paths without
both labels in training have null scores; a trial without any score comes last.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.learning import boosted_trees
from tidemark.sources.tables import written

c = F.col
#: Hash places that shares of rows are cut from.
PLACES = 1 << 30


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations of a space, the last name fastest."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def draws(space: dict[str, list], trials: int, seed: int = 7) -> list[dict]:
    """Random settings of a space, without repeats, in all at most as many as there are."""
    rng = np.random.default_rng(seed)
    size = math.prod(len(v) for v in space.values())
    if size <= 100_000:
        found = grid(space)
        return [found[i] for i in rng.permutation(size)[:trials]]
    chosen: dict[str, dict] = {}
    while len(chosen) < trials:
        one = {k: v[int(rng.integers(0, len(v)))] for k, v in space.items()}
        chosen.setdefault(json.dumps(one, sort_keys=True, default=str), one)
    return list(chosen.values())


def purged_paths(rows: DataFrame, paths: int = 5, embargo: float = 0.0) -> DataFrame:
    """(path, role, id, label, x): the rows of every path as train or test. ``embargo`` is in units of t, seconds for times."""
    at = c("t").cast("double") if rows.schema["t"].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date") else F.col("t").cast("timestamp").cast("double")
    known = rows.where(c("t").isNotNull() & c("label").isNotNull() & c("x").isNotNull()).select("id", at.alias("t"), c("label").cast("double").alias("label"), c("x").cast("array<double>").alias("x"))
    ends = known.agg(F.percentile_approx("t", [k / paths for k in range(1, paths)], 10_000).alias("q"), F.min("t").alias("low"), F.max("t").alias("high")).first()
    if ends.q is None:
        return known.select(F.lit(0).alias("path"), F.lit("train").alias("role"), "id", "label", "x").limit(0)
    bounds = [ends.low, *sorted(set(ends.q) - {ends.low}), math.nextafter(ends.high, math.inf)]
    roles = []
    for low, high in itertools.pairwise(bounds):
        near = (c("t") >= low - embargo) & (c("t") < high + embargo)
        roles.append(F.when((c("t") >= low) & (c("t") < high), "test").when(~near, "train"))
    return known.select(F.posexplode(F.array(*roles)).alias("path", "role"), "id", "label", "x").where("role is not null")


def score(name: str, y: np.ndarray, p: np.ndarray) -> float | None:
    """Greater is better: neg_log_loss, accuracy, f1 or auc; nothing where there are no rows, or for auc only one label."""
    if not len(y):
        return None
    if name == "neg_log_loss":
        q = np.clip(p, 1e-12, 1 - 1e-12)
        return float((y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    said = p >= 0.5
    if name == "accuracy":
        return float((said == (y == 1)).mean())
    if name == "f1":
        hit = float((said & (y == 1)).sum())
        return 2 * hit / float(said.sum() + (y == 1).sum()) if said.any() or (y == 1).any() else 0.0
    if name != "auc":
        raise ValueError(f"unknown score {name}")
    n1 = int((y == 1).sum())
    if n1 in (0, len(y)):
        return None
    ranks = pd.Series(p).rank().to_numpy()
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


SCORES = "trial int, path int, rows long, train double, test double"


def fit_scores(assigned: DataFrame, trials: Sequence[tuple[int, dict]], share: float, scoring: str = "neg_log_loss", per_task: int = 4, seed: int = 7) -> DataFrame:
    """(trial, path, rows, train, test): every trial fitted on a share of every path's training rows, ``per_task`` trials in a task."""
    blocks = [list(trials[i : i + per_task]) for i in range(0, len(trials), per_task)]
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(PLACES))
    dealt = assigned.where((c("role") == "test") | (place < int(share * PLACES))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x, y, train = np.vstack(pdf["x"].to_numpy()), pdf["label"].to_numpy(), (pdf["role"] == "train").to_numpy()
        path, out = int(pdf["path"].iloc[0]), []
        for trial, options in blocks[int(pdf["block"].iloc[0])]:
            if len(set(y[train])) < 2:
                out.append((trial, path, int(train.sum()), None, None))
                continue
            model, _ = boosted_trees(x[train], y[train], seed=seed, **options)
            out.append((trial, path, int(train.sum()), score(scoring, y[train], model(x[train])), score(scoring, y[~train], model(x[~train]))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in SCORES.split(", ")]).astype({"train": "Float64", "test": "Float64"})

    return dealt.groupBy("path", "block").applyInPandas(fit, SCORES)


def objectives(scores: DataFrame, deviation: float = 0.5, gap: float = 0.0) -> DataFrame:
    """(trial, objective, mean, sd, overfit): mean test score less a part of its deviation and of the gap to training."""
    g = scores.groupBy("trial").agg(F.avg("test").alias("mean"), F.coalesce(F.stddev_pop("test"), F.lit(0.0)).alias("sd"), F.avg("train").alias("_train"))
    overfit = F.greatest(c("_train") - c("mean"), F.lit(0.0))
    return g.select("trial", (c("mean") - deviation * c("sd") - gap * overfit).alias("objective"), "mean", "sd", overfit.alias("overfit"))


def halving(
    assigned: DataFrame, trials: Sequence[dict], shares: Sequence[float] = (0.25, 0.5, 1.0), keep: float = 0.5, scoring: str = "neg_log_loss",
    deviation: float = 0.5, gap: float = 0.0, rows: int = 100_000, per_task: int = 4, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Successive halving: (scores by (rung, trial, path), (trial, params, rung, objective, mean, sd, overfit, place) of all trials).

    The driver holds a row per trial. Trials are ranked by the last rung they reached, then by their objective there.
    """
    spark = assigned.sparkSession
    most = assigned.groupBy("path", "role").count().agg(F.max("count")).first()[0] or 0
    bound = min(1.0, rows / most) if most else 1.0
    if bound < 1:
        assigned = assigned.where(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(PLACES)) < int(bound * PLACES))
    assigned = written(assigned)
    left, told, ranked = list(enumerate(trials)), [], {}
    for rung, share in enumerate(shares):
        scores = written(fit_scores(assigned, left, share, scoring, per_task, seed).withColumn("rung", F.lit(rung)))
        told.append(scores.select("rung", *[f.split()[0] for f in SCORES.split(", ")]))
        found = {r.trial: r for r in objectives(scores, deviation, gap).collect()}
        order = sorted(left, key=lambda t: (t[0] not in found or found[t[0]].objective is None, -(found[t[0]].objective or 0.0) if t[0] in found else 0.0, t[0]))
        for t, _ in order:
            r = found.get(t)
            ranked[t] = (rung, *((r.objective, r.mean, r.sd, r.overfit) if r else (None,) * 4))
        left = order[: max(1, math.ceil(len(order) * keep))]
    places = sorted(ranked, key=lambda t: (-ranked[t][0], ranked[t][1] is None, -(ranked[t][1] or 0.0), t))
    rows_ = [(t, json.dumps(trials[t], sort_keys=True, default=str), *ranked[t], place) for place, t in enumerate(places, 1)]
    table = spark.createDataFrame(rows_, "trial int, params string, rung int, objective double, mean double, sd double, overfit double, place int")
    return (told[0] if len(told) == 1 else _all(told)), table


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def learning_curve(assigned: DataFrame, options: dict, shares: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), scoring: str = "neg_log_loss", seed: int = 7) -> DataFrame:
    """(share, rows, train, train_sd, test, test_sd): scores over the paths by the share of training rows, a task for each (share, path)."""
    parts = [fit_scores(assigned, [(i, options)], s, scoring, 1, seed) for i, s in enumerate(shares)]
    g = _all(parts).groupBy("trial").agg(F.avg("rows").alias("rows"), *(f.alias(n) for n, f in (("train", F.avg("train")), ("train_sd", F.stddev_pop("train")), ("test", F.avg("test")), ("test_sd", F.stddev_pop("test")))))
    return g.select(F.element_at(F.lit(list(shares)), c("trial") + 1).alias("share"), "rows", "train", "train_sd", "test", "test_sd")

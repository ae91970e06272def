"""Meta-labelling: strategy state, calibration, evaluation, importance and selection of features."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import risk

c = F.col
STATE_WINDOWS = (20, 50, 1000)


def state_columns(windows: tuple[int, ...] = STATE_WINDOWS) -> list[str]:
    return [f"{kind}_{n}" for n in windows for kind in ("state_rr", "state_winrate")]


def state_features(t: DataFrame, key: str, order: tuple[str, ...], windows: tuple[int, ...] = STATE_WINDOWS, least: int = 10, fill: tuple[float, float] = (0.0, 0.5)) -> DataFrame:
    """Mean reward ratio and win rate of the trades before each, over several windows."""
    w = Window.partitionBy(key).orderBy(*order)
    for n in windows:
        past = w.rowsBetween(-n, -1)
        enough = F.count("rr").over(past) >= least
        t = t.withColumns({
            f"state_rr_{n}": F.coalesce(F.when(enough, F.avg("rr").over(past)), F.lit(fill[0])),
            f"state_winrate_{n}": F.coalesce(F.when(enough, F.avg((c("rr") > 0).cast("double")).over(past)), F.lit(fill[1])),
        })
    return t


def state_with_history(now: DataFrame, history: DataFrame, key: str, order: tuple[str, ...], windows: tuple[int, ...] = STATE_WINDOWS, least: int = 10, fill: tuple[float, float] = (0.0, 0.5)) -> DataFrame:
    """State features of the trades ``now`` alone, with ``history`` before them in the windows."""
    both = history.withColumn("_now", F.lit(False)).unionByName(now.withColumn("_now", F.lit(True)))
    return state_features(both, key, order, windows, least, fill).where("_now").drop("_now")


def state_per_path(trades: DataFrame, path: str, key: str, order: tuple[str, ...], windows: tuple[int, ...] = STATE_WINDOWS, least: int = 10, fill: tuple[float, float] = (-1.0, -1.0)) -> DataFrame:
    """State features within each path of a cross-validation: windows hold the path's own rows only."""
    keyed = trades.withColumn("_key", F.struct(path, key))
    return state_features(keyed, "_key", order, windows, least, fill).drop("_key")


def rank_features_by_path(features: DataFrame, folds: int) -> DataFrame:
    """(feature, role, mean, sd) of the AUC of each feature over folds by id: on the rows of a fold and on the others."""
    dealt = features.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    dealt = dealt.withColumn("role", F.when(F.pmod("id", F.lit(folds)) == c("fold"), "validation").otherwise("train"))
    found = auc(dealt, "value", "label", "feature", "fold", "role")
    return found.groupBy("feature", "role").agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"))


def reward_weights(rr: Column, *keys: str) -> Column:
    """2 in the outer fifths by rank, else a half, with mean one."""
    w = Window.partitionBy(*keys)
    share = F.percent_rank().over(w.orderBy(rr))
    raw = F.when((share < 0.2) | (share > 0.8), 2.0).otherwise(0.5)
    return raw


def auc(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Area under the curve from average ranks: one aggregate over distinct scores."""
    n = df.groupBy(*keys, score).agg(F.sum(c(label)).alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = n.withColumn("rank", below + (c("n") + 1) / 2)
    g = ranked.groupBy(*keys).agg(F.sum(c("rank") * c("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return g.select(*keys, F.try_divide(c("r") - c("p") * (c("p") + 1) / 2, c("p") * (c("n") - c("p"))).alias("auc"))


def evaluate(df: DataFrame, p: str, label: str, *keys: str, threshold: float = 0.5) -> DataFrame:
    """Log-loss, Brier score, accuracy, precision, recall and F1 in one aggregate."""
    q = F.greatest(F.least(c(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    yes, true = (c(p) >= threshold).cast("double"), c(label).cast("double")
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), (-F.avg(true * F.log(q) + (1 - true) * F.log(1 - q))).alias("log_loss"), F.avg(F.pow(c(p) - true, F.lit(2))).alias("brier"),
        F.avg((yes == true).cast("double")).alias("accuracy"), F.sum(yes * true).alias("tp"), F.sum(yes).alias("said"), F.sum(true).alias("is"),
    )
    precision, recall = F.try_divide("tp", "said"), F.try_divide("tp", "is")
    return g.select(*keys, "n", "log_loss", "brier", "accuracy", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * c("tp"), c("said") + c("is")).alias("f1"))


def best_threshold(df: DataFrame, p: str, label: str, *keys: str, metric: str = "youden") -> DataFrame:
    """The threshold of best Youden J, F1 or balanced accuracy, from cumulative counts over distinct scores."""
    n = df.groupBy(*keys, c(p).alias("threshold")).agg(F.sum(c(label)).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    tp, said = F.sum("pos").over(w), F.sum("n").over(w)
    pos, rows = F.sum("pos").over(total), F.sum("n").over(total)
    tpr, fpr = F.try_divide(tp, pos), F.try_divide(said - tp, rows - pos)
    value = {"youden": tpr - fpr, "f1": F.try_divide(2 * tp, said + pos), "balanced": (tpr + 1 - fpr) / 2}[metric]
    scored = n.withColumn("value", value)
    return scored.groupBy(*keys).agg(F.max_by("threshold", F.struct("value", "threshold")).alias("threshold"), F.max("value").alias("value"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-6, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) by Newton's method."""
    a = np.column_stack((x, np.ones(len(x))))
    s = np.ones(len(x)) if weight is None else weight
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (s * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (s * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ w, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


@dataclass
class Calibrator:
    """Maps scores to probabilities: Platt, beta, temperature, their mean, or a stack of them."""

    method: str = "platt"
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def inputs(method: str, p: np.ndarray) -> np.ndarray:
        q = np.clip(p, 1e-6, 1 - 1e-6)
        return np.column_stack((np.log(q), -np.log1p(-q))) if method == "beta" else _logit(p)[:, None]

    def fit(self, p: np.ndarray, y: np.ndarray) -> Calibrator:
        for kind in ("platt", "beta"):
            self.parts[kind] = logistic(self.inputs(kind, p), y)
        grid = np.geomspace(0.1, 10, 200)
        loss = [-np.mean(y * np.log(q := np.clip(1 / (1 + np.exp(-_logit(p) / t)), 1e-12, 1 - 1e-12)) + (1 - y) * np.log(1 - q)) for t in grid]
        self.parts["temperature"] = np.array([1 / grid[int(np.argmin(loss))], 0.0])
        if self.method == "stacking":
            head = int(0.7 * len(p))
            inner = Calibrator("ensemble").fit(p[:head], y[:head])
            self.parts["stacking"] = logistic(inner.columns(p[head:]), y[head:], ridge=1e-2)
        return self

    def columns(self, p: np.ndarray) -> np.ndarray:
        return np.column_stack([predict(self.parts[k], self.inputs(k, p)) for k in ("platt", "beta", "temperature")])

    def transform(self, p: np.ndarray) -> np.ndarray:
        if self.method == "ensemble":
            return self.columns(p).mean(axis=1)
        if self.method == "stacking":
            return predict(self.parts["stacking"], self.columns(p))
        return predict(self.parts[self.method], self.inputs(self.method, p))

    def state(self) -> dict:
        return {"method": self.method, "parts": {k: v.tolist() for k, v in self.parts.items()}}

    @classmethod
    def from_state(cls, state: dict) -> Calibrator:
        return cls(state["method"], {k: np.array(v) for k, v in state["parts"].items()})

    @classmethod
    def best(cls, p: np.ndarray, y: np.ndarray, methods: tuple[str, ...] = ("platt", "beta", "temperature", "ensemble", "stacking")) -> Calibrator:
        """The method of least Brier score on the given rows."""
        return min((cls(m).fit(p, y) for m in methods), key=lambda k: float(((k.transform(p) - y) ** 2).mean()))


def calibrate(df: DataFrame, p: str, label: str, method: str = "platt", rows: int = 100_000) -> DataFrame:
    """``df`` with ``calibrated``: fitted on at most ``rows`` rows chosen by hash, applied to all by Arrow batches."""
    sample = df.select(p, label).orderBy(F.xxhash64(p, label), p, label).limit(rows).toPandas().sort_values([p, label])
    model = Calibrator(method).fit(sample[p].to_numpy(), sample[label].to_numpy(dtype=np.float64))

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(model.transform(x.to_numpy()))

    return df.withColumn("calibrated", apply(c(p)))


def gate_and_bet(df: DataFrame, p: str, gate: float = 0.5) -> DataFrame:
    """``gate_col`` 1 where a calibrated probability reaches the gate, and ``bet_col`` the size it asks for; unknown ones nothing."""
    known = F.coalesce(c(p), F.lit(0.0))
    size = F.greatest(F.least((known - gate) / (1 - gate), F.lit(1.0)), F.lit(0.0))
    return df.withColumns({"gate_col": (known >= gate).cast("int"), "bet_col": size})


Model = Callable[[np.ndarray], np.ndarray]


def leaf_values(node, b: np.ndarray) -> np.ndarray:
    """What a tree (place, bin, lower, upper) or leaf gives rows of bins."""
    if not isinstance(node, (tuple, list)):
        return np.full(len(b), float(node))
    j, k, low, high = node
    out, side = np.empty(len(b)), b[:, j] <= k
    out[side], out[~side] = leaf_values(low, b[side]), leaf_values(high, b[~side])
    return out


@dataclass
class Forest:
    """Boosted trees on binned features: a probability function that can be written down."""

    edges: list[np.ndarray]
    base: float
    trees: list

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])
        return 1 / (1 + np.exp(-(self.base + sum(leaf_values(t, b) for t in self.trees))))

    def state(self) -> dict:
        return {"edges": [e.tolist() for e in self.edges], "base": self.base, "trees": self.trees}

    @classmethod
    def from_state(cls, state: dict) -> Forest:
        return cls([np.array(e) for e in state["edges"]], state["base"], state["trees"])


@dataclass
class Bag:
    """The mean of several models' probabilities, and decisions by a threshold."""

    models: list[Forest]
    threshold: float = 0.5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.mean([m(x) for m in self.models], axis=0)

    def predict(self, x: np.ndarray, threshold: float | None = None) -> np.ndarray:
        return (self(x) >= (self.threshold if threshold is None else threshold)).astype(np.int64)

    def state(self) -> dict:
        return {"models": [m.state() for m in self.models], "threshold": self.threshold}

    @classmethod
    def from_state(cls, state: dict) -> Bag:
        return cls([Forest.from_state(m) for m in state["models"]], state["threshold"])


def boosted_trees(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 32, ridge: float = 1.0, seed: int = 7, sample: float = 1.0, edges: list[np.ndarray] | None = None) -> tuple[Forest, np.ndarray]:
    """Gradient boosting on histograms for a binary label: (probability function, gain per feature)."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if edges is None else edges
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)])
    base = math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    score, gain_of, forest = np.full(len(y), base), np.zeros(x.shape[1]), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if left and len(rows) >= 20:
            for j in range(x.shape[1]):
                a = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=bins))[:-1]
                b = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=bins))[:-1]
                gain = a * a / (b + ridge) + (gs - a) ** 2 / (hs - b + ridge) - gs * gs / (hs + ridge)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), j, k))
        if best[1] < 0:
            return -rate * gs / (hs + ridge)
        gain_of[best[1]] += best[0]
        side = binned[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[side], g, h, left - 1), grow(rows[~side], g, h, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < sample) if sample < 1 else np.arange(len(y))
        forest.append(grow(rows, p - y, p * (1 - p), depth))
        score += leaf_values(forest[-1], binned)
    return Forest(edges, base, forest), gain_of / max(gain_of.sum(), 1e-12)


def bagged(x: np.ndarray, y: np.ndarray, models: int = 10, seed: int = 7, **options) -> Bag:
    """The mean of boosted models on bootstrap rows."""
    rng = np.random.default_rng(seed)
    fitted = []
    for _ in range(models):
        rows = rng.integers(0, len(y), len(y))
        fitted.append(boosted_trees(x[rows], y[rows], **options)[0])
    return Bag(fitted)


def permutation_importance(model: Model, x: np.ndarray, y: np.ndarray, groups: list[list[int]] | None = None, repeats: int = 10, seed: int = 7) -> pd.DataFrame:
    """Loss added by shuffling each feature, or each group of features together: mean and standard error."""
    rng = np.random.default_rng(seed)
    loss = lambda p: -float(np.mean(y * np.log(np.clip(p, 1e-12, 1)) + (1 - y) * np.log(np.clip(1 - p, 1e-12, 1))))
    base = loss(model(x))
    rows = []
    for k, members in enumerate(groups or [[j] for j in range(x.shape[1])]):
        found = []
        for _ in range(repeats):
            z = x.copy()
            z[:, members] = z[rng.permutation(len(z))][:, members]
            found.append((loss(model(z)) - base) / max(abs(base), 1e-12))
        rows.append((k, float(np.mean(found)), float(np.std(found) / math.sqrt(repeats))))
    return pd.DataFrame(rows, columns=["feature", "mean", "se"])


def harmful(importance: pd.DataFrame, critical: float = 1.96) -> list[int]:
    """Features whose importance is below zero beyond its error."""
    return importance[(importance["mean"] < 0) & (importance["mean"] + critical * importance["se"] < 0)]["feature"].tolist()


def select_features(importance: pd.DataFrame, least: int = 10, critical: float = 1.96) -> list[int]:
    """Features above zero beyond their error, filled up by signal-to-noise among the harmless."""
    sure = importance[(importance["mean"] > 0) & (importance["mean"] - critical * importance["se"] > 0)]
    kept = sure.sort_values("mean", ascending=False)["feature"].tolist()
    rest = importance[~importance["feature"].isin([*kept, *harmful(importance, critical)])]
    by_noise = rest.assign(snr=rest["mean"] / rest["se"].replace(0, 1e-12)).sort_values("snr", ascending=False)["feature"].tolist()
    return kept + by_noise[: max(0, least - len(kept))]


def fold_votes(features: DataFrame, folds: int = 5, repeats: int = 5, critical: float = 1.96, seed: int = 7, rows: int = 100_000) -> DataFrame:
    """(fold, feature, mean, se, harmful) by permutation on held-out rows: one task per fold.

    ``features`` is wide (id, label, x array); the rows of all folds but its own train a fold's model. Models
    and votes take about ``rows`` labelled rows in all, chosen by hash (a documented bound; all, where there are fewer).
    """
    fold = F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int")
    share = int(min(1.0, rows / max(features.count(), 1)) * (1 << 40))
    dealt = features.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) < share).withColumn("own", fold).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y, test = np.vstack(pdf["x"].to_numpy()), pdf["label"].to_numpy(dtype=np.float64), (pdf["own"] == pdf["fold"]).to_numpy()
        model, _ = boosted_trees(x[~test], y[~test], trees=20, seed=seed)
        out = permutation_importance(model, x[test], y[test], repeats=repeats, seed=seed)
        return out.assign(fold=int(pdf["fold"].iloc[0]), harmful=out["feature"].isin(harmful(out, critical)))[["fold", "feature", "mean", "se", "harmful"]]

    return dealt.groupBy("fold").applyInPandas(work, "fold int, feature int, mean double, se double, harmful boolean")


def clustered_importance(model: Model, x: np.ndarray, y: np.ndarray, clusters: list[list[int]], repeats: int = 10, top: int | None = None, seed: int = 7) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Importance of clusters shuffled as wholes, and of the features inside those above zero, the ``top`` of them."""
    whole = permutation_importance(model, x, y, clusters, repeats, seed).rename(columns={"feature": "cluster"})
    chosen = whole[whole["mean"] > 0].sort_values("mean", ascending=False).head(top or len(whole))["cluster"].tolist()
    members = [j for k in chosen for j in clusters[k]]
    inside = permutation_importance(model, x, y, [[j] for j in members], repeats, seed)
    return whole, inside.assign(feature=members, cluster=[k for k in chosen for _ in clusters[k]])


def impurity_importance(x: np.ndarray, y: np.ndarray, models: int = 10, seed: int = 7) -> pd.DataFrame:
    """Share of the splits' gain per feature: mean and standard error over models on bootstrap rows."""
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(models):
        rows = rng.integers(0, len(y), len(y))
        found.append(boosted_trees(x[rows], y[rows], trees=20, seed=seed)[1])
    shares = np.array(found)
    return pd.DataFrame({"feature": np.arange(x.shape[1]), "mean": shares.mean(axis=0), "se": shares.std(axis=0) / math.sqrt(models)})


def tuned(x: np.ndarray, y: np.ndarray, space: dict[str, list], trials: int = 20, folds: int = 3, seed: int = 7) -> pd.DataFrame:
    """Random settings of boosted trees by cross-validated log-loss, the best first."""
    rng, fold = np.random.default_rng(seed), np.arange(len(y)) % folds
    rows = []
    for _ in range(trials):
        options = {k: v[int(rng.integers(0, len(v)))] for k, v in space.items()}
        loss = 0.0
        for f in range(folds):
            model, _ = boosted_trees(x[fold != f], y[fold != f], seed=seed, **options)
            p, t = np.clip(model(x[fold == f]), 1e-12, 1 - 1e-12), y[fold == f]
            loss -= float((t * np.log(p) + (1 - t) * np.log(1 - p)).sum())
        rows.append({**options, "loss": loss / len(y)})
    return pd.DataFrame(rows).sort_values("loss", kind="stable", ignore_index=True)


def stable_removals(votes: DataFrame, folds: int, share: float = 0.5) -> DataFrame:
    """Features that at least a share of the folds found harmful."""
    return votes.groupBy("feature").agg(F.sum(c("harmful").cast("int")).alias("votes")).where(c("votes") >= math.ceil(folds * share))


def single_feature_scores(x: np.ndarray, y: np.ndarray, folds: int = 5) -> np.ndarray:
    """Cross-validated negative log-loss of a model on each feature alone."""
    fold = np.arange(len(y)) % folds
    out = []
    for j in range(x.shape[1]):
        loss = 0.0
        for f in range(folds):
            w = logistic(x[fold != f][:, [j]], y[fold != f], ridge=1e-3)
            p = np.clip(predict(w, x[fold == f][:, [j]]), 1e-12, 1 - 1e-12)
            t = y[fold == f]
            loss -= float((t * np.log(p) + (1 - t) * np.log(1 - p)).sum())
        out.append(-loss / len(y))
    return np.array(out)


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's rank correlation with ties, over all pairs of a short vector."""
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def importance_table(x: np.ndarray, y: np.ndarray, folds: int = 3, repeats: int = 5, seed: int = 7) -> pd.DataFrame:
    """(feature, gain, loss, alone): shares of the splits' gain, loss added by shuffling held-out rows, and each feature's own score."""
    fold, added = np.arange(len(y)) % folds, []
    for f in range(folds):
        model, _ = boosted_trees(x[fold != f], y[fold != f], trees=20, seed=seed)
        added.append(permutation_importance(model, x[fold == f], y[fold == f], repeats=repeats, seed=seed)["mean"].to_numpy())
    return pd.DataFrame({"feature": np.arange(x.shape[1]), "gain": impurity_importance(x, y, 4, seed)["mean"], "loss": np.mean(added, axis=0), "alone": single_feature_scores(x, y, folds)})


def agreement(a: np.ndarray, b: np.ndarray, top: int = 10) -> dict[str, float]:
    """How two importances agree: Pearson's and Kendall's correlation, and the shared part of their best features."""
    best = lambda v: set(np.argsort(-v, kind="stable")[:top].tolist())
    flat = a.std() == 0 or b.std() == 0
    return {"pearson": 0.0 if flat else float(np.corrcoef(a, b)[0, 1]), "kendall": 0.0 if flat else kendall(a, b), "shared": len(best(a) & best(b)) / min(top, len(a))}


def gain_and_spectrum(x: np.ndarray, y: np.ndarray, models: int = 4, seed: int = 7) -> tuple[pd.DataFrame, dict[str, float]]:
    """Gains beside the spectral scores of the features' correlation, and how both agree."""
    table = impurity_importance(x, y, models, seed)[["feature", "mean"]].rename(columns={"mean": "gain"})
    table["spectral"] = risk.spectral_scores(x)
    return table, agreement(table["gain"].to_numpy(), table["spectral"].to_numpy())

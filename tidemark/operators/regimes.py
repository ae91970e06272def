"""Regimes: mixtures and hidden Markov models in numpy, statistics of labelled bars as windows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def volatility_regime(bars: DataFrame, n: int = 20, states: int = 3) -> DataFrame:
    """``regime`` 0.. by the quantile of the last ``n`` bars' volatility within the symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    bars = bars.withColumn("_r", c("close") - F.lag("close").over(w))
    vol = F.when(F.count("_r").over(w.rowsBetween(-(n - 1), 0)) >= n, F.stddev_samp("_r").over(w.rowsBetween(-(n - 1), 0)))
    bars = bars.withColumn("_v", vol).where("_v is not null")
    return bars.withColumn("regime", F.ntile(states).over(Window.partitionBy("symbol").orderBy("_v", "ts")) - 1).drop("_r", "_v")


def transition_matrix(labelled: DataFrame) -> DataFrame:
    """Shares of next regimes per regime and symbol, as a crosstab of rows."""
    nxt = F.lead("regime").over(Window.partitionBy("symbol").orderBy("ts"))
    n = labelled.withColumn("to", nxt).where("to is not null").groupBy("symbol", c("regime").alias("from"), "to").agg(F.count("*").alias("n"))
    return n.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("symbol", "from")))


def run_lengths(labelled: DataFrame) -> DataFrame:
    """Number, mean and longest length of unbroken stays per regime: gaps and islands."""
    w = Window.partitionBy("symbol").orderBy("ts")
    own = Window.partitionBy("symbol", "regime").orderBy("ts")
    runs = labelled.withColumn("_k", F.row_number().over(w) - F.row_number().over(own)).groupBy("symbol", "regime", "_k").agg(F.count("*").alias("n"))
    return runs.groupBy("symbol", "regime").agg(F.count("*").alias("runs"), F.avg("n").alias("mean_length"), F.max("n").alias("longest"))


def regime_returns(labelled: DataFrame, directions: dict[int, int] | None = None) -> DataFrame:
    """Statistics of the next bar's return by the regime known before it."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = labelled.withColumns({"known": F.lag("regime").over(w), "r": c("close") - F.lag("close").over(w)}).where("known is not null")
    if directions:
        sign = F.lit(0)
        for k, d in directions.items():
            sign = F.when(c("known") == k, d).otherwise(sign)
        rows = rows.withColumn("r", c("r") * sign)
    g = rows.groupBy("symbol", c("known").alias("regime"))
    return g.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.percentile("r", 0.05).alias("var"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"))


def clip_quantiles(train: DataFrame, other: DataFrame, names: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``other`` with its features kept within the training table's quantiles."""
    q = train.agg(*(F.percentile(n, [low, high]).alias(n) for n in names)).first()
    return other.withColumns({n: F.greatest(F.least(c(n), F.lit(q[n][1])), F.lit(q[n][0])) for n in names})


def log_gauss(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    l = np.linalg.cholesky(cov)
    z = np.linalg.solve(l, (x - mean).T)
    return -0.5 * (z * z).sum(axis=0) - np.log(np.diag(l)).sum() - 0.5 * len(mean) * math.log(2 * math.pi)


def _soft(log_p: np.ndarray) -> tuple[np.ndarray, float]:
    top = log_p.max(axis=1, keepdims=True)
    e = np.exp(log_p - top)
    s = e.sum(axis=1, keepdims=True)
    return e / s, float((np.log(s) + top).sum())


@dataclass
class HiddenMarkov:
    """Gaussian hidden Markov model by expectation and maximisation, scaled in logarithms.

    ``spherical`` gives each state one variance for all features; no variance falls below ``floor``, and no state is left
    with more than 1 - ``stay``. ``history`` holds the likelihood before each round.
    """

    states: int = 3
    rounds: int = 100
    persistence: float = 0.9
    seed: int = 7
    converged: bool = False
    likelihood: float = -math.inf
    spherical: bool = False
    floor: float = 1e-4
    stay: float = 0.0
    history: list[float] = field(default_factory=list)

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([log_gauss(x, m, s) for m, s in zip(self.means, self.covs, strict=True)])

    def _update(self, x: np.ndarray, g: np.ndarray) -> None:
        n = g.sum(axis=0) + 1e-9
        self.means = (g.T @ x) / n[:, None]
        if self.spherical:
            spread = [(g[:, k] @ ((x - m) ** 2)).mean() / n[k] for k, m in enumerate(self.means)]
            self.covs = np.array([max(v, self.floor) * np.eye(x.shape[1]) for v in spread])
            return
        eye = self.floor * np.eye(x.shape[1])
        self.covs = np.array([((x - m).T * g[:, k]) @ (x - m) / n[k] + eye for k, m in enumerate(self.means)])

    def _settle(self) -> None:
        """Raises the chance to stay to its least value, at the cost of all others in proportion."""
        for k in range(self.states):
            if self.states > 1 and self.moves[k, k] < self.stay:
                self.moves[k] *= (1 - self.stay) / (1 - self.moves[k, k])
                self.moves[k, k] = self.stay

    def fit(self, x: np.ndarray) -> HiddenMarkov:
        rng = np.random.default_rng(self.seed)
        k, n = self.states, len(x)
        first = x[:, 0] + 1e-9 * rng.standard_normal(n)
        g = np.full((n, k), 0.1 / k)
        g[np.arange(n), np.minimum((np.argsort(np.argsort(first)) * k) // max(n, 1), k - 1)] += 0.9
        self._update(x, g)
        self.start = np.full(k, 1 / k)
        self.moves = np.full((k, k), (1 - self.persistence) / max(k - 1, 1))
        np.fill_diagonal(self.moves, self.persistence if k > 1 else 1.0)
        for _ in range(self.rounds):
            g, xi, like = self._expect(x)
            self._update(x, g)
            self.start = g[0] / g[0].sum()
            self.moves = (xi + 1e-6) / (xi + 1e-6).sum(axis=1, keepdims=True)
            self._settle()
            self.history.append(like)
            if like - self.likelihood < 1e-4 * abs(like):
                self.converged, self.likelihood = True, like
                break
            self.likelihood = like
        return self

    def _expect(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        e = self._emissions(x)
        top = e.max(axis=1)
        p = np.exp(e - top[:, None])
        n, k = p.shape
        a, scale = np.empty((n, k)), np.empty(n)
        for i in range(n):
            a[i] = (self.start if i == 0 else a[i - 1] @ self.moves) * p[i]
            scale[i] = a[i].sum() or 1e-300
            a[i] /= scale[i]
        b = np.ones((n, k))
        for i in range(n - 2, -1, -1):
            b[i] = self.moves @ (p[i + 1] * b[i + 1]) / scale[i + 1]
        g = a * b
        xi = self.moves * (a[:-1].T @ (p[1:] * b[1:] / scale[1:, None]))
        return g / g.sum(axis=1, keepdims=True), xi, float((np.log(scale) + top).sum())

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Shares of the states given all rows, later ones too: for rows the model is fitted on."""
        return self._expect(x)[0]

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """Shares of the states given the rows up to each: what is known at its time."""
        e = self._emissions(x)
        p = np.exp(e - e.max(axis=1, keepdims=True))
        out = np.empty_like(p)
        for i in range(len(p)):
            out[i] = (self.start if i == 0 else out[i - 1] @ self.moves) * p[i]
            out[i] /= out[i].sum() or 1e-300
        return out

    def state(self) -> dict:
        """The fitted parameters as plain lists."""
        return {"states": self.states, "start": self.start.tolist(), "moves": self.moves.tolist(), "means": self.means.tolist(), "covs": self.covs.tolist(),
                "converged": self.converged, "likelihood": self.likelihood}

    @classmethod
    def from_state(cls, state: dict) -> HiddenMarkov:
        out = cls(state["states"], converged=state["converged"], likelihood=state["likelihood"])
        out.start, out.moves, out.means, out.covs = (np.array(state[k]) for k in ("start", "moves", "means", "covs"))
        return out


def gaussian_mixture(x: np.ndarray, k: int = 3, rounds: int = 100, seed: int = 7) -> np.ndarray:
    """Posterior shares of a full-covariance mixture."""
    m = HiddenMarkov(k, seed=seed)
    g = np.full((len(x), k), 0.1 / k)
    g[np.arange(len(x)), np.minimum((np.argsort(np.argsort(x[:, 0], kind="stable")) * k) // len(x), k - 1)] += 0.9
    before = -math.inf
    for _ in range(rounds):
        m._update(x, g)
        share = g.mean(axis=0)
        g, like = _soft(m._emissions(x) + np.log(share + 1e-12))
        if like - before < 1e-6 * abs(like):
            break
        before = like
    return g


def align(posterior: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States in ascending order of the first feature's mean, so that models can be averaged."""
    level = (posterior * x[:, :1]).sum(axis=0) / np.maximum(posterior.sum(axis=0), 1e-12)
    return posterior[:, np.argsort(level, kind="stable")]


@dataclass
class Ensemble:
    """Hidden Markov models on random subsets of smoothed features, and the mean of what they say.

    Smoothing goes on from the last training row, so that later rows are judged as they come.
    """

    models: int = 10
    states: int = 3
    seed: int = 7
    span: int = 100
    align_states: bool = False
    weighted: bool = False
    members: list[tuple[list[int], HiddenMarkov]] = field(default_factory=list)

    def smooth(self, x: np.ndarray) -> np.ndarray:
        return pd.DataFrame(x).ewm(span=self.span, min_periods=1).mean().to_numpy()

    def fit(self, x: np.ndarray) -> Ensemble:
        rng = np.random.default_rng(self.seed)
        smooth = self.smooth(x)
        self.members = []
        for k in range(self.models):
            cols = np.sort(rng.choice(x.shape[1], size=min(x.shape[1], int(rng.integers(2, 9))), replace=False))
            self.members.append((cols.tolist(), HiddenMarkov(self.states, seed=self.seed + k, rounds=50).fit(smooth[:, cols])))
        return self

    def _mean(self, x: np.ndarray, say: Callable[[HiddenMarkov, np.ndarray], np.ndarray]) -> np.ndarray:
        smooth, total, mass = self.smooth(x), np.zeros((len(x), self.states)), 0.0
        for cols, model in self.members:
            p = say(model, smooth[:, cols])
            order = np.argsort(model.means[:, 0], kind="stable") if self.align_states else np.arange(self.states)
            w = math.exp(model.likelihood / len(x)) if self.weighted else 1.0
            total, mass = total + w * p[:, order], mass + w
        return total / mass

    def filtered(self, x: np.ndarray) -> np.ndarray:
        return self._mean(x, HiddenMarkov.filtered)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return self._mean(x, HiddenMarkov.posterior)

    def convergence(self) -> pd.DataFrame:
        """One row per model: features, whether it converged, and its likelihood."""
        return pd.DataFrame([(k, len(cols), m.converged, m.likelihood) for k, (cols, m) in enumerate(self.members)], columns=["model", "features", "converged", "likelihood"])

    def state(self) -> dict:
        return {"span": self.span, "states": self.states, "align_states": self.align_states, "weighted": self.weighted, "members": [[cols, m.state()] for cols, m in self.members]}

    @classmethod
    def from_state(cls, state: dict) -> Ensemble:
        members = [(cols, HiddenMarkov.from_state(m)) for cols, m in state["members"]]
        return cls(len(members), state["states"], span=state["span"], align_states=state["align_states"], weighted=state["weighted"], members=members)


def hmm_ensemble(x: np.ndarray, models: int = 10, states: int = 3, seed: int = 7, align_states: bool = False, weighted: bool = False) -> np.ndarray:
    """Mean posterior of models on random subsets of smoothed features."""
    return Ensemble(models, states, seed, align_states=align_states, weighted=weighted).fit(x).posterior(x)


@dataclass
class NextRegime:
    """The regime after this one, from the one now and the features: a softmax of its own for each regime now."""

    states: int = 3
    rate: float = 2.0
    rounds: int = 500
    ridge: float = 1e-3

    def _inputs(self, now: np.ndarray, x: np.ndarray) -> np.ndarray:
        own = np.column_stack(((x - self.mean) / self.sd, np.ones(len(x))))
        return (np.eye(self.states)[now][:, :, None] * own[:, None, :]).reshape(len(x), -1)

    def fit(self, regime: np.ndarray, x: np.ndarray) -> NextRegime:
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.sd = np.where(sd > 0, sd, 1.0)
        a, y = self._inputs(regime[:-1], x[:-1]), np.eye(self.states)[regime[1:]]
        self.weights = np.zeros((a.shape[1], self.states))
        for _ in range(self.rounds):
            p = _soft(a @ self.weights)[0]
            self.weights -= self.rate * (a.T @ (p - y) / max(len(a), 1) + self.ridge * self.weights)
        return self

    def predict(self, now: int, x: np.ndarray) -> np.ndarray:
        """Shares of the next regimes after one row."""
        return _soft(self._inputs(np.array([now]), x[None, :]) @ self.weights)[0][0]

    def walk(self, first: int, x: np.ndarray, gate: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Regimes step by step from the predicted one before; below ``gate`` the regime stays as it is."""
        now, path, sure = first, np.empty(len(x), dtype=np.int32), np.empty(len(x))
        for i, row in enumerate(x):
            p = self.predict(now, row)
            now = int(p.argmax()) if p.max() >= gate else now
            path[i], sure[i] = now, p.max()
        return path, sure


def detect(bars: DataFrame, names: list[str], states: int = 3, train_share: float = 0.7, train_until: str | None = None, ensemble: int = 0, gate: float = 0.0) -> DataFrame:
    """Regimes of each symbol by a hidden Markov model, or a mean of ``ensemble`` of them: a task per symbol.

    Models are fitted on the rows up to ``train_until``, or on the first ``train_share`` of them; such rows are
    marked ``fitted``. A row's ``regime`` uses rows up to its own only (``confidence`` is its share), and
    ``next_regime`` is what a model of the training rows expects after it. With ``train_until``, rows that come
    later change nothing before them.
    """
    end = pd.Timestamp(train_until) if train_until else None

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        x = pdf[names].fillna(0.0).to_numpy(dtype=np.float64)
        head = int((pdf["ts"] <= end).sum()) if end is not None else int(len(x) * train_share)
        head = max(head, min(len(x), 30))
        x = (x - x[:head].mean(axis=0)) / np.where(x[:head].std(axis=0) == 0, 1, x[:head].std(axis=0))
        model = Ensemble(ensemble, states, align_states=True).fit(x[:head]) if ensemble else HiddenMarkov(states).fit(x[:head])
        order = np.arange(states) if ensemble else np.argsort(model.means[:, 0], kind="stable")
        p = model.filtered(x)[:, order]
        regime = p.argmax(axis=1).astype(np.int32)
        after = NextRegime(states).fit(regime[:head], x[:head])
        expected = np.empty(len(x), dtype=np.int32)
        for i, row in enumerate(x):
            share = after.predict(int(regime[i]), row)
            expected[i] = int(share.argmax()) if share.max() >= gate else regime[i]
        return pdf[["symbol", "ts", "close"]].assign(regime=regime, confidence=p.max(axis=1), next_regime=expected, fitted=np.arange(len(x)) < head)

    schema = "symbol string, ts timestamp, close double, regime int, confidence double, next_regime int, fitted boolean"
    return bars.select("symbol", "ts", "close", *names).groupBy("symbol").applyInPandas(work, schema)


def validate(labelled: DataFrame) -> DataFrame:
    """Per symbol and regime: share of rows, number of entries and mean length of a stay."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = labelled.withColumn("_new", (F.lag("regime").over(w).isNull() | (F.lag("regime").over(w) != c("regime"))).cast("long"))
    g = rows.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.sum("_new").alias("entries"))
    return g.select("symbol", "regime", (c("n") / F.sum("n").over(Window.partitionBy("symbol"))).alias("share"), "entries", (c("n") / c("entries")).alias("mean_stay"))

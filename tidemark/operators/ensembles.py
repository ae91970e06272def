"""Ensembles of hidden Markov models as a relation of (symbol, member).

Members are dealt into blocks; a block is fitted in a task of its own on the symbol's training rows, so that the members
of one symbol spread over the cluster and one copy of the rows serves a block. Each member sees a random subset of the
smoothed features. Of the fitted models, those that broke down, have not converged or whose likelihood fell in the last round
are dropped. The states of the others are matched by assignment: a state's signature is the mean of all features under its
posterior, on the training rows, and members are turned so that their signatures lie nearest to the mean one; states go by the
signature's first feature. A row's regime is the greatest of the members' mean shares, each from rows up to its own.

Rows need a symbol and a time. Missing features count as 0 before standardising, which takes the training rows' means and
deviations. A symbol all of whose members are dropped has null regimes. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.regimes import HiddenMarkov, NextRegime
from tidemark.sources.tables import written

c = F.col
MODELS = "symbol string, block int, member int, features array<int>, status string, likelihood double, rounds int, signature array<double>, state string"


@dataclass(frozen=True)
class EnsembleSpec:
    """How members are drawn and fitted. ``weights`` favours small subsets: linear, quadratic, exponential or uniform."""

    members: int = 24
    states: int = 2
    least_features: int = 3
    most_features: int = 8
    weights: str = "linear"
    stay: float = 0.85
    spherical: bool = True
    floor: float = 0.05
    rounds: int = 200
    span: int = 100
    smooth: bool = True
    seed: int = 0
    block: int = 4
    train_share: float = 0.7
    train_until: str | None = None

    def head(self, ts: pd.Series) -> int:
        """The number of training rows of a symbol's rows in order of time."""
        n = int((ts <= pd.Timestamp(self.train_until)).sum()) if self.train_until else int(len(ts) * self.train_share)
        return max(n, min(len(ts), 30))

    def subset(self, member: int, width: int) -> list[int]:
        """The features of a member: their number by the weights, then which ones; the same for every symbol."""
        counts = np.arange(min(self.least_features, width), min(self.most_features, width) + 1)
        fall = np.arange(len(counts), 0, -1).astype(float)
        w = {"linear": fall, "quadratic": fall**2, "exponential": np.exp(-0.5 * np.arange(len(counts))), "uniform": np.ones(len(counts))}[self.weights]
        rng = np.random.default_rng([self.seed, member])
        n = int(rng.choice(counts, p=w / w.sum()))
        return np.sort(rng.choice(width, size=n, replace=False)).tolist()

    def prepared(self, rows: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
        """Standardised, smoothed features and the number of training rows; a row depends on rows up to its own and on the training rows only."""
        head = self.head(rows["ts"])
        x = rows[names].fillna(0.0).to_numpy(dtype=np.float64)
        sd = x[:head].std(axis=0)
        x = (x - x[:head].mean(axis=0)) / np.where(sd == 0, 1, sd)
        return (pd.DataFrame(x).ewm(span=self.span, min_periods=1).mean().to_numpy() if self.smooth else x), head


def fit_member(spec: EnsembleSpec, member: int, x: np.ndarray) -> dict:
    """One member's row of the models: what became of it, and its parameters."""
    columns = spec.subset(member, x.shape[1])
    model = HiddenMarkov(spec.states, spec.rounds, max(spec.stay, 0.5), spec.seed + member, spherical=spec.spherical, floor=spec.floor, stay=spec.stay)
    row = {"member": member, "features": columns, "likelihood": None, "rounds": 0, "signature": None, "state": None}
    try:
        model.fit(x[:, columns])
        share = model.posterior(x[:, columns])
    except np.linalg.LinAlgError:
        return row | {"status": "failed"}
    history = model.history
    if not math.isfinite(model.likelihood) or not np.isfinite(share).all():
        return row | {"status": "failed", "rounds": len(history)}
    fell = len(history) > 1 and history[-1] < history[-2]
    status = "not converged" if not model.converged else "unstable" if fell else "kept"
    signature = (share.T @ x) / (share.sum(axis=0)[:, None] + 1e-9)
    return row | {"status": status, "likelihood": model.likelihood, "rounds": len(history), "signature": signature.ravel().tolist(), "state": json.dumps(model.state())}


def fit_members(bars: DataFrame, names: list[str], spec: EnsembleSpec) -> DataFrame:
    """The models of all members of all symbols, as a written table: a task for each (symbol, block)."""
    blocks = math.ceil(spec.members / spec.block)
    rows = bars.select("symbol", "ts", *names, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        x, head = spec.prepared(pdf, names)
        block = int(pdf["block"].iloc[0])
        members = range(block * spec.block, min((block + 1) * spec.block, spec.members))
        found = pd.DataFrame([fit_member(spec, m, x[:head]) for m in members])
        found.insert(0, "symbol", pdf["symbol"].iloc[0])
        found.insert(1, "block", block)
        return found[[f.split()[0] for f in MODELS.split(", ")]]

    return written(rows.groupBy("symbol", "block").applyInPandas(fit, MODELS))


def rejections(models: DataFrame) -> DataFrame:
    """(symbol, members, kept, failed, not_converged, unstable): what became of the members."""
    count = lambda s: F.count(F.when(c("status") == s, 1)).alias(s.replace(" ", "_"))
    return models.groupBy("symbol").agg(F.count("*").alias("members"), *map(count, ("kept", "failed", "not converged", "unstable")))


def nearest_order(signature: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """For every state of ``middle`` the state of ``signature`` that the assignment of least squared distance gives it."""
    cost = ((middle[:, None, :] - signature[None, :, :]) ** 2).sum(axis=2)
    states = range(len(cost))
    if len(cost) <= 7:
        return np.array(min(itertools.permutations(states), key=lambda p: sum(cost[k, p[k]] for k in states)))
    # many states: exchanges of two until none is better
    order, better = np.arange(len(cost)), True
    while better:
        better = False
        for a, b in itertools.combinations(states, 2):
            if cost[a, order[b]] + cost[b, order[a]] < cost[a, order[a]] + cost[b, order[b]] - 1e-12:
                order[[a, b]] = order[[b, a]]
                better = True
    return order


def match_states(models: DataFrame, states: int, weighted: bool = False, rounds: int = 5) -> DataFrame:
    """(symbol, block, member, features, state, order, weight) of the kept members; their number bounds a group.

    With ``weighted`` a member weighs by its likelihood beside the best one's, else all weigh the same.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["likelihood", "member"], ascending=[False, True]).reset_index(drop=True)
        signatures = [np.array(s).reshape(states, -1) for s in pdf["signature"]]
        middle = signatures[0]
        for _ in range(rounds):
            orders = [nearest_order(s, middle) for s in signatures]
            middle = np.mean([s[o] for s, o in zip(signatures, orders, strict=True)], axis=0)
        by_level = np.argsort(middle[:, 0], kind="stable")
        pdf["order"] = [o[by_level].tolist() for o in orders]
        pdf["weight"] = np.exp(pdf["likelihood"] - pdf["likelihood"].max()) if weighted else 1.0
        return pdf[["symbol", "block", "member", "features", "state", "order", "weight"]]

    kept = models.where("status = 'kept'").select("symbol", "block", "member", "features", "likelihood", "signature", "state")
    schema = "symbol string, block int, member int, features array<int>, state string, order array<int>, weight double"
    return kept.groupBy("symbol").applyInPandas(match, schema)


def member_shares(bars: DataFrame, names: list[str], spec: EnsembleSpec, matched: DataFrame) -> DataFrame:
    """(symbol, ts, share_0 ..., mass): every block's weighted sum of its members' shares, from rows up to each."""
    share_names = [f"share_{k}" for k in range(spec.states)]

    def say(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=["symbol", "ts", *share_names, "mass"])
        if rows.empty or models.empty:
            return out
        rows = rows.sort_values("ts", kind="stable")
        x, _ = spec.prepared(rows, names)
        total = np.zeros((len(x), spec.states))
        for m in models.sort_values("member").itertuples():
            model = HiddenMarkov.from_state(json.loads(m.state))
            total += m.weight * model.filtered(x[:, list(m.features)])[:, list(m.order)]
        out = rows[["symbol", "ts"]].copy()
        out[share_names] = total
        return out.assign(mass=float(models["weight"].sum()))

    blocks = math.ceil(spec.members / spec.block)
    rows = bars.select("symbol", "ts", *names, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = "symbol string, ts timestamp, " + ", ".join(f"{n} double" for n in share_names) + ", mass double"
    return rows.groupBy("symbol", "block").cogroup(matched.groupBy("symbol", "block")).applyInPandas(say, schema)


def ensemble_regimes(bars: DataFrame, names: list[str], spec: EnsembleSpec, models: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """(symbol, ts, regime, confidence, members): the regime of each bar by the kept members' mean share, one bar per time.

    ``models`` are those of ``fit_members``, where they are kept from an earlier call.
    """
    models = fit_members(bars, names, spec) if models is None else models
    matched = match_states(models, spec.states, weighted)
    shares = member_shares(bars, names, spec, matched).groupBy("symbol", "ts").agg(*(F.sum(f"share_{k}").alias(f"share_{k}") for k in range(spec.states)), F.sum("mass").alias("mass"))
    share = F.array(*(F.try_divide(f"share_{k}", "mass") for k in range(spec.states)))
    best = shares.select("symbol", "ts", share.alias("p")).select("symbol", "ts", F.array_max("p").alias("confidence"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("regime"))
    kept = rejections(models).select("symbol", c("kept").alias("members"))
    return bars.select("symbol", "ts").join(best, ["symbol", "ts"], "left").join(kept, "symbol", "left").select("symbol", "ts", "regime", "confidence", "members")


def expected_next(bars: DataFrame, names: list[str], labelled: DataFrame, spec: EnsembleSpec, gate: float = 0.0) -> DataFrame:
    """``labelled`` with ``fitted`` and ``next_regime``: what a model of the training rows expects after each row."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        head = spec.head(pdf["ts"])
        out = pdf[["symbol", "ts", "close", "regime", "confidence", "members"]].copy()
        out["fitted"] = np.arange(len(pdf)) < head
        out["next_regime"] = pd.array([None] * len(pdf), dtype="Int32")
        if pdf["regime"].notna().all():
            x = pdf[names].fillna(0.0).to_numpy(dtype=np.float64)
            sd = x[:head].std(axis=0)
            x, regime = (x - x[:head].mean(axis=0)) / np.where(sd == 0, 1, sd), pdf["regime"].to_numpy(dtype=np.int32)
            after = NextRegime(spec.states).fit(regime[:head], x[:head])
            shares = [after.predict(int(now), row) for now, row in zip(regime, x, strict=True)]
            out["next_regime"] = pd.array([int(p.argmax()) if p.max() >= gate else int(now) for p, now in zip(shares, regime, strict=True)], dtype="Int32")
        return out

    schema = "symbol string, ts timestamp, close double, regime int, confidence double, members long, fitted boolean, next_regime int"
    return bars.select("symbol", "ts", "close", *names).join(labelled, ["symbol", "ts"]).groupBy("symbol").applyInPandas(work, schema)

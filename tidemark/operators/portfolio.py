"""Portfolio construction: weights from a covariance, schedules, overlays and the backtest."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import risk
from tidemark.operators.resample import asof_backward

c = F.col


def bounded_simplex(values: np.ndarray, lower: float = 0.0, upper: float = 1.0, total: float = 1.0) -> np.ndarray:
    """The nearest weights within bounds that sum to ``total``: bisection on the shift."""
    n = len(values)
    if not lower * n <= total <= upper * n + 1e-12:
        return np.full(n, total / n)
    a, b = float(np.min(values)) - upper, float(np.max(values)) - lower
    for _ in range(100):
        mid = (a + b) / 2
        a, b = (mid, b) if np.clip(values - mid, lower, upper).sum() > total else (a, mid)
    return np.clip(values - (a + b) / 2, lower, upper)


def equal(n: int) -> np.ndarray:
    return np.full(n, 1.0 / n)


def inverse_vol(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-18))
    return w / w.sum()


def descend(gradient: Callable[[np.ndarray], np.ndarray], n: int, rate: float, upper: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """Accelerated projected gradient on the bounded simplex."""
    w = look = equal(n)
    k = 1.0
    for _ in range(rounds):
        new = bounded_simplex(look - rate * gradient(look), 0.0, upper)
        k2 = (1 + math.sqrt(1 + 4 * k * k)) / 2
        look = new + (k - 1) / k2 * (new - w)
        if np.abs(new - w).max() < 1e-12:
            return new
        w, k = new, k2
    return w


def minimum_variance(cov: np.ndarray, cap: float = 1.0, ridge: float = 1e-8) -> np.ndarray:
    m = cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
    return descend(lambda w: m @ w, len(m), 1 / max(float(np.linalg.eigvalsh(m)[-1]), 1e-18), max(cap, 1 / len(m)))


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, cap: float = 1.0) -> np.ndarray:
    top = max(aversion * float(np.linalg.eigvalsh(cov)[-1]), 1e-12)
    return descend(lambda w: aversion * cov @ w - mu, len(mu), 1 / top, max(cap, 1 / len(mu)))


def max_sharpe(mu: np.ndarray, cov: np.ndarray, risk_free: float = 0.0, cap: float = 1.0) -> np.ndarray:
    """Long-only tangency weights: the best of the mean-variance frontier; none above cash: inverse volatility."""
    excess = mu - risk_free
    if (excess <= 0).all():
        return inverse_vol(cov)
    found = [mean_variance(excess, cov, g, cap) for g in np.geomspace(0.1, 1000, 25)]
    return max(found, key=lambda w: float(w @ excess) / math.sqrt(max(float(w @ cov @ w), 1e-18)))


def risk_parity(cov: np.ndarray, budgets: np.ndarray | None = None, rounds: int = 500) -> np.ndarray:
    """Equal (or given) shares of risk by cyclical coordinate descent."""
    n = len(cov)
    b = equal(n) if budgets is None else budgets / budgets.sum()
    w = inverse_vol(cov)
    for _ in range(rounds):
        old = w.copy()
        for i in range(n):
            rest = float(cov[i] @ w - cov[i, i] * w[i])
            w[i] = (-rest + math.sqrt(rest * rest + 4 * cov[i, i] * b[i])) / (2 * cov[i, i])
        if np.abs(w - old).max() < 1e-12:
            break
    return w / w.sum()


def tail_fractions(w: np.ndarray, x: np.ndarray, kind: str = "cvar", level: float = 0.05, worst: int = 10) -> np.ndarray:
    """Each asset's share of the loss on the worst days, or of its own ulcer."""
    if kind == "ulcer":
        curve = np.cumprod(1 + x, axis=0)
        own = w * np.sqrt(((1 - curve / np.maximum.accumulate(curve, axis=0)) ** 2).mean(axis=0))
    else:
        k = max(1, int(len(x) * level)) if kind == "cvar" else worst
        own = -w * x[np.argsort(x @ w, kind="stable")[:k]].mean(axis=0)
    return own / own.sum() if own.sum() else equal(len(w))


def tail_risk_parity(x: np.ndarray, kind: str = "cvar", rounds: int = 200, cov: np.ndarray | None = None) -> np.ndarray:
    """Weights that even out the tail shares by damped multiplicative steps."""
    w = inverse_vol(np.cov(x, rowvar=False) if cov is None else cov)
    best, error = w, math.inf
    for _ in range(rounds):
        f = tail_fractions(w, x, kind)
        if (e := float(((f - 1 / len(w)) ** 2).sum())) < error:
            best, error = w, e
        w = bounded_simplex(w * np.clip(1 / (len(w) * np.maximum(f, 1e-6)), 0.5, 2) ** 0.3)
    return best


def leaf_order(link: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves of the tree from left to right."""
    below = {i: [i] for i in range(n)}
    for step, (a, b, *_) in enumerate(link):
        below[n + step] = below[a] + below[b]
    return below[n + len(link) - 1] if link else list(range(n))


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    """Quasi-diagonal order, then bisection by inverse cluster variance."""
    order = leaf_order(risk.average_linkage(risk.correlation_distance(risk.correlation(cov))), len(cov))
    w = np.ones(len(cov))

    def variance(items: list[int]) -> float:
        m = cov[np.ix_(items, items)]
        iv = 1 / np.diag(m)
        return float(iv @ m @ iv / iv.sum() ** 2)

    halves = [order]
    while halves:
        items = halves.pop()
        if len(items) > 1:
            a, b = items[: len(items) // 2], items[len(items) // 2 :]
            va, vb = variance(a), variance(b)
            w[a] *= vb / (va + vb)
            w[b] *= va / (va + vb)
            halves += [a, b]
    return w / w.sum()


def nested_clusters(x: np.ndarray, risk_free: float = 0.0, cov: np.ndarray | None = None) -> np.ndarray:
    """Best Sharpe weights inside clusters, then across the clusters' own returns."""
    cov = np.cov(x, rowvar=False) if cov is None else cov
    groups = risk.onc(risk.correlation(cov)).members
    inner = [max_sharpe(x[:, g].mean(axis=0), np.atleast_2d(cov[np.ix_(g, g)]), risk_free) for g in groups]
    series = np.column_stack([x[:, g] @ w for g, w in zip(groups, inner, strict=True)])
    outer = max_sharpe(series.mean(axis=0), np.atleast_2d(np.cov(series, rowvar=False)), risk_free) if len(groups) > 1 else np.ones(1)
    out = np.zeros(x.shape[1])
    for g, w, o in zip(groups, inner, outer, strict=True):
        out[g] = w * o
    return out / out.sum()


def sub_strategies(cov: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the strategies that an ensemble blends."""
    return {"equal": equal(len(cov)), "inverse_vol": inverse_vol(cov), "minimum_variance": minimum_variance(cov), "risk_parity": risk_parity(cov), "hrp": hierarchical_risk_parity(cov)}


def blend(x: np.ndarray, subs: np.ndarray, how: str) -> np.ndarray:
    """Shares of sub-strategies (rows of weights), equally, by least variance or by hierarchy of their returns."""
    return equal(len(subs)) if how == "equal" else blend_of(np.cov(x @ subs.T, rowvar=False), how)


def blend_of(cov: np.ndarray, how: str) -> np.ndarray:
    """The same from the covariance of the sub-strategies' returns."""
    if how == "equal":
        return equal(len(cov))
    shrunk = 0.9 * cov + 0.1 * np.diag(np.diag(cov))
    return minimum_variance(shrunk) if how == "minvar" else hierarchical_risk_parity(shrunk)


def ensemble(x: np.ndarray, how: str = "equal", lower: float = 0.0, upper: float = 1.0, cov: np.ndarray | None = None) -> np.ndarray:
    """Sub-strategies blended equally, by least variance or by hierarchy of their returns."""
    subs = np.array(list(sub_strategies(np.cov(x, rowvar=False) if cov is None else cov).values()))
    return bounded_simplex(blend(x, subs, how) @ subs, lower, upper)


def diagnose(x: np.ndarray, how: str = "equal", cov: np.ndarray | None = None) -> pd.DataFrame:
    """Per sub-strategy: its share of the blend, the mean, deviation and mean correlation of its returns."""
    found = sub_strategies(np.cov(x, rowvar=False) if cov is None else cov)
    subs = np.array(list(found.values()))
    series = x @ subs.T
    r = np.corrcoef(series, rowvar=False)
    others = (r.sum(axis=0) - 1) / max(len(subs) - 1, 1)
    return pd.DataFrame({"strategy": list(found), "share": blend(x, subs, how), "mean": series.mean(axis=0), "sd": series.std(axis=0, ddof=1), "correlation": others})


def diagnose_moments(mean: np.ndarray, cov: np.ndarray, how: str = "equal") -> list[tuple[str, float, float, float, float]]:
    """``diagnose`` from the assets' means and covariance, which are aggregates: (strategy, share, mean, sd, correlation)."""
    found = sub_strategies(cov)
    subs = np.array(list(found.values()))
    own = subs @ cov @ subs.T
    sd = np.sqrt(np.diag(own))
    others = ((own / np.outer(sd, sd)).sum(axis=0) - 1) / max(len(subs) - 1, 1)
    return [(n, float(a), float(m), float(s), float(r)) for n, a, m, s, r in zip(found, blend_of(own, how), subs @ mean, sd, others, strict=True)]


#: Strategies from the rows of returns and a covariance of their columns, by whatever risk model.
STRATEGIES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "equal": lambda x, cov: equal(x.shape[1]),
    "inverse_vol": lambda x, cov: inverse_vol(cov),
    "minimum_variance": lambda x, cov: minimum_variance(cov),
    "mean_variance": lambda x, cov: mean_variance(x.mean(axis=0) * 252, cov * 252),
    "tangency": lambda x, cov: max_sharpe(np.expm1(np.log1p(x).mean(axis=0) * 252), cov * 252),
    "risk_parity": lambda x, cov: risk_parity(cov),
    "tail_risk_parity": lambda x, cov: tail_risk_parity(x, cov=cov),
    "hrp": lambda x, cov: hierarchical_risk_parity(cov),
    "nco": lambda x, cov: nested_clusters(x, cov=cov),
    "ensemble": lambda x, cov: ensemble(x, cov=cov),
}


def fit_t(x: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """Degrees of freedom, centre and scale of Student's t, by expectation and maximisation."""
    centre, scale = float(np.median(x)), max(float(x.std()), 1e-12)
    grid = np.concatenate((np.arange(2.1, 10, 0.1), np.geomspace(10, 200, 40)))
    log_gamma = np.vectorize(math.lgamma)
    constant = log_gamma((grid + 1) / 2) - log_gamma(grid / 2) - 0.5 * np.log(grid * math.pi)
    freedom = 8.0
    for _ in range(rounds):
        z = ((x - centre) / scale) ** 2
        u = (freedom + 1) / (freedom + z)
        new = float((u * x).sum() / u.sum())
        width = max(math.sqrt(float((u * (x - new) ** 2).mean())), 1e-12)
        z = ((x - new) / width) ** 2
        likely = constant - (grid + 1) / 2 * np.log1p(z[:, None] / grid).mean(axis=0)
        now = float(grid[int(np.argmax(likely))])
        still = abs(new - centre) < 1e-10 and abs(width - scale) < 1e-10 and now == freedom
        freedom, centre, scale = now, new, width
        if still:
            break
    return freedom, centre, scale


def drawn_fraction(x: np.ndarray, step: float = 0.01, most: float = 5.0, fraction: float = 0.5, draws: int = 200_000, margin: float = 0.0, seed: int = 42) -> float:
    """``fraction`` of the growth-optimal multiple over draws from the fitted t, clipped to the observed ends.

    ``margin`` widens the ends by a share of their distance from the centre. Draws pass in blocks.
    """
    if len(x) < 2 or not x.std():
        return 0.0
    freedom, centre, scale = fit_t(x)
    low, high = (centre + (end - centre) * (1 + margin) for end in (float(x.min()), float(x.max())))
    if low >= 0:
        return 0.0
    rng = np.random.default_rng(seed)
    grid, growth, n = np.arange(0.0, most + step / 2, step), 0.0, 0
    while n < draws:
        r = np.clip(centre + scale * rng.standard_t(freedom, min(10_000, draws - n)), low, high)
        growth = growth + np.log(np.maximum(1 + grid[:, None] * r[None, :] / abs(low), 1e-12)).sum(axis=1)
        n += len(r)
    return float(grid[int(np.argmax(growth))] * fraction)


def optimal_fraction(x: np.ndarray, step: float = 0.01, most: float = 5.0, fraction: float = 0.5) -> float:
    """``fraction`` of the growth-optimal multiple of the observed returns, by the worst one."""
    worst = float(x.min())
    if worst >= 0 or not len(x):
        return 0.0
    grid = np.arange(0.0, most + step / 2, step)
    with np.errstate(invalid="ignore", divide="ignore"):
        growth = np.log(np.maximum(1 + grid[:, None] * x[None, :] / abs(worst), 1e-12)).mean(axis=1)
    return float(grid[int(np.argmax(growth))] * fraction)


def windows_before(returns: DataFrame, dates: DataFrame, lookback: int) -> DataFrame:
    """Rows of returns with each ``date`` whose look-back holds them, found by their number in time.

    ``dates`` (ts) is a calendar, so a date's task gets at most ``lookback`` times the number of assets.
    """
    times = returns.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")))
    anchors = dates.join(times, "ts").select(c("ts").alias("date"), c("i").alias("at"))
    return returns.join(times, "ts").join(F.broadcast(anchors), (c("i") < c("at")) & (c("i") >= c("at") - lookback))


def weights_at(
    returns: DataFrame, dates: DataFrame, lookback: int = 252, strategies: tuple[str, ...] = tuple(STRATEGIES), risk_model: str = "sample", denoising: str | None = None
) -> DataFrame:
    """Weights of each strategy at each rebalance date, from the rows before it: one task per date.

    The covariance that strategies get is that of the risk model, denoised where asked.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="ts", columns="asset", values="ret", aggfunc="mean").sort_index().sort_index(axis=1)
        gaps, x = wide.to_numpy(), wide.fillna(0.0).to_numpy()
        usable = len(x) >= 60 and x.shape[1] > 1 and (x.std(axis=0) > 0).all()
        own = risk.estimate(gaps, risk_model, denoising) if usable else None
        rows = []
        for name in strategies:
            # variances alone need no positive matrix
            cov = risk.estimate(gaps, risk_model, denoising, psd=False) if usable and name == "inverse_vol" else own
            w = STRATEGIES[name](x, cov) if usable else equal(x.shape[1])
            rows += [(pdf["date"].iloc[0], name, a, float(v)) for a, v in zip(wide.columns, w, strict=True)]
        return pd.DataFrame(rows, columns=["date", "strategy", "asset", "weight"])

    dealt = windows_before(returns, dates, lookback)
    return dealt.groupBy("date").applyInPandas(work, "date timestamp, strategy string, asset string, weight double")


def fractions_at(returns: DataFrame, dates: DataFrame, lookback: int = 252, anchored: bool = False, draws: int = 100_000, least_rows: int = 60) -> DataFrame:
    """(date, asset, freedom, fraction): optimal fractions over the rows before each date, all of them if ``anchored``."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["ret"].dropna().to_numpy()
        if len(x) < least_rows:
            return pd.DataFrame(columns=["date", "asset", "freedom", "fraction"])
        return pdf.iloc[:1][["date", "asset"]].assign(freedom=fit_t(x)[0], fraction=drawn_fraction(x, draws=draws))

    dealt = windows_before(returns, dates, (1 << 30) if anchored else lookback)
    return dealt.groupBy("date", "asset").applyInPandas(work, "date timestamp, asset string, freedom double, fraction double")


def hold(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Portfolio returns of weights that hold from their date to the next one.

    Each strategy's weights are one list per date, as many as assets, and a date's list is found by the
    as-of join of the calendar of returns: rows meet one list per strategy, not all dates.
    """
    lists = weights.groupBy("strategy", c("date").alias("ts")).agg(F.map_from_entries(F.collect_list(F.struct("asset", "weight"))).alias("weights"))
    times = weights.select("strategy").distinct().crossJoin(returns.select("ts").distinct())
    held = asof_backward(times, lists, "strategy", ["weights"]).where("weights is not null")
    joined = returns.join(held, "ts").withColumn("_w", F.try_element_at("weights", c("asset")))
    return joined.where("_w is not null").groupBy("strategy", "ts").agg(F.sum(c("_w") * c("ret")).alias("ret"))


def equal_risk(returns: DataFrame, n: int = 60, decay: float = 0.94) -> DataFrame:
    """(ts, asset, weight): inverse volatility of the ``n`` rows before, newer ones weighing more, normalised per time.

    A time at which some asset has no volatility yet has equal weights.
    """
    past = Window.partitionBy("asset").orderBy("ts").rowsBetween(-n, -1)
    rows = returns.withColumn("_x", F.collect_list("ret").over(past))
    size = F.size("_x")
    weight = F.transform("_x", lambda x, i: F.pow(F.lit(decay), size - 1 - i))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumns({"_w": weight, "_s": total(weight)})
    rows = rows.withColumn("_m", F.try_divide(total(F.zip_with("_x", "_w", lambda x, w: x * w)), c("_s")))
    var = F.try_divide(total(F.zip_with("_x", "_w", lambda x, w: w * (x - c("_m")) * (x - c("_m")))), c("_s"))
    rows = rows.withColumn("_i", F.when((size >= n) & (var > 0), F.try_divide(F.lit(1.0), F.sqrt(var))))
    at = Window.partitionBy("ts")
    ready = F.count("_i").over(at) == F.count("*").over(at)
    return rows.select("ts", "asset", F.when(ready, c("_i") / F.sum("_i").over(at)).otherwise(1 / F.count("*").over(at)).alias("weight"))


def turnover(weights: DataFrame, halved: bool = True) -> DataFrame:
    """Per rebalance the sum of weight changes, halved or whole."""
    before = F.lag("weight").over(Window.partitionBy("strategy", "asset").orderBy("date"))
    moved = weights.withColumn("moved", F.abs(c("weight") - before))
    return moved.groupBy("strategy", "date").agg((F.sum("moved") * (0.5 if halved else 1.0)).alias("turnover"))


def scale_factors(returns: DataFrame, n: int = 60, target: float = 0.1, floor: float = 0.05, most: float = 10.0, days: int = 252) -> DataFrame:
    """Target volatility over that of the rows before, within a floor and a cap."""
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(-n, -1)
    vol = F.stddev_samp("ret").over(w) * math.sqrt(days)
    factor = F.least(target / F.greatest(vol, F.lit(floor)), F.lit(most))
    return returns.withColumn("scale", F.when(F.count("ret").over(w) >= n, factor).otherwise(1.0))


@dataclass(frozen=True)
class RiskRules:
    """Half the risk beyond a drawdown until it has healed, and none for the day beyond a daily loss."""

    halve_at: float = 0.075
    restore_at: float = 0.07
    daily_stop: float = 0.038


def apply_rules(returns: np.ndarray, days: np.ndarray, rules: RiskRules = RiskRules()) -> tuple[np.ndarray, np.ndarray]:
    """(equity, exposure) bar by bar under the rules."""
    equity = peak = start = 1.0
    half = stopped = False
    out, used = np.empty(len(returns)), np.empty(len(returns))
    for i, r in enumerate(returns.tolist()):
        if i == 0 or days[i] != days[i - 1]:
            start, stopped = equity, False
        used[i] = 0.0 if stopped else 0.5 if half else 1.0
        equity *= 1 + used[i] * r
        peak = max(peak, equity)
        fall = 1 - equity / peak
        half = fall >= rules.halve_at or (half and fall > rules.restore_at)
        stopped = stopped or equity / start - 1 <= -rules.daily_stop
        out[i] = equity
    return out, used


def backtest(portfolio_returns: DataFrame, capital: float = 100_000.0, rules: RiskRules | None = None) -> DataFrame:
    """Equity per strategy; a product without rules, else a kernel per strategy."""
    if rules is None:
        w = Window.partitionBy("strategy").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return portfolio_returns.withColumn("equity", capital * F.exp(F.sum(F.log1p("ret")).over(w)))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        equity, used = apply_rules(pdf["ret"].to_numpy(), pdf["ts"].dt.floor("D").to_numpy(), rules)
        return pdf[["strategy", "ts", "ret"]].assign(equity=capital * equity, exposure=used)

    return portfolio_returns.groupBy("strategy").applyInPandas(work, "strategy string, ts timestamp, ret double, equity double, exposure double")


@dataclass
class RiskAllocator:
    """Multipliers of strategies by how the last window compares with what training led to expect."""

    window: int = 63
    speed: float = 0.2
    slope: float = 0.5
    lowest: float = 0.5
    highest: float = 1.5
    cap: float = 0.7
    floor: float = 0.0
    most_turnover: float = 0.1
    expected: dict[str, np.ndarray] = field(default_factory=dict)
    spread: dict[str, np.ndarray] = field(default_factory=dict)
    multipliers: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def window_metrics(x: np.ndarray) -> np.ndarray:
        """Sharpe ratio, volatility, drawdown, hit rate."""
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        curve = np.cumprod(1 + x)
        return np.array([x.mean() / sd * math.sqrt(252) if sd else 0.0, sd * math.sqrt(252), float((1 - curve / np.maximum.accumulate(curve)).max()), float((x > 0).mean())])

    def fit(self, train: dict[str, np.ndarray]) -> RiskAllocator:
        for name, x in train.items():
            self.expected[name] = self.window_metrics(x)
            history = [self.window_metrics(x[i - self.window : i]) for i in range(self.window, len(x) + 1)]
            self.spread[name] = np.maximum(np.std(history, axis=0), 1e-9) if history else np.ones(4)
        return self

    def compute(self, recent: dict[str, np.ndarray]) -> dict[str, float]:
        """Multipliers from rows strictly before the date; too few rows leave them at 1."""
        for name, x in recent.items():
            if len(x) < self.window or name not in self.expected:
                self.multipliers.setdefault(name, 1.0)
                continue
            z = (self.window_metrics(x[-self.window :]) - self.expected[name]) / self.spread[name]
            score = float((z * np.array([1, -1, -1, 1])).mean())
            fresh = min(max(math.exp(self.slope * score), self.lowest), self.highest)
            self.multipliers[name] = self.speed * fresh + (1 - self.speed) * self.multipliers.get(name, 1.0)
        return dict(self.multipliers)

    def overlay(self, base: dict[str, float], multipliers: dict[str, float], before: dict[str, float] | None = None) -> dict[str, float]:
        """Weights times multipliers, normalised, within bounds, moved no further than the turnover cap."""
        names = list(base)
        raw = np.array([base[n] * multipliers.get(n, 1.0) for n in names])
        w = bounded_simplex(raw / raw.sum(), self.floor, max(self.cap, 1 / len(names)))
        if before is not None:
            old = np.array([before.get(n, 0.0) for n in names])
            moved = np.abs(w - old).sum()
            w = old + (w - old) * min(1.0, self.most_turnover / moved) if moved > 0 else w
        return dict(zip(names, w.tolist(), strict=True))

    def snapshot(self) -> dict[str, dict]:
        """What the allocator holds of each strategy: expected figures, their spread, and the multiplier."""
        return {n: {"expected": self.expected[n].tolist(), "spread": self.spread[n].tolist(), "multiplier": self.multipliers.get(n, 1.0)} for n in self.expected}


def allocate(returns: DataFrame, start: str, base: dict[str, float] | None = None, allocator: RiskAllocator | None = None, leverage: float = 1.0) -> DataFrame:
    """(date, asset, multiplier, weight, audit...): the allocator's weights on its own weekly schedule.

    ``returns`` (asset, ts, ret) are those of whole strategies or assets. The allocator is fitted on the rows
    before ``start``; from then on, the first day of each week moves the weights, from rows strictly before it.
    Its state goes from week to week, so the calendar, a row per day, is one task.
    """
    plan, begin = allocator or RiskAllocator(), pd.Timestamp(start)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="ts", columns="asset", values="ret", aggfunc="mean").fillna(0.0).sort_index().sort_index(axis=1)
        names = list(wide.columns)
        fixed = base or dict.fromkeys(names, 1.0 / len(names))
        before, after = wide[wide.index < begin], wide.index[wide.index >= begin]
        own = replace(plan, expected={}, spread={}, multipliers={}).fit({n: before[n].to_numpy() for n in names})
        rows, held = [], None
        for day in pd.Series(after).groupby(after.isocalendar().year.to_numpy() * 100 + after.isocalendar().week.to_numpy()).min():
            multipliers = own.compute({n: wide.loc[wide.index < day, n].to_numpy() for n in names})
            weights = own.overlay(fixed, multipliers, held)
            moved = sum(abs(weights[n] - (held or {}).get(n, 0.0)) for n in names)
            rows += [(day, n, fixed[n], multipliers[n], leverage * weights[n], moved) for n in names]
            held = weights
        return pd.DataFrame(rows, columns=["date", "asset", "base", "multiplier", "weight", "moved"])

    schema = "date timestamp, asset string, base double, multiplier double, weight double, moved double"
    return returns.select(F.lit("all").alias("book"), "asset", "ts", "ret").groupBy("book").applyInPandas(work, schema)

"""Resampling statistics: simulations are a relation of seeds, each task draws its own paths."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stationary_indices(rng: np.random.Generator, n: int, length: int, block: float, circular: bool = True) -> np.ndarray:
    """Row numbers of a stationary bootstrap: blocks of geometric length from random starts."""
    if block >= n and not circular:
        return rng.integers(0, n, length)
    fresh = rng.random(length) < 1 / block
    fresh[0] = True
    start = rng.integers(0, n, length)
    at = np.maximum.accumulate(np.where(fresh, np.arange(length), 0))
    out = start[at] + np.arange(length) - at
    return out % n if circular else np.minimum(out, n - 1)


def optimal_block(x: np.ndarray) -> float:
    """Automatic block length by the flat-top kernel of Politis and White."""
    n = len(x)
    if n < 10 or x.std() == 0:
        return 1.0
    x = x - x.mean()
    most = min(n - 1, int(math.ceil(math.sqrt(n))) + max(5, int(math.log10(n))))
    acov = np.array([float(x[: n - k] @ x[k:]) / n for k in range(most + 1)])
    rho, limit = acov / acov[0], 2 * math.sqrt(math.log10(n) / n)
    run = max(5, int(math.sqrt(math.log10(n))))
    quiet = next((k for k in range(1, most - run + 2) if (np.abs(rho[k : k + run]) < limit).all()), most)
    m = min(2 * max(quiet - 1, 1), most)
    k = np.arange(1, m + 1)
    taper = np.where(k / m <= 0.5, 1.0, 2 * (1 - k / m))
    g, spectrum = 2 * float((taper * k * acov[1 : m + 1]).sum()), acov[0] + 2 * float((taper * acov[1 : m + 1]).sum())
    return float(min(max((2 * g * g / (2 * spectrum**2)) ** (1 / 3) * n ** (1 / 3), 1.0), math.ceil(min(3 * math.sqrt(n), n / 3))))


def fit_gpd(excess: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of a generalised Pareto tail by probability-weighted moments."""
    x = np.sort(excess)
    a = x.mean()
    b = float((x * (1 - (np.arange(1, len(x) + 1) - 0.35) / len(x))).mean())
    return float(2 - a / (a - 2 * b)), float(2 * a * b / (a - 2 * b))


def tail_value(losses: np.ndarray, level: float = 0.99, threshold: float = 0.95) -> float:
    """Value at risk by peaks over a threshold."""
    u = float(np.quantile(losses, threshold))
    excess = losses[losses > u] - u
    if len(excess) < 5:
        return float(np.quantile(losses, level))
    shape, scale = fit_gpd(excess)
    ratio = len(losses) / len(excess) * (1 - level)
    return u + (scale / shape * (ratio**-shape - 1) if abs(shape) > 1e-9 else -scale * math.log(ratio))


def simulate(x: np.ndarray, method: str, rng: np.random.Generator, block: float = 10.0, tail_scale: float = 1.0) -> np.ndarray:
    """One path: a permutation, a block bootstrap, or one whose tails are drawn anew."""
    if method == "iid":
        return rng.permutation(x)
    path = x[stationary_indices(rng, len(x), len(x), block)] * tail_scale
    if method == "semiparametric":
        for q, sign in ((0.95, 1), (0.05, -1)):
            u = float(np.quantile(x, q))
            excess = sign * (x[sign * x > sign * u] - u)
            out = sign * path > sign * u
            if len(excess) >= 10 and out.any():
                shape, scale = fit_gpd(excess)
                v = rng.random(int(out.sum()))
                draw = scale / shape * ((1 - v) ** -shape - 1) if abs(shape) > 1e-9 else -scale * np.log1p(-v)
                path[out] = u + sign * draw * tail_scale
    return path


def path_metrics(r: np.ndarray, years: float, cash: float = 1.0) -> dict[str, float]:
    curve = cash * np.cumprod(1 + np.maximum(r, -0.999999))
    peak = np.maximum.accumulate(np.concatenate(([cash], curve)))[1:]
    fall = float(((curve - peak) / peak).min())
    cagr = (curve[-1] / cash) ** (1 / years) - 1
    sd = r.std(ddof=1)
    return {"terminal": float(curve[-1]), "max_drawdown": fall, "calmar": cagr / abs(fall) if fall else 0.0, "sharpe": float(r.mean() / sd * math.sqrt(252)) if sd else 0.0}


METRICS = ("terminal", "max_drawdown", "calmar", "sharpe")


def monte_carlo(rows: DataFrame, key: str, value: str, order: list[str], method: str = "stationary", paths: int = 1000, batch: int = 100, seed: int = 7, block: float = 10.0) -> DataFrame:
    """(key, sim, metrics) of simulated paths of each key's series.

    A key's series is gathered once and dealt out with batches of seeds; what is random depends on the
    key's seed and the path's number only, so a lost task gives the same paths again.
    """
    series = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias("x"))
    dealt = series.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(batch))))
    dealt = dealt.repartition(key, "first")
    kind = dict(rows.dtypes)[key]

    def work(batches):
        for pdf in batches:
            out = []
            for k, x, first in zip(pdf[key], pdf["x"], pdf["first"], strict=True):
                x = np.asarray(x, dtype=np.float64)
                for sim in range(first, min(first + batch, paths)):
                    m = path_metrics(simulate(x, method, np.random.default_rng([seed, sim]), block), max(len(x) / 252, 1e-9))
                    out.append((k, sim, *(m[n] for n in METRICS)))
            yield pd.DataFrame(out, columns=[key, "sim", *METRICS])

    return dealt.mapInPandas(work, f"{key} {kind}, sim int, " + ", ".join(f"{n} double" for n in METRICS))


def summarise(sims: DataFrame, key: str, actual: DataFrame | None = None) -> DataFrame:
    """Percentiles and means over the simulations of each key and metric.

    With ``actual`` (the key and the metrics of the real path), also the share of simulations below it, ties
    by half, as ``rank``.
    """
    tall = sims.unpivot([key], list(METRICS), "metric", "value")
    if actual is not None:
        real = actual.unpivot([key], list(METRICS), "metric", "real")
        tall = tall.join(real, [key, "metric"])
    q = F.percentile("value", [0.05, 0.25, 0.5, 0.75, 0.95])
    place = [] if actual is None else [
        F.first("real").alias("real"), F.avg(F.when(F.col("value") < F.col("real"), 1.0).when(F.col("value") == F.col("real"), 0.5).otherwise(0.0)).alias("rank")
    ]
    return tall.groupBy(key, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), *(q[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))), *place)


def real_path(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The metrics of each key's own series, as those of a simulation."""
    kind = dict(rows.dtypes)[key]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=np.float64)
        m = path_metrics(x, max(len(x) / 252, 1e-9))
        return pd.DataFrame([(pdf[key].iloc[0], *(m[n] for n in METRICS))], columns=[key, *METRICS])

    return rows.select(key, *order, value).groupBy(key).applyInPandas(work, f"{key} {kind}, " + ", ".join(f"{n} double" for n in METRICS))


def permute_bars(b: dict[str, np.ndarray], days: np.ndarray, rng: np.random.Generator, method: str = "permutation") -> dict[str, np.ndarray]:
    """Synthetic bars: high, low and close relative to the open are shuffled together, day gaps apart."""
    lo = {k: np.log(b[k]) for k in ("open", "high", "low", "close")}
    n = len(lo["open"])
    gap = np.concatenate(([0.0], lo["open"][1:] - lo["close"][:-1]))
    overnight = np.concatenate(([False], days[1:] != days[:-1]))
    gap = np.where(overnight, gap, 0.0)
    rel = np.column_stack([lo[k] - lo["open"] for k in ("high", "low", "close")])
    if method == "permutation":
        pick = rng.permutation(n)
        gap[overnight] = rng.permutation(gap[overnight])
    else:
        pick = stationary_indices(rng, n, n, optimal_block(rel[:, 2]), circular=False)
    rel = rel[pick]
    close = lo["open"][0] + np.cumsum(gap + rel[:, 2])
    start = np.concatenate(([lo["open"][0]], close[:-1])) + gap
    high, low = np.maximum(start + rel[:, 0], np.maximum(start, close)), np.minimum(start + rel[:, 1], np.minimum(start, close))
    return {"open": np.exp(start), "high": np.exp(high), "low": np.exp(low), "close": np.exp(close)}


def permutation_p_value(real: float, permuted: np.ndarray) -> float:
    return (int((permuted >= real).sum()) + 1) / (len(permuted) + 1)


def reality_check(performance: np.ndarray, rounds: int = 500, block: float = 10.0, studentise: bool = True, recenter: bool = True, seed: int = 7) -> float:
    """P-value that the best of several series beats zero by luck (White; Hansen where ``studentise``).

    Replicates are recentred by the sample's mean; without, they have that mean themselves, and no gain is ever surprising.
    Over a table of many strategies, ``reality.reality_check`` does the same and more.
    """
    n = len(performance)
    mean = performance.mean(axis=0)
    sd = performance.std(axis=0, ddof=1) if studentise else np.ones(len(mean))
    sd = np.where(sd > 0, sd, 1)
    real = math.sqrt(n) * float((mean / sd).max())
    rng = np.random.default_rng(seed)
    boot = np.array([((performance[stationary_indices(rng, n, n, block)].mean(axis=0) - (mean if recenter else 0)) / sd).max() for _ in range(rounds)])
    return float((math.sqrt(n) * boot >= real).mean())


def chi2_survival(x: float, k: int) -> float:
    """Upper tail of a chi-square with an even number ``k`` of degrees of freedom: a Poisson sum."""
    term = total = math.exp(-x / 2)
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return min(1.0, total)


def combine_p_values(p: list[float], method: str = "fisher") -> float:
    """One p-value of independent tests: Fisher, Pearson or Stouffer."""
    q = [min(max(x, 1e-300), 1 - 1e-16) for x in p if x == x and 0 <= x <= 1]
    if not q:
        return math.nan
    if method == "fisher":
        return chi2_survival(-2 * sum(math.log(x) for x in q), 2 * len(q))
    if method == "pearson":
        return 1 - chi2_survival(-2 * sum(math.log1p(-x) for x in q), 2 * len(q))
    d = NormalDist()
    return 1 - d.cdf(sum(d.inv_cdf(1 - x) for x in q) / math.sqrt(len(q)))

"""Strategy backtests by bar replay, parameter search as a fan-out of tasks, and parameter stability.

Bar replay: a signal of one bar is filled at the next bar's open, one unit, with the spread paid half
on entry and half on exit; an opposite signal turns the position, zero closes it, what is open at the
end is closed at the last close.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
Signal = Callable[[dict[str, np.ndarray], dict], np.ndarray]


def replay(b: dict[str, np.ndarray], signal: np.ndarray, spread: float = 0.0, cash: float = 100_000.0) -> tuple[np.ndarray, list[tuple]]:
    """(equity per bar, trades (entry bar, exit bar, size, entry price, exit price, pnl))."""
    equity, trades = np.empty(len(signal)), []
    size, entry, at, done = 0.0, 0.0, -1, 0.0
    for i in range(len(signal)):
        want = float(signal[i - 1]) if i and signal[i - 1] == signal[i - 1] else 0.0
        price = b["open"][i]
        if want != size:
            if size:
                out = price - size * spread / 2
                done += size * (out - entry)
                trades.append((at, i, size, entry, out, size * (out - entry)))
            size, entry, at = want, price + want * spread / 2, i
        equity[i] = cash + done + size * (b["close"][i] - entry)
    if size:
        out = b["close"][-1] - size * spread / 2
        trades.append((at, len(signal) - 1, size, entry, out, size * (out - entry)))
        equity[-1] = cash + done + size * (out - entry)
    return equity, trades


def score(equity: np.ndarray, trades: list[tuple]) -> dict[str, float]:
    r = np.diff(equity) / equity[:-1] if len(equity) > 1 else np.zeros(1)
    sd = r.std(ddof=1) if len(r) > 1 else 0.0
    pnl = np.array([t[5] for t in trades])
    loss = -pnl[pnl < 0].sum() if len(pnl) else 0.0
    peak = np.maximum.accumulate(equity)
    return {
        "sharpe": float(r.mean() / sd * math.sqrt(252)) if sd else 0.0, "total_return": float(equity[-1] / equity[0] - 1), "max_drawdown": float((1 - equity / peak).max()),
        "trades": float(len(pnl)), "win_rate": float((pnl > 0).mean()) if len(pnl) else 0.0, "profit_factor": float(pnl[pnl > 0].sum() / loss) if loss else 0.0,
    }


SCORES = ("sharpe", "total_return", "max_drawdown", "trades", "win_rate", "profit_factor")


def moving_cross(b: dict[str, np.ndarray], p: dict) -> np.ndarray:
    """Long while the fast average is above the slow one, else short."""
    s = pd.Series(b["close"])
    fast, slow = s.rolling(int(p["fast"])).mean(), s.rolling(int(p["slow"])).mean()
    return np.sign(fast - slow).fillna(0.0).to_numpy()


def buy_and_hold(b: dict[str, np.ndarray], p: dict) -> np.ndarray:
    return np.ones(len(b["close"]))


def gated(signal: np.ndarray, probability: np.ndarray, long_gate: float, short_gate: float) -> np.ndarray:
    """Signals that a finite probability of at least their gate lets through."""
    ok = np.isfinite(probability) & np.where(signal > 0, probability >= long_gate, probability >= short_gate)
    return np.where(ok, signal, 0.0)


def position_size(equity: float, stop_distance: float, share: float = 0.01) -> int:
    return int(equity * share / stop_distance) if stop_distance > 0 else 0


def grid(spark: SparkSession, space: dict, constraint: Callable[[dict], bool] | None = None, points: int = 15) -> DataFrame:
    """(param_id, params as JSON) of a parameter space.

    A tuple is a choice, ``[lo, hi]`` a range (whole numbers, or ``points`` steps), another list a
    choice, a scalar itself. The space is small and made on the driver; what it costs runs in tasks.
    """

    def values(v):
        if isinstance(v, tuple):
            return list(v)
        if isinstance(v, list) and len(v) == 2 and all(isinstance(x, (int, float)) for x in v):
            return list(range(v[0], v[1] + 1)) if all(isinstance(x, int) for x in v) else np.linspace(v[0], v[1], points).tolist()
        return v if isinstance(v, list) else [v]

    rows = [dict(zip(space, combo, strict=True)) for combo in itertools.product(*map(values, space.values()))]
    rows = [r for r in rows if constraint is None or constraint(r)]
    return spark.createDataFrame([(i, json.dumps(r, sort_keys=True)) for i, r in enumerate(rows)], "param_id int, params string")


def run_grid(bars: DataFrame, params: DataFrame, signal: Signal, spread: float = 0.0, per_task: int = 16) -> DataFrame:
    """Scores of every parameter set on every symbol: one task per symbol and block of ``per_task`` sets.

    A symbol's bars are packed into one row, which is dealt to each block of sets; errors of a set give nulls.
    """
    fields = ("ts", "open", "high", "low", "close", "volume")
    packed = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("bars"))
    blocks = params.groupBy(F.floor(c("param_id") / per_task).alias("block")).agg(F.collect_list(F.struct("param_id", "params")).alias("sets"))
    dealt = packed.crossJoin(F.broadcast(blocks)).repartition("symbol", "block")

    def work(batches):
        for pdf in batches:
            out = []
            for symbol, rows, sets in zip(pdf["symbol"], pdf["bars"], pdf["sets"], strict=True):
                b = {k: np.array([r[k] for r in rows], dtype=np.float64) for k in fields[1:]}
                for one in sets:
                    try:
                        found = score(*replay(b, signal(b, json.loads(one["params"])), spread))
                    except (ValueError, KeyError, ZeroDivisionError):
                        found = dict.fromkeys(SCORES)
                    out.append((symbol, one["param_id"], one["params"], *(found[k] for k in SCORES)))
            yield pd.DataFrame(out, columns=["symbol", "param_id", "params", *SCORES])

    return dealt.mapInPandas(work, "symbol string, param_id int, params string, " + ", ".join(f"{k} double" for k in SCORES))


def versus(scores: DataFrame, base: DataFrame) -> DataFrame:
    """Scores of a strategy beside those of a base on the same symbols, and what is between them."""
    other = base.select("symbol", *(c(k).alias(f"base_{k}") for k in SCORES))
    both = scores.select("symbol", *SCORES).join(other, "symbol")
    return both.withColumns({f"{k}_gain": c(k) - c(f"base_{k}") for k in ("sharpe", "total_return", "max_drawdown")})


def best_per(df: DataFrame, metric: str, *keys: str, largest: bool = True) -> DataFrame:
    """The parameter set of best score per key; equal scores go to the least id."""
    value = c(metric) if largest else -c(metric)
    return df.groupBy(*keys).agg(F.max_by(F.struct("param_id", "params", metric), F.struct(value, -c("param_id"))).alias("b")).select(*keys, "b.*")


def walk_forward(bars: DataFrame, folds: DataFrame, params: DataFrame, signal: Signal, metric: str = "sharpe") -> DataFrame:
    """In-sample choice and out-of-sample score per symbol and fold; ``folds`` are rows with (fold, role)."""

    def part(role: str) -> DataFrame:
        # the symbol and its fold together are the key of a replay
        rows = folds.where(c("role") == role).withColumn("symbol", F.to_json(F.struct("symbol", "fold")))
        return run_grid(rows.select("symbol", "ts", "open", "high", "low", "close", "volume"), params, signal)

    chosen = best_per(part("train").where(c(metric).isNotNull()), metric, "symbol").withColumnRenamed(metric, "is_score")
    both = chosen.join(part("test").select("symbol", "param_id", *SCORES), ["symbol", "param_id"])
    key = F.from_json("symbol", "symbol string, fold int")
    return both.withColumn("_k", key).withColumns({"symbol": c("_k.symbol"), "fold": c("_k.fold"), "efficiency": F.try_divide(metric, "is_score")}).drop("_k")


def propose(history: list[tuple[dict, float]], space: dict[str, list], n: int, rng: np.random.Generator, first: int = 8, good: float = 0.25, explore: float = 0.2) -> list[dict]:
    """``n`` parameter sets to try next: at random at first, then values that the best trials hold more often than the others."""
    out = []
    ranked = [p for p, v in sorted(history, key=lambda h: -h[1])]
    best, rest = ranked[: max(1, int(len(ranked) * good))], ranked[max(1, int(len(ranked) * good)) :]
    for _ in range(n):
        chosen = {}
        for name, values in space.items():
            odds = np.ones(len(values))
            if len(history) >= first and rng.random() > explore:
                odds = np.array([(1 + sum(p[name] == v for p in best)) / (1 + sum(p[name] == v for p in rest)) for v in values])
            chosen[name] = values[int(rng.choice(len(values), p=odds / odds.sum()))]
        out.append(chosen)
    return out


def learned_search(bars: DataFrame, space: dict[str, list], signal: Signal, metric: str = "sharpe", trials: int = 24, batch: int = 8, seed: int = 7) -> DataFrame:
    """(number, params, value) of trials that learn from those before: batches run as one fan-out each.

    A trial's value is the metric's mean over the symbols; parameter sets met before are not run again. The
    history, a row per trial, is all the driver holds.
    """
    rng, spark = np.random.default_rng(seed), bars.sparkSession
    known: dict[str, float] = {}
    rows: list[tuple[int, str, float | None]] = []
    while len(rows) < trials:
        history = [(json.loads(p), v) for _, p, v in rows if v is not None]
        texts = [json.dumps(p, sort_keys=True) for p in propose(history, space, min(batch, trials - len(rows)), rng, batch)]
        fresh = sorted({t for t in texts if t not in known})
        if fresh:
            params = spark.createDataFrame(list(enumerate(fresh)), "param_id int, params string")
            found = run_grid(bars, params, signal).groupBy("params").agg(F.avg(metric).alias("v")).collect()
            known |= {r.params: r.v for r in found}
        rows += [(len(rows) + k, t, known.get(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "number int, params string, value double")


def path_metrics(folds: DataFrame, key: str = "param_id", value: str = "sharpe") -> DataFrame:
    """Mean, median, deviation and consistency 1 / (1 + |variation|) of fold scores."""
    g = folds.where(c(value).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, 0.25).alias("p25"), F.min(value).alias("low"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))
    return g.withColumn("consistency", 1 / (1 + F.coalesce(F.abs(F.try_divide("sd", "mean")), F.lit(0.0))))


def scaled(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with each name scaled to 0..1 as ``<name>_s``: one aggregate of the ends, joined back as one row."""
    ends = df.agg(*(f(n).alias(f"_{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))))
    both = df.crossJoin(F.broadcast(ends))
    return both.withColumns({f"{n}_s": F.coalesce(F.try_divide(c(n) - c(f"_lo_{n}"), c(f"_hi_{n}") - c(f"_lo_{n}")), F.lit(0.5)) for n in names}).drop(*ends.columns)


def dual_filter(metrics: DataFrame, quantile: float = 0.5, top: int = 20, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Parameter sets above a quantile of performance, ranked by performance, consistency and worst fold.

    Scores rank by nine digits, so that sets of equal folds go by their key.
    """
    floor = metrics.agg(F.percentile("median", quantile)).first()[0]
    good = scaled(metrics.where(c("median") >= floor), ["median", "consistency", "low"])
    total = weights[0] * c("median_s") + weights[1] * c("consistency_s") + weights[2] * c("low_s")
    return good.withColumn("score", total).orderBy(F.desc(F.round("score", 9)), "param_id").limit(top).select("param_id", "median", "consistency", "low", "score")


def neighbours(trials: DataFrame, names: list[str], value: str, radius: float = 0.15) -> DataFrame:
    """For each trial the weighted mean and variation of scores within a Manhattan radius of scaled parameters.

    The first parameters, two at most, are cut into cells of the radius: only rows of touching cells meet.
    """
    s = scaled(trials, names)
    pos = [f"{n}_s" for n in names]
    place = lambda p: F.floor(c(p) / radius).cast("int")
    left = s.select("number", *pos)
    right = s.select(c("number").alias("other"), *(c(p).alias(f"o_{p}") for p in pos), c(value).alias("v"))
    cells = [f"cell_{k}" for k in range(min(2, len(pos)))]
    for cell, p in zip(cells, pos, strict=False):
        left = left.withColumn(cell, F.explode(F.array(place(p) - 1, place(p), place(p) + 1)))
        right = right.withColumn(cell, place(f"o_{p}"))
    d = sum((F.abs(c(p) - c(f"o_{p}")) for p in pos), F.lit(0.0))
    near = left.join(right, cells).withColumn("d", d).where(c("d") <= radius)
    w = 1 - c("d") / (radius * 1.000001)
    g = near.groupBy("number").agg((F.sum(w * c("v")) / F.sum(w)).alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))
    return g.withColumn("stability", 1 / (1 + F.coalesce(F.abs(F.try_divide("sd", "mean")), F.lit(0.0))))


def tiers(df: DataFrame, names: dict[str, float]) -> DataFrame:
    """Components scaled by median and absolute deviation, weighted into a composite, ranked and tiered."""
    med = df.agg(*(F.median(n).alias(f"_m_{n}") for n in names))
    dev = df.crossJoin(F.broadcast(med)).agg(*(F.median(F.abs(c(n) - c(f"_m_{n}"))).alias(f"_d_{n}") for n in names))
    out = df.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(dev))
    unit = lambda n: (F.greatest(F.least(F.coalesce(F.try_divide(c(n) - c(f"_m_{n}"), 1.4826 * c(f"_d_{n}")), F.lit(0.0)), F.lit(3.0)), F.lit(-3.0)) + 3) / 6
    total = sum((w * unit(n) for n, w in names.items()), F.lit(0.0)) / sum(names.values())
    out = out.withColumn("composite", total).drop(*med.columns, *dev.columns)
    return out.withColumn("tier", F.when(c("composite") >= 0.7, 1).when(c("composite") >= 0.55, 2).when(c("composite") >= 0.4, 3).otherwise(4))


def trial_stability(trials: DataFrame, name: str, share: float = 0.1) -> DataFrame:
    """Mean, deviation and variation of a parameter over all completed trials and the best of them."""
    done = trials.where("state = 'COMPLETE'")
    cut = done.agg(F.percentile("score", 1 - share)).first()[0]
    rows = done.withColumn("part", F.explode(F.when(c("score") >= cut, F.array(F.lit("all"), F.lit("top"))).otherwise(F.array(F.lit("all")))))
    g = rows.groupBy("part").agg(F.count("*").alias("n"), F.avg(name).alias("mean"), F.stddev_samp(name).alias("sd"), F.mode(name, True).alias("mode"))
    return g.withColumn("cv", F.coalesce(F.try_divide("sd", "mean") * 100, F.lit(0.0)))


def heatmap(trials: DataFrame, x: str, y: str, value: str = "score") -> DataFrame:
    """Mean score per pair of values, and the mean over the neighbouring cells in x order."""
    g = trials.where("state = 'COMPLETE'").groupBy(x, y).agg(F.avg(value).alias("mean"))
    return g.withColumn("smooth", F.avg("mean").over(Window.partitionBy(y).orderBy(x).rowsBetween(-1, 1)))


def perturb(params: DataFrame, names: list[str], copies: int, radius: float = 0.1, seed: int = 7) -> DataFrame:
    """Jittered copies of numeric parameter columns, within ``radius`` of each value."""
    out = params.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    u = lambda n: F.pmod(F.xxhash64("param_id", "copy", F.lit(n), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    return out.withColumns({n: c(n) * (1 + radius * (2 * u(n) - 1)) for n in names})


def perturb_within(params: DataFrame, space: dict[str, tuple[float, float] | list], copies: int, radius: float = 0.1, flip: float = 0.1, seed: int = 7) -> DataFrame:
    """Copies of parameter sets moved inside their space: (low, high) for numbers, a list for categories.

    Whole numbers move by up to ``radius`` of their span, one at least; others by a part of it; both stay within their bounds. A
    category is drawn anew with the chance ``flip``. The draws come from ``param_id``, the copy and the name.
    """
    out = params.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = lambda *key: F.pmod(F.xxhash64("param_id", "copy", F.lit(seed), *map(F.lit, key)), F.lit(1_000_003)) / 1_000_003.0
    for name, spec in space.items():
        if isinstance(spec, tuple):
            low, high = spec
            if params.schema[name].dataType.typeName() in ("integer", "long", "short", "byte"):
                step = max(1, round(max(high - low, 1) * radius))
                moved = c(name) + (F.floor(draw(name) * (2 * step + 1)) - step)
            else:
                moved = c(name) + (high - low) * radius * (2 * draw(name) - 1)
            moved = F.greatest(F.least(moved, F.lit(high)), F.lit(low)).cast(params.schema[name].dataType)
        else:
            other = F.element_at(F.array(*map(F.lit, spec)), (F.floor(draw(name, "which") * len(spec)) + 1).cast("int"))
            moved = F.when(draw(name) < flip, other).otherwise(c(name))
        out = out.withColumn(name, F.when(c(name).isNotNull(), moved))
    return out


def adf(x: np.ndarray, most: int = 10) -> float:
    """Augmented Dickey-Fuller statistic with a constant, the number of lags by Akaike's criterion."""
    dx = np.diff(x)
    best = (math.inf, 0.0)
    for lags in range(most + 1):
        y = dx[most:]
        cols = [x[most:-1], np.ones(len(y)), *(dx[most - k : len(dx) - k] for k in range(1, lags + 1))]
        a = np.column_stack(cols)
        if len(y) <= a.shape[1] + 1:
            continue
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ beta
        s2 = float(e @ e) / len(y)
        aic = len(y) * math.log(max(s2, 1e-300)) + 2 * a.shape[1]
        if aic < best[0]:
            cov = np.linalg.pinv(a.T @ a) * float(e @ e) / (len(y) - a.shape[1])
            best = (aic, float(beta[0] / math.sqrt(max(cov[0, 0], 1e-300))))
    return best[1]


def optimal_difference(bars: DataFrame, critical: float = -2.86, steps: int = 11, tol: float = 1e-3) -> DataFrame:
    """Per symbol the least order of fractional differencing that makes the close stationary: a task per (symbol, order)."""
    from tidemark.operators.windows import fracdiff_weights

    packed = bars.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda s: s["close"]).alias("x"))
    orders = [k / (steps - 1) for k in range(steps)]
    dealt = packed.withColumn("d", F.explode(F.array(*map(F.lit, orders)))).repartition("symbol", "d")

    def work(batches):
        for pdf in batches:
            out = []
            for symbol, x, d in zip(pdf["symbol"], pdf["x"], pdf["d"], strict=True):
                w = np.array(fracdiff_weights(d, tol))[::-1]
                x = np.asarray(x, dtype=np.float64)
                y = np.convolve(x, w[::-1], mode="valid") if len(w) < len(x) else x[:0]
                out.append((symbol, d, adf(y) if len(y) >= 50 else math.inf))
            yield pd.DataFrame(out, columns=["symbol", "d", "adf"])

    tested = dealt.mapInPandas(work, "symbol string, d double, adf double")
    return tested.groupBy("symbol").agg(F.coalesce(F.min(F.when(c("adf") < critical, c("d"))), F.lit(1.0)).alias("d"))

"""Performance metrics of equity curves and trade ledgers: windows, islands and plain aggregates.

Every function works per key (``asset``, ``strategy`` or any grouping), so that curves are processed in
parallel; nothing is collected.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf

c = F.col
DAYS = 252


def upto(key: str, order: str = "ts"):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def log_returns(df: DataFrame, key: str = "asset") -> DataFrame:
    before = F.lag("equity").over(Window.partitionBy(key).orderBy("ts"))
    return df.withColumn("log_ret", F.log(c("equity") / before))


def drawdown(df: DataFrame, key: str = "asset") -> DataFrame:
    """1 - equity / running maximum."""
    return df.withColumn("drawdown", 1 - c("equity") / F.max("equity").over(upto(key)))


def drawdown_episodes(df: DataFrame, key: str = "asset") -> DataFrame:
    """Episodes between points without drawdown: start, duration in seconds, depth."""
    df = drawdown(df, key).withColumn("island", F.sum((c("drawdown") == 0).cast("int")).over(upto(key)))
    g = df.groupBy(key, "island").agg(
        F.min("ts").alias("start"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"), F.max("drawdown").alias("depth")
    )
    return g.where("depth > 0").drop("island")


def daily_equity(df: DataFrame, key: str = "asset") -> DataFrame:
    return df.groupBy(key, F.to_date("ts").alias("day")).agg(F.max_by("equity", "ts").alias("equity"))


def daily_returns(df: DataFrame, key: str = "asset") -> DataFrame:
    daily = daily_equity(df, key)
    return daily.withColumn("r", c("equity") / F.lag("equity").over(Window.partitionBy(key).orderBy("day")) - 1)


def _annual(mean_log: Column, var: Column, days: int) -> tuple[Column, Column]:
    """Annual return and volatility of daily geometric growth."""
    g = F.exp(mean_log) - 1
    return F.pow(1 + g, F.lit(days)) - 1, F.sqrt(F.pow(var + (1 + g) * (1 + g), F.lit(days)) - F.pow(1 + g, F.lit(2 * days)))


def annualized(df: DataFrame, key: str = "asset", days: int = DAYS, risk_free: float = 0.0) -> DataFrame:
    """Geometric annual return, volatility, Sharpe and Sortino ratios of daily returns."""
    g = daily_returns(df, key).where("r is not null").groupBy(key).agg(
        F.avg(F.log1p("r")).alias("m"), F.var_samp("r").alias("v"), F.avg(F.pow(F.least(c("r"), F.lit(0.0)), F.lit(2))).alias("down"), F.count("*").alias("days")
    )
    ret, vol = _annual(c("m"), c("v"), days)
    g = g.withColumns({"annual_return": ret, "annual_vol": vol})
    return g.select(
        key, "days", "annual_return", "annual_vol", F.try_divide(c("annual_return") - risk_free, "annual_vol").alias("sharpe"),
        F.try_divide(c("annual_return") - risk_free, F.sqrt("down") * math.sqrt(days)).alias("sortino"),
    )


def rolling_sharpe(df: DataFrame, key: str = "asset", n: int = 60, days: int = DAYS) -> DataFrame:
    w = Window.partitionBy(key).orderBy("day").rowsBetween(-(n - 1), 0)
    r = daily_returns(df, key).where("r is not null")
    ret, vol = _annual(F.avg(F.log1p("r")).over(w), F.var_samp("r").over(w), days)
    return r.select(key, "day", F.when(F.count("r").over(w) >= n, F.try_divide(ret, vol)).alias("rolling_sharpe")).where("rolling_sharpe is not null")


def adjusted_moments(key: str, rows: DataFrame, x: str = "r") -> DataFrame:
    """Mean, deviation, bias-corrected skewness and kurtosis (not excess) per key."""
    n = F.count(x).cast("double")
    g = rows.groupBy(key).agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    skew = F.sqrt(c("n") * (c("n") - 1)) / (c("n") - 2) * c("g1")
    kurt = (c("n") - 1) / ((c("n") - 2) * (c("n") - 3)) * ((c("n") + 1) * c("g2") + 6) + 3
    return g.withColumns({"skew": skew, "kurt": kurt})


def probabilistic_sharpe(df: DataFrame, key: str = "asset", benchmark: float = 1.0, alpha: float = 0.05, days: int = DAYS) -> DataFrame:
    """Probability that the daily Sharpe ratio beats the benchmark, and the record length that would prove it."""
    m = adjusted_moments(key, daily_returns(df, key).where("r is not null"))
    sr, bench = c("mean") / c("sd"), benchmark / math.sqrt(days)
    spread = 1 - c("skew") * sr + (c("kurt") - 1) / 4 * sr * sr
    z = (sr - bench) * F.sqrt(c("n") - 1) / F.sqrt(spread)
    quantile = NormalDist().inv_cdf(1 - alpha)
    needed = F.when(sr > bench, F.ceil(1 + spread * F.pow(quantile / (sr - bench), F.lit(2))).cast("double")).otherwise(float("inf"))
    return m.select(key, "n", sr.alias("sr"), "skew", "kurt", normal_cdf(z).alias("psr"), needed.alias("min_trl"))


def expected_max_sharpe(trials: int, variance: float = 1.0) -> float:
    """Expected best Sharpe ratio of ``trials`` worthless ones."""
    gamma, phi = 0.5772156649015329, NormalDist()
    return math.sqrt(variance) * ((1 - gamma) * phi.inv_cdf(1 - 1 / trials) + gamma * phi.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(df: DataFrame, trials: int, variance: float, key: str = "asset") -> DataFrame:
    """Probabilistic Sharpe ratio against the best that luck would give; the benchmark divides by days."""
    best = expected_max_sharpe(trials, variance)
    return probabilistic_sharpe(df, key, benchmark=best / math.sqrt(DAYS)).select(key, F.col("psr").alias("dsr"))


def curve_risk(df: DataFrame, key: str = "asset", level: float = 0.95) -> DataFrame:
    """Maximum and mean drawdown, ulcer index, best and worst bar, and the mean of the worst bars."""
    rows = log_returns(drawdown(df, key), key)
    base = rows.groupBy(key).agg(
        F.max("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("mean_drawdown"),
        (F.sqrt(F.avg(c("drawdown") * c("drawdown"))) * 100).alias("ulcer"), (F.max("log_ret") * 100).alias("best"),
        (F.min("log_ret") * 100).alias("worst"), F.percentile("log_ret", 1 - level).alias("var"),
    )
    tail = rows.join(base.select(key, "var"), key).where("log_ret <= var").groupBy(key).agg(F.avg("log_ret").alias("cvar"))
    return base.join(tail, key)


def full_report(df: DataFrame, key: str = "asset") -> DataFrame:
    """One tidy (key, metric, value) row per metric of each curve."""
    years = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400.0 / DAYS
    ends = df.groupBy(key).agg(F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("last"), F.max("equity").alias("peak"), years.alias("years"))
    ends = ends.withColumns({"total_return": c("last") / c("first") - 1, "cagr": F.pow(c("last") / c("first"), 1 / c("years")) - 1})
    wide = ends.join(annualized(df, key), key).join(curve_risk(df, key), key).join(probabilistic_sharpe(df, key).select(key, "psr", "skew", "kurt"), key)
    wide = wide.withColumn("calmar", F.try_divide("annual_return", "max_drawdown")).withColumn("days", c("days").cast("double"))
    names = [n for n in wide.columns if n != key]
    return wide.unpivot(key, names, "metric", "value")


# Trades


def risk_reward(t: DataFrame) -> DataFrame:
    """Potential risk from the stop, reward net of commission, and their ratio."""
    risk = F.abs(c("entry_price") - c("sl")) * F.abs("size")
    reward = c("size") * (c("exit_price") - c("entry_price")) - c("commission")
    return t.withColumns({"potential_risk": risk, "realized_reward": reward, "rr": F.try_divide(reward, F.nullif(risk, F.lit(0.0)))})


def trade_metrics(t: DataFrame, *keys: str) -> DataFrame:
    """Counts, win rate, geometric and ratio statistics, profit factors."""
    won = c("pnl") > 0
    geo = lambda cond: F.exp(F.avg(F.when(cond, F.log1p("return_pct")))) - 1
    gain = lambda x: F.try_divide(F.sum(F.when(c(x) > 0, c(x))), -F.sum(F.when(c(x) < 0, c(x))))
    return risk_reward(t).groupBy(*keys).agg(
        F.count("*").alias("trades"), (F.avg(won.cast("double")) * 100).alias("win_rate"), gain("pnl").alias("profit_factor"),
        gain("return_pct").alias("profit_factor_returns"), (geo(F.lit(True)) * 100).alias("avg_trade"), (geo(won) * 100).alias("avg_win"),
        (geo(c("pnl") < 0) * 100).alias("avg_loss"), F.avg("rr").alias("mean_rr"), F.median("rr").alias("median_rr"), F.stddev_samp("rr").alias("sd_rr"),
    )


def direction() -> Column:
    return F.when(c("size") > 0, "long").otherwise("short")


def metrics_by_direction(t: DataFrame, group: Column) -> DataFrame:
    """The same statistics for all, long and short trades of each group, and over all groups: one pass.

    Every trade is expanded to its four grouping sets before the partial aggregation.
    """
    both = F.array(F.lit("both"), direction())
    rows = t.withColumn("grp", group.cast("string")).withColumn("side", F.explode(both))
    rows = rows.withColumn("grp", F.explode(F.array(c("grp"), F.lit("all"))))
    return trade_metrics(rows, "side", "grp")


def losing_streaks(t: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Statistics of runs of consecutive losses per key."""
    w = Window.partitionBy(key).orderBy(*order)
    t = t.withColumn("lost", (c("pnl") < 0).cast("int"))
    t = t.withColumn("island", F.row_number().over(w) - F.sum("lost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.where("lost = 1").groupBy(key, "island").agg(F.count("*").alias("length"))
    return runs.groupBy(key).agg(
        F.max("length").alias("longest"), F.avg("length").alias("mean"), F.median("length").alias("median"), F.percentile("length", 0.75).alias("p75"), F.percentile("length", 0.95).alias("p95")
    )


def nth_trade_of_day(t: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(key, F.to_date("entry_time")).orderBy(*order)
    return trade_metrics(t.withColumn("nth", F.row_number().over(w)), "nth")


def ratio_matrix(t: DataFrame, key: str, order: tuple[str, ...], width: int = 100) -> DataFrame:
    """Trades in order as rows of ``width`` reward ratios."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = risk_reward(t).withColumn("n", n)
    cells = rows.groupBy(key, F.floor(c("n") / width).alias("row"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "rr"))), lambda x: x["rr"]).alias("rr"))


def aggregate_trades(t: DataFrame, key: str, net: bool = False) -> DataFrame:
    """Fills of one entry bar as one trade: prices weighted by size, profit summed, the last exit."""
    w = F.abs("size")
    weighted = lambda x: F.sum(w * c(x)) / F.sum(w)
    size = F.abs(F.sum("size")) if net else F.sum(w)
    g = t.groupBy(key, "entry_bar").agg(
        F.sum("size").alias("size"), weighted("entry_price").alias("entry_price"), weighted("exit_price").alias("exit_price"), F.sum("pnl").alias("pnl"),
        F.sum("commission").alias("commission"), F.max("entry_time").alias("last_time"), size.alias("_size"),
    )
    return g.withColumn("return_pct", F.try_divide("pnl", F.nullif(c("_size") * c("entry_price"), F.lit(0.0)))).drop("_size")


def weekday_stats(df: DataFrame, key: str = "asset") -> DataFrame:
    """Daily returns by day of the week, and of whole weeks as day 0."""
    r = daily_returns(df, key).where("r is not null")
    weeks = r.groupBy(key, F.date_trunc("WEEK", "day").alias("week")).agg((F.product(1 + c("r")) - 1).alias("r"))
    rows = r.select(key, F.dayofweek("day").alias("weekday"), "r").unionByName(weeks.select(key, F.lit(0).alias("weekday"), "r"))
    gain, loss = F.sum(F.when(c("r") > 0, c("r"))), -F.sum(F.when(c("r") < 0, c("r")))
    return rows.groupBy(key, "weekday").agg(
        F.count("*").alias("n"), (F.avg((c("r") > 0).cast("double")) * 100).alias("win_rate"), F.avg("r").alias("mean"), F.median("r").alias("median"),
        F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), F.try_divide(gain, loss).alias("profit_factor"), F.sum("r").alias("total"),
    )


def monthly_performance(df: DataFrame, key: str = "asset", n: int = 12) -> DataFrame:
    """Monthly return, volatility of its days, and the Sharpe ratio of the last ``n`` months."""
    r = daily_returns(df, key).where("r is not null")
    g = r.groupBy(key, F.trunc("day", "month").alias("month")).agg((F.product(1 + c("r")) - 1).alias("ret"), (F.stddev_samp("r") * math.sqrt(DAYS)).alias("vol"))
    w = Window.partitionBy(key).orderBy("month").rowsBetween(-(n - 1), 0)
    sharpe = F.try_divide(F.avg("ret").over(w), F.stddev_samp("ret").over(w)) * math.sqrt(12)
    return g.withColumn("rolling_sharpe", F.when(F.count("ret").over(w) >= n, sharpe))


def binned(t: DataFrame, column: str, edges: list[float]) -> Column:
    """The left-closed bin of a value; null outside of all."""
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(zip(edges[:-1], edges[1:], strict=True)))):
        out = F.when((c(column) >= a) & (c(column) < b), k).otherwise(out)
    return out


#: The edges of the preset analyses.
RSI_EDGES = [0.0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
VIX_EDGES = [0.0, 12, 16, 20, 25, 30, 40, math.inf]


def clean_step(raw: float) -> float:
    """The least step of 1, 2, 2.5, 5 times a power of ten that is not below ``raw``."""
    if raw <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(raw))
    return next(k * power for k in (1, 2, 2.5, 5, 10) if k * power >= raw * (1 - 1e-12))


def percentile_edges(t: DataFrame, column: str, bins: int = 15, low: float = 0.1, high: float = 0.9) -> list[float]:
    """Edges of about ``bins`` clean steps between two percentiles, and an open end."""
    a, b = t.agg(F.percentile(column, [low, high]).alias("q")).first().q
    step = clean_step((b - a) / bins)
    start = math.floor(a / step) * step
    n = max(1, math.ceil((b - start) / step))
    return [start + k * step for k in range(n + 1)] + [math.inf]


def merge_curves(tests: DataFrame) -> DataFrame:
    """Curves of several folds (test_id, ts, equity) as one: of equal times the first fold's row stays."""
    first = F.row_number().over(Window.partitionBy("ts").orderBy("test_id"))
    return tests.withColumn("_n", first).where("_n = 1").drop("_n")


def equal_weight(df: DataFrame, key: str = "asset") -> DataFrame:
    """The curve of the mean return of all curves that exist at a time."""
    r = df.withColumn("r", c("equity") / F.lag("equity").over(Window.partitionBy(key).orderBy("ts")) - 1)
    mean = r.groupBy(F.to_date("ts").alias("day")).agg(F.avg("r").alias("r"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return mean.withColumn("growth", F.exp(F.sum(F.coalesce(F.log1p("r"), F.lit(0.0))).over(w)))


def trend_fit(t: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Cumulated reward ratio and how straight it rises."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = risk_reward(t).withColumn("n", F.row_number().over(w)).withColumn("cum", F.sum("rr").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key).agg(F.max_by("cum", "n").alias("total_rr"), F.regr_r2("cum", "n").alias("r2"))


def deepest_drawdown(df: DataFrame, key: str = "asset") -> DataFrame:
    """Depth, low point and the peak before it of the deepest fall."""
    d = drawdown(df, key).withColumn("peak_ts", F.max_by("ts", F.struct("equity", -F.unix_timestamp("ts"))).over(upto(key)))
    return d.groupBy(key).agg(F.max("drawdown").alias("depth"), F.max_by("ts", "drawdown").alias("low_ts"), F.max_by("peak_ts", "drawdown").alias("peak_ts"))

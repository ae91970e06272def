"""Indicators over bounded or cumulative windows: pure window functions, one sort per symbol.

Every function takes bars (symbol, ts, open, high, low, close, volume) and returns them with more
columns. A window that is not full gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def by_time(key: str = "symbol"):
    return Window.partitionBy(key).orderBy("ts")


def last_n(n: int, key: str = "symbol"):
    return by_time(key).rowsBetween(-(n - 1), 0)


def full(value: Column, x: Column, n: int, key: str = "symbol") -> Column:
    """``value`` where the window of ``n`` rows holds ``n`` values of ``x``."""
    return F.when(F.count(x).over(last_n(n, key)) >= n, value)


def by_chunks(df: DataFrame, work: Callable[[DataFrame], DataFrame], seconds: int, warm: int) -> DataFrame:
    """``work`` on stretches of ``seconds`` per symbol, each with the ``warm`` seconds before it.

    One symbol with a large part of all rows is one sort in one task otherwise. Windows that reach back
    no further than ``warm`` (which is at most ``seconds``) give the same rows; cumulative ones do not.
    """
    at = F.unix_timestamp("ts")
    own, later = F.floor(at / seconds), F.floor((at + warm) / seconds)
    dealt = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_distinct(F.array(own, later))))
    dealt = dealt.withColumns({"_symbol": c("symbol"), "symbol": F.concat_ws("|", "symbol", "_chunk")})
    return work(dealt).where(c("_own") == c("_chunk")).withColumn("symbol", c("_symbol")).drop("_own", "_chunk", "_symbol")


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x).over(last_n(n)), x, n)


def sd(x: Column, n: int) -> Column:
    return full(F.stddev_samp(x).over(last_n(n)), x, n)


def highest(x: Column, n: int) -> Column:
    return full(F.max(x).over(last_n(n)), x, n)


def lowest(x: Column, n: int) -> Column:
    return full(F.min(x).over(last_n(n)), x, n)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def true_range() -> Column:
    before = lag("close")
    return F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))


def zscore(df: DataFrame, column: str = "close", n: int = 252, least: int = 20) -> DataFrame:
    w, x = last_n(n), c(column)
    value = F.try_divide(x - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)))
    return df.withColumn("zscore", F.when(F.count(x).over(w) >= least, value))


def percentile_rank(df: DataFrame, column: str = "close", n: int = 20) -> DataFrame:
    """Share of the last ``n`` values that are at most the current one."""
    frame = F.collect_list(column).over(last_n(n))
    share = F.size(F.filter(frame, lambda v: v <= F.element_at(frame, -1))) / n
    return df.withColumn("pct_rank", full(share, c(column), n))


def bollinger(df: DataFrame, column: str = "close", n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = sma(c(column), n), sd(c(column), n)
    return df.withColumns({"bb_mid": mid, "bb_up": mid + k * dev, "bb_low": mid - k * dev, "bb_width": 2 * k * dev / (mid + 1e-9)})


def chandelier(df: DataFrame, n: int = 22, atr_n: int = 22, multiplier: float = 3.0) -> DataFrame:
    """Highest high less, lowest low plus ATR times the multiplier squared (as the ATR has it already)."""
    df = df.withColumn("_tr", true_range())
    atr = sma(c("_tr"), atr_n) * multiplier * multiplier
    return df.withColumns({"ce_long": highest(c("high"), n) - atr, "ce_short": lowest(c("low"), n) + atr}).drop("_tr")


def combined_volatility(df: DataFrame, n: int = 20, n_geo: int = 40, periods: int = 252, squared: bool = False) -> DataFrame:
    """Parkinson, Rogers-Satchell, Yang-Zhang and geometric volatility, rescaled to the last's median and averaged."""
    o, h, lo, cl = (c(x) for x in ("open", "high", "low", "close"))
    hl = F.log(h / lo)
    df = df.withColumns({
        "_p": hl * hl if squared else hl,
        "_rs": F.log(h / cl) * F.log(h / o) + F.log(lo / cl) * F.log(lo / o),
        "_on": F.log(o / lag("close")), "_oc": F.log(cl / o), "_r": cl / lag("close") - 1,
    })
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = lambda x: full(F.var_samp(x).over(last_n(n)), c(x), n)
    mean = lambda x: full(F.avg(x).over(last_n(n)), c(x), n)
    g = F.exp(full(F.avg(F.log1p("_r")).over(last_n(n_geo)), c("_r"), n_geo)) - 1
    v = full(F.var_samp("_r").over(last_n(n_geo)), c("_r"), n_geo)
    df = df.withColumns({
        "vol_parkinson": F.sqrt(mean("_p") / (4 * math.log(2)) * periods),
        "vol_rs": F.sqrt(mean("_rs") * periods),
        "vol_yz": F.sqrt((var("_on") + k * var("_oc") + (1 - k) * mean("_rs")) * periods),
        "vol_geo": F.sqrt(F.pow(v + (1 + g) * (1 + g), F.lit(periods)) - F.pow(1 + g, F.lit(2 * periods))),
    })
    names = ["vol_parkinson", "vol_rs", "vol_yz"]
    scale = df.groupBy("symbol").agg(*(F.median(F.try_divide("vol_geo", x)).alias(f"_k_{x}") for x in names))
    df = df.join(scale, "symbol", "left")
    total = sum((c(x) * c(f"_k_{x}") for x in names), c("vol_geo")) / (len(names) + 1)
    return df.withColumn("vol_combined", total).drop("_p", "_rs", "_on", "_oc", "_r", *(f"_k_{x}" for x in names))


def williams_r(df: DataFrame, n: int = 14) -> DataFrame:
    hh, ll = highest(c("high"), n), lowest(c("low"), n)
    return df.withColumn("williams_r", -100 * F.try_divide(hh - c("close"), hh - ll))


def stochastic(df: DataFrame, k: int = 18, smooth: int = 2, d: int = 6) -> DataFrame:
    hh, ll = highest(c("high"), k), lowest(c("low"), k)
    df = df.withColumn("_raw", 100 * F.try_divide(c("close") - ll, hh - ll))
    df = df.withColumn("stoch_k", sma(c("_raw"), smooth))
    return df.withColumn("stoch_d", sma(c("stoch_k"), d)).drop("_raw")


def rolling_ols(df: DataFrame, column: str = "close", n: int = 20, against_time: bool = True) -> DataFrame:
    """Slope and intercept of the last ``n`` values on 0..n-1; by default newest first, as a convolution has it."""
    frame = F.collect_list(column).over(last_n(n))
    position = lambda i: (n - 1 - i) if against_time else i
    sxy = F.aggregate(F.transform(frame, lambda y, i: y * position(i).cast("double")), F.lit(0.0), lambda a, b: a + b)
    sy = F.aggregate(frame, F.lit(0.0), lambda a, b: a + b)
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return df.withColumns({"ols_slope": full(slope, c(column), n), "ols_intercept": full((sy - slope * sx) / n, c(column), n)})


def roc(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn("roc", (F.try_divide("close", lag("close", n)) - 1) * 100)


def obv(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(c("close") - lag("close")) * c("volume"), F.lit(0.0))
    df = df.withColumn("_step", step)
    return df.withColumn("obv", F.sum("_step").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def vwap(df: DataFrame, unit: str = "DAY") -> DataFrame:
    """Volume-weighted typical price since the start of the calendar unit."""
    p = (c("high") + c("low") + c("close")) / 3
    w = Window.partitionBy("symbol", F.date_trunc(unit, "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("vwap", F.try_divide(F.sum(p * c("volume")).over(w), F.nullif(F.sum("volume").over(w), F.lit(0.0))))


def weighted_ma(x: str, n: int) -> Column:
    """Linearly weighted average, newest heaviest."""
    frame = F.collect_list(x).over(last_n(n))
    dot = F.aggregate(F.transform(frame, lambda y, i: y * (i + 1).cast("double")), F.lit(0.0), lambda a, b: a + b)
    return full(dot / (n * (n + 1) / 2), c(x), n)


def detrended(df: DataFrame, n: int = 20, wma: int = 30) -> DataFrame:
    """Detrended price oscillator: the close n/2 + 1 bars ago against the average, and the weighted average."""
    return df.withColumns({"dpo": lag("close", n // 2 + 1) - sma(c("close"), n), "wma": weighted_ma("close", wma)})


def fractals(df: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Strict local extremes, at the bar itself and at the bar from which they can be known."""
    before, after = by_time().rowsBetween(-left, -1), by_time().rowsBetween(1, right)
    enough = (F.count("high").over(before) == left) & (F.count("high").over(after) == right)
    up = enough & (c("high") > F.max("high").over(before)) & (c("high") > F.max("high").over(after))
    down = enough & (c("low") < F.min("low").over(before)) & (c("low") < F.min("low").over(after))
    df = df.withColumns({"fractal_up": F.coalesce(up, F.lit(False)), "fractal_down": F.coalesce(down, F.lit(False))})
    known = lambda x: F.coalesce(F.lag(x, right).over(by_time()), F.lit(False))
    return df.withColumns({"fractal_up_known": known("fractal_up"), "fractal_down_known": known("fractal_down")})


def day_change(df: DataFrame, end_of_day: str = "15:45:00") -> DataFrame:
    ahead = F.to_date(F.lead("ts", 2).over(by_time()))
    flag = ahead.isNull() | (ahead != F.to_date("ts")) | (F.date_format("ts", "HH:mm:ss") == end_of_day)
    return df.withColumn("day_change", flag.cast("int"))


def market_calls(df: DataFrame, bsr: int = 20, trend: int = 5, short: int = 10, long: int = 20) -> DataFrame:
    """Votes of up and down closes, two trends in a row and momentum make a call that holds until the next."""
    df = df.withColumn("_up", (c("close") > lag("close")).cast("int")).withColumn("_down", (c("close") < lag("close")).cast("int"))
    w = last_n(bsr)
    df = df.withColumns({
        "_ratio": F.try_divide(F.sum("_up").over(w).cast("double"), F.nullif(F.sum("_down").over(w), F.lit(0)).cast("double")),
        "_trend": F.signum(c("close") - lag("close", trend)), "_mom": F.signum(sma(c("close"), short) - sma(c("close"), long)),
    })
    two = lambda s: (c("_trend") == s) & (lag("_trend", trend) == s)
    call = F.when((c("_ratio") > 1) & two(1) & (c("_mom") > 0), 1).when((c("_ratio") < 1) & two(-1) & (c("_mom") < 0), -1)
    df = df.withColumn("_call", call)
    held = F.last("_call", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("market_call", F.coalesce(held, F.lit(0))).drop("_up", "_down", "_ratio", "_trend", "_mom", "_call")


def extend_signal(df: DataFrame, flag: str, n: int) -> DataFrame:
    """Each true flag stays true for ``n`` bars."""
    return df.withColumn(f"{flag}_extended", F.max(c(flag).cast("int")).over(last_n(n)))


def geometric_mean(df: DataFrame, n: int = 20) -> DataFrame:
    """exp(mean of ln(1 + r)) - 1 over ``n`` returns, nulls as 0."""
    df = df.withColumn("_r", F.coalesce(c("close") / lag("close") - 1, F.lit(0.0)))
    return df.withColumn("geo_mean", full(F.exp(F.avg(F.log1p("_r")).over(last_n(n))) - 1, c("_r"), n)).drop("_r")


def session_ranges(df: DataFrame, start: str = "03:00", end: str = "04:30") -> DataFrame:
    """High and low of each day's session, its range in percent, on every bar of the day and carried on."""
    inside = F.date_format("ts", "HH:mm").between(start, end)
    day = Window.partitionBy("symbol", F.to_date("ts"))
    df = df.withColumns({"_h": F.max(F.when(inside, c("high"))).over(day), "_l": F.min(F.when(inside, c("low"))).over(day)})
    carried = by_time().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"session_{n}": F.last(x, ignorenulls=True).over(carried) for n, x in (("high", "_h"), ("low", "_l"))})
    spread = F.try_divide(c("session_high") - c("session_low"), "session_high") * 100
    return df.withColumn("session_range_pct", spread).drop("_h", "_l")


def gap_features(df: DataFrame, unit: str = "DAY") -> DataFrame:
    """Gap between a calendar unit's open and the close before it, against the range before it."""
    daily = df.groupBy("symbol", F.date_trunc(unit, "ts").alias("ts")).agg(
        F.min_by("open", "ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c")
    )
    daily = daily.withColumns({"pc": lag("c"), "ph": lag("h"), "pl": lag("l")})
    daily = daily.withColumn("gap", c("o") - c("pc")).withColumn("gap_pct", F.try_divide("gap", "pc") * 100)
    beyond = F.when(c("o") > c("ph"), 1.0).when(c("o") < c("pl"), -1.0)
    daily = daily.withColumns({"gap_beyond_range": beyond, "gap_direction": F.signum("gap")})
    names = ("gap", "gap_pct", "gap_beyond_range", "gap_direction")
    daily = daily.select("symbol", F.col("ts").alias("_unit"), *names)
    return df.withColumn("_unit", F.date_trunc(unit, "ts")).join(daily, ["symbol", "_unit"], "left").drop("_unit")


def fracdiff_weights(d: float, tol: float = 1e-5, longest: int = 10_000) -> list[float]:
    w = [1.0]
    while len(w) < longest:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < tol:
            break
        w.append(nxt)
    return w


def fracdiff(df: DataFrame, column: str = "close", d: float = 0.4, tol: float = 1e-2) -> DataFrame:
    """Fixed-width fractional differencing: the dot product of the last values with the binomial weights."""
    w = fracdiff_weights(d, tol)
    n = len(w)
    frame = F.collect_list(column).over(last_n(n))
    weights = F.array(*(F.lit(x) for x in reversed(w)))
    dot = F.aggregate(F.zip_with(frame, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("fracdiff", full(dot, c(column), n))


def normalize_equity(df: DataFrame, target: float = 0.1, n: int = 60) -> DataFrame:
    """Equity whose log returns are scaled to a target volatility by the last ``n`` ones."""
    w = Window.partitionBy("asset").orderBy("ts")
    df = df.withColumn("_r", F.log(c("equity") / F.lag("equity").over(w)))
    roll = w.rowsBetween(-(n - 1), 0)
    vol = F.when(F.count("_r").over(roll) >= n, F.stddev_samp("_r").over(roll) * math.sqrt(252))
    df = df.withColumn("_s", F.coalesce(c("_r") * F.try_divide(F.lit(target), vol), F.lit(0.0)))
    first = F.first("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    grown = F.exp(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("equity_normalized", first * grown).drop("_r", "_s")


def volatility_features(df: DataFrame, spans: tuple[int, ...] = (5, 14, 21, 40), vov: tuple[int, ...] = (20, 40)) -> DataFrame:
    """Average true range over the close, realised volatility and its own volatility; nulls as 0."""
    df = df.withColumn("_tr", true_range()).withColumn("_r", F.log(c("close") / lag("close")))
    df = df.withColumns({f"atr_{n}": sma(c("_tr"), n) / c("close") for n in spans})
    df = df.withColumns({f"rv_{n}": sd(c("_r"), n) for n in vov})
    df = df.withColumns({f"vov_{n}": sd(c(f"rv_{n}"), n) for n in vov})
    names = [f"atr_{n}" for n in spans] + [f"{k}_{n}" for k in ("rv", "vov") for n in vov]
    return df.fillna(0.0, names).drop("_tr", "_r")

"""Feature matrices over several timeframes: each shifted by one bar, so that nothing looks ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.resample import asof_backward, resample_ohlc

c = F.col


def squeeze_momentum(df: DataFrame, n: int = 20, k: float = 2.0, kc: float = 1.5) -> DataFrame:
    """Bands inside a channel of mean true range, and the slope of the deviation from both middles, over windows only."""
    df = df.withColumn("_tr", W.true_range())
    mid, dev, width = W.sma(c("close"), n), W.sd(c("close"), n), W.sma(c("_tr"), n)
    middle = ((W.highest(c("high"), n) + W.lowest(c("low"), n)) / 2 + mid) / 2
    df = df.withColumns({"squeeze_on": F.coalesce((mid + k * dev < mid + kc * width), F.lit(False)).cast("double"), "_d": c("close") - middle})
    return W.rolling_ols(df, "_d", n, against_time=False).withColumnRenamed("ols_slope", "squeeze_slope").drop("_tr", "_d", "ols_intercept")


def session_features(df: DataFrame, start: str = "03:00", end: str = "04:30") -> DataFrame:
    """Session range of the day and of the day before it, and their ratios to the close."""
    df = W.session_ranges(df, start, end)
    daily = df.groupBy("symbol", F.date_trunc("DAY", "ts").alias("day")).agg(F.max("session_high").alias("h"), F.min("session_low").alias("l"))
    w = Window.partitionBy("symbol").orderBy("day")
    before = daily.select("symbol", "day", F.lag("h").over(w).alias("prev_session_high"), F.lag("l").over(w).alias("prev_session_low"))
    out = df.withColumn("day", F.date_trunc("DAY", "ts")).join(before, ["symbol", "day"], "left").drop("day")
    width, earlier = c("session_high") - c("session_low"), c("prev_session_high") - c("prev_session_low")
    return out.withColumns({
        "session_width": F.try_divide(width, "close"), "session_width_ratio": F.try_divide(width, earlier),
        "session_position": F.try_divide(c("close") - c("session_low"), width), "prev_session_position": F.try_divide(c("close") - c("prev_session_low"), earlier),
    })


def several_timeframes(bars: DataFrame, rules: dict[str, str], work: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame:
    """Features of each timeframe on the base bars, of its last complete bar, nulls as 0: suffix -> rule."""
    out = bars
    for suffix, rule in rules.items():
        coarse = work(resample_ohlc(bars, rule))
        w = Window.partitionBy("symbol").orderBy("ts")
        shifted = coarse.select("symbol", "ts", *(F.lag(n).over(w).alias(f"{n}_{suffix}") for n in names))
        out = asof_backward(out, shifted, "symbol", [f"{n}_{suffix}" for n in names])
    return out.fillna(0.0, [f"{n}_{s}" for s in rules for n in names])


def meta_features(bars: DataFrame) -> DataFrame:
    """The matrix for meta-labelling: session features on the base bars, oscillators and volatility per timeframe."""

    def oscillators(df: DataFrame) -> DataFrame:
        for step in (W.bollinger, W.williams_r, W.roc, W.zscore):
            df = df.transform(step)
        return df

    names = ["bb_width", "williams_r", "roc", "zscore"]
    return several_timeframes(session_features(bars), {"2h": "2 hours", "6h": "6 hours"}, oscillators, names)


def dynamic_normalized(equity: DataFrame, dates: DataFrame, n: int = 60, target: float = 0.1) -> DataFrame:
    """Curves rescaled at rebalance dates to a target volatility of the rows before; the factor holds in between."""
    w = Window.partitionBy("asset").orderBy("ts")
    r = equity.withColumn("r", c("equity") / F.lag("equity").over(w) - 1)
    past = w.rowsBetween(-n, -1)
    vol = F.when(F.count("r").over(past) >= n, F.stddev_samp("r").over(past) * (252**0.5))
    marked = r.withColumn("_v", vol).join(dates.select("ts").withColumn("_at", F.lit(True)), "ts", "left")
    factor = F.last(F.when(c("_at"), F.try_divide(F.lit(target), c("_v"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    scaled = marked.withColumn("scale", F.coalesce(factor, F.lit(1.0))).withColumn("_s", F.coalesce(c("r") * c("scale"), F.lit(0.0)))
    grown = F.exp(F.sum(F.log1p("_s")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return scaled.withColumn("equity_scaled", 100_000 * grown).select("asset", "ts", "scale", "equity_scaled")

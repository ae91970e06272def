"""Pivots, support and resistance zones, and accumulation structures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators.windows import fractals

c = F.col
#: Bars in a block, by which ranges of bars meet single ones.
BLOCK = 256


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def zigzag(bars: DataFrame, divisor: float = 5.0, use_high_low: bool = False) -> DataFrame:
    """Pivots (1 high, -1 low) and the bar from which each is known; thresholds follow the adaptive range."""

    def work(b: K.Bars) -> dict[str, np.ndarray]:
        typical = (b["high"] + b["low"] + b["close"]) / 3
        threshold = K.adaptive_atr(b, 2 * K.dominant_period(typical)) / divisor
        return K.zigzag(b, threshold, use_high_low) | {"threshold": threshold}

    found = K.per_symbol(bars, work, ["pivot", "pivot_known", "threshold"])
    return bars.join(found, ["symbol", "ts"])


def confirmed_pivots(bars: DataFrame, lookback: int = 5, divisor: float = 5.0) -> DataFrame:
    """Pivots that are fractals as well; known from the later of both, or the fractal's where the other is open."""
    z = numbered(fractals(zigzag(bars, divisor, True), lookback, lookback))
    side = F.when((c("pivot") == 1) & c("fractal_up"), 1).when((c("pivot") == -1) & c("fractal_down"), -1)
    known = F.greatest((c("idx") + lookback).cast("double"), F.when(c("pivot_known") >= 0, c("pivot_known")))
    return z.withColumns({"side": side, "known": known.cast("long")}).where("side is not null").select("symbol", "ts", "idx", "side", "known", F.when(c("side") == 1, c("high")).otherwise(c("low")).alias("price"))


def pivots_at(pivots: DataFrame, bar: int) -> DataFrame:
    return pivots.where((c("known") <= bar) & (c("idx") < bar))


def spring_signals(bars: DataFrame, pivots: DataFrame, divisor: float = 5.0, n: int = 14) -> DataFrame:
    """Falling highs H3 < H2 < H1 by a confirmed low near H3 between H2 and H1: +1 on the bar that confirms H1.

    Mirrored lows give -1; both on one bar give 0. One signal per structure.
    """
    out = None
    width = F.avg(c("high") - c("low")).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0))
    ranges = numbered(bars).withColumn("range", width).select("symbol", "idx", "ts", "range")
    for sign in (1, -1):
        own, other = pivots.where(c("side") == sign), pivots.where(c("side") == -sign)
        w = Window.partitionBy("symbol").orderBy("known", "idx")
        s = own.withColumns({"p2": F.lag("price", 1).over(w), "i2": F.lag("idx", 1).over(w), "p3": F.lag("price", 2).over(w)}).where("p3 is not null")
        s = s.where((sign * c("p3") < sign * c("p2")) & (sign * c("p2") < sign * c("price")))
        s = s.join(ranges.select("symbol", c("idx").alias("known"), c("ts").alias("at"), "range"), ["symbol", "known"])
        o = other.select(c("symbol").alias("_s"), c("idx").alias("_i"), c("known").alias("_k"), c("price").alias("_p"), F.floor(c("idx") / BLOCK).alias("_b"))
        # structures meet the pivots of the blocks of bars that they reach over
        s = s.withColumn("_block", F.explode(F.sequence(F.floor(c("i2") / BLOCK), F.floor(c("idx") / BLOCK))))
        inside = (c("_s") == c("symbol")) & (c("_b") == c("_block")) & (c("_i") > c("i2")) & (c("_i") < c("idx")) & (c("_k") <= c("known"))
        hits = s.join(o, inside).where(F.abs(c("_p") - c("p3")) <= c("range") / divisor)
        one = hits.groupBy("symbol", "at", "idx", "i2").agg(F.count("*").alias("n"), F.max("p2").alias("level"), F.max("_p").alias("limit_price")).where("n = 1")
        part = one.select("symbol", c("at").alias("ts"), F.lit(sign).alias("signal"), "level", "limit_price")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("symbol", "ts").agg(F.when(F.count_distinct("signal") > 1, 0).otherwise(F.max("signal")).alias("signal"), F.max("level").alias("level"), F.max("limit_price").alias("limit_price"))


def detect_zones(prices: np.ndarray, index: np.ndarray, band: float, least: int, now: int, life: int) -> list[tuple]:
    """Clusters of extremes within a band, recentred once; strongest first, none over half inside a stronger one."""
    found = []
    for p in np.unique(prices):
        for _ in range(2):
            near = np.abs(prices - p) <= band
            p = prices[near].mean()
        if near.sum() >= least and index[near].max() + life > now:
            found.append((int(near.sum()), float(prices[near].min()), float(prices[near].max()), int(index[near].max())))
    kept: list[tuple] = []
    for z in sorted(set(found), key=lambda z: (-z[0], z[1])):
        width = max(z[2] - z[1], 1e-12)
        if all(min(z[2], k[2]) - max(z[1], k[1]) <= width / 2 for k in kept):
            kept.append(z)
    return kept


def merge_zones(zones: pd.DataFrame, share: float = 0.7) -> pd.DataFrame:
    """One sweep in order of the lower edge: zones that overlap by a share of the smaller become one."""
    out: list[dict] = []
    for z in zones.sort_values(["zone_low", "zone_high", "first_idx"]).to_dict("records"):
        last = out[-1] if out else None
        if last and min(z["zone_high"], last["zone_high"]) - z["zone_low"] >= share * max(min(z["zone_high"] - z["zone_low"], last["zone_high"] - last["zone_low"]), 1e-12):
            last |= {"zone_high": max(last["zone_high"], z["zone_high"]), "touches": max(last["touches"], z["touches"]), "first_idx": min(last["first_idx"], z["first_idx"]), "expires_idx": max(last["expires_idx"], z["expires_idx"])}
        else:
            out.append(z)
    return pd.DataFrame(out, columns=zones.columns)


ZONES = "symbol string, zone_low double, zone_high double, touches int, first_idx long, expires_idx long"


def rolling_zones(bars: DataFrame, window: int = 100, step: int = 10, least: int = 3, lookback: int = 5, life: int = 200, divide: float = 10.0) -> DataFrame:
    """Zones detected at every ``step`` bars from the fractals known by then, then merged: a task per detection, one per symbol to merge."""
    f = numbered(fractals(bars, lookback, lookback)).withColumn("range", F.avg(c("high") - c("low")).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-13, 0)))
    marks = f.where(c("fractal_up") | c("fractal_down")).select("symbol", "idx", F.when(c("fractal_up"), c("high")).otherwise(c("low")).alias("price"))
    first = F.ceil((c("idx") + lookback) / step).cast("long")
    dealt = marks.withColumn("now", F.explode(F.sequence(first * step, F.greatest(F.floor((c("idx") + window) / step).cast("long") * step, first * step), F.lit(step).cast("long"))))
    dealt = dealt.where(c("now") - c("idx") <= window).join(f.select("symbol", c("idx").alias("now"), "range"), ["symbol", "now"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        now = int(pdf["now"].iloc[0])
        found = detect_zones(pdf["price"].to_numpy(), pdf["idx"].to_numpy(), float(pdf["range"].iloc[0]) / divide, least, now, life)
        rows = [(pdf["symbol"].iloc[0], lo, hi, n, now, last + life) for n, lo, hi, last in found]
        return pd.DataFrame(rows, columns=["symbol", "zone_low", "zone_high", "touches", "first_idx", "expires_idx"])

    found = dealt.groupBy("symbol", "now").applyInPandas(work, ZONES)
    return found.groupBy("symbol").applyInPandas(lambda pdf: merge_zones(pdf), ZONES)


def zone_entries(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """-1: entered a valid zone from below (or through it); 1: from above; 2: both; 0: none."""
    b = numbered(bars).withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    z = zones.where("expires_idx > first_idx").select(c("symbol").alias("_s"), "zone_low", "zone_high", "first_idx", "expires_idx")
    # a zone meets the bars of the blocks that it is valid in
    z = z.withColumn("_b", F.explode(F.sequence(F.floor(c("first_idx") / BLOCK), F.floor((c("expires_idx") - 1) / BLOCK))))
    valid = (c("symbol") == c("_s")) & (F.floor(c("idx") / BLOCK) == c("_b")) & (c("idx") >= c("first_idx")) & (c("idx") < c("expires_idx"))
    crossed = (c("close") >= c("zone_low")) & (c("before") < c("zone_low")) | (c("close") <= c("zone_high")) & (c("before") > c("zone_high"))
    hits = b.join(z, valid & crossed).groupBy("symbol", "idx").agg(F.bool_or(c("before") < c("zone_low")).alias("up"), F.bool_or(c("before") > c("zone_high")).alias("down"))
    code = F.when(c("up") & c("down"), 2).when(c("up"), -1).when(c("down"), 1).otherwise(0)
    return b.join(hits, ["symbol", "idx"], "left").withColumn("in_zone", code).drop("before", "up", "down")

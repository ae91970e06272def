"""Live bars and recursions over streams: watermarked windows, and keyed state with time-to-live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def live_bars(events: DataFrame, rule: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLCV per symbol and window; a window closes once the watermark has passed it."""
    order = F.struct("ts", "event_id")
    kept = events.withWatermark("ts", late)
    g = kept.groupBy(F.col("event_type").alias("symbol"), F.window("ts", rule).alias("w"))
    out = g.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def live_ewm(bars: DataFrame, alpha: float = 2 / 21, idle: int = 86_400_000) -> DataFrame:
    """Exponential average of each symbol's close, carried in state; rows of a batch are taken in order of time.

    State is two doubles per symbol and goes when a symbol has been silent for ``idle`` milliseconds.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, close in zip(rows["ts"], rows["close"], strict=True):
            value = close if value is None else value + alpha * (close - value)
            out.append((key[0], ts, close, value))
        state.update((value,))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ewm"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ewm double", "value double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_drawdown(equity: DataFrame, limit: float = 0.075) -> DataFrame:
    """Running drawdown per strategy against the peak in state, flagged beyond the limit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, value in zip(rows["ts"], rows["equity"], strict=True):
            peak = max(peak, value)
            out.append((key[0], ts, 1 - value / peak, 1 - value / peak >= limit))
        state.update((peak,))
        yield pd.DataFrame(out, columns=["strategy", "ts", "drawdown", "breach"])

    return equity.groupBy("strategy").applyInPandasWithState(step, "strategy string, ts timestamp, drawdown double, breach boolean", "peak double", "append", GroupStateTimeout.NoTimeout)

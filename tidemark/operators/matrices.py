"""Feature matrices over several timeframes in one pass: one shuffle by symbol, one sort, all timeframes side by side.

A symbol's bars are cut into the buckets of every timeframe where they lie; a bucket's features come from buckets up to its own, and a
bar sees those of the last bucket that was complete before it, which is the one before its own. What is not known yet is 0. Bars are
(symbol, ts, open, high, low, close, volume), one per time; rows with a null symbol or time are left out. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators import kernels as K

PRICES = ("open", "high", "low", "close", "volume")
Frame = dict[str, np.ndarray]


def buckets(b: Frame, seconds: np.ndarray, width: int) -> tuple[Frame, np.ndarray, np.ndarray]:
    """(bars of ``width`` seconds, their starts, the bucket of every bar); width 0 leaves the bars as they are."""
    if not width:
        return b, seconds, np.arange(len(seconds))
    starts, first, own = np.unique(seconds // width, return_index=True, return_inverse=True)
    if not len(first):
        return b, seconds, own
    last = np.append(first[1:], len(seconds)) - 1
    out = {"open": b["open"][first], "close": b["close"][last]}
    for name, f in (("high", np.maximum), ("low", np.minimum), ("volume", np.add)):
        out[name] = f.reduceat(b[name], first)
    return out, starts * width, own


def rolled(x: np.ndarray, n: int, least: int | None = None):
    return pd.Series(x).rolling(n, min_periods=n if least is None else least)


def zscore(x: np.ndarray, n: int, least: int = 20) -> np.ndarray:
    r = rolled(x, n, min(least, n))
    sd = r.std().to_numpy()
    return (x - r.mean().to_numpy()) / np.where(sd == 0, np.nan, sd)


def share_below(x: np.ndarray, n: int) -> np.ndarray:
    """Share of the last ``n`` values that are at most the current one; nothing while there are fewer."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        w = np.lib.stride_tricks.sliding_window_view(x, n)
        out[n - 1 :] = np.where(np.isnan(w).any(axis=1), np.nan, (w <= w[:, -1:]).mean(axis=1))
    return out


def change(x: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(len(x), np.nan)
    out[n:] = x[n:] - x[:-n]
    return out


def rate_of_change(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    out[n:] = 100 * (x[n:] / x[:-n] - 1)
    return out


def band_position(close: np.ndarray, n: int = 20, k: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(place of the close between both bands, 0 to 1; width of the bands over their middle)."""
    mid, sd = rolled(close, n).mean().to_numpy(), rolled(close, n).std().to_numpy()
    return np.clip((close - (mid - k * sd)) / (2 * k * sd), 0, 1), 2 * k * sd / (mid + 1e-9)


def by_day(b: Frame, seconds: np.ndarray, start: int, end: int, until: int = 83_700) -> Frame:
    """The session of each day between two seconds of the day, and the day before up to ``until``, as ratios; the day's gap."""
    day, of_day = seconds // 86_400, seconds % 86_400
    days = pd.DataFrame({"day": day, "open": b["open"], "high": b["high"], "low": b["low"], "close": b["close"]})
    inside, most = days[(of_day >= start) & (of_day <= end)].groupby("day"), days[of_day <= until].groupby("day")
    ranges = pd.DataFrame({"sh": inside["high"].max(), "sl": inside["low"].min()})
    before = pd.DataFrame({"ph": most["high"].max(), "pl": most["low"].min()}).shift(1)
    ends = days.groupby("day").agg(first=("open", "first"), last=("close", "last"))
    at = pd.Series(day)
    sh, sl, ph, pl = (at.map(x).ffill().to_numpy() for x in (ranges["sh"], ranges["sl"], before["ph"], before["pl"]))
    gap = at.map(100 * (ends["first"] / ends["last"].shift(1) - 1)).to_numpy()
    return {
        "range_high_vs_prev_high": 100 * sh / ph, "range_high_vs_prev_range": 100 * (sh - ph) / (ph - pl), "range_low_vs_prev_low": 100 * sl / pl,
        "range_low_vs_prev_range": 100 * (sl - ph) / (ph - pl), "session_range_vs_prev_range": ((sh - sl) / sh) / ((ph - pl) / ph), "overnight_gap": gap,
    }


def fast_features(b: Frame, seconds: np.ndarray, start: int, end: int) -> Frame:
    """Features of the shortest timeframe."""
    close = b["close"]
    typical = (b["high"] + b["low"] + close) / 3
    whole, double = K.adaptive_oscillators(b, 1.0), K.adaptive_oscillators(b, 2.0)
    r, dollars = change(np.log(close)), b["volume"] * close
    roc, strength, trend = zscore(rate_of_change(close, 20), 89), whole["adaptive_rsi"], K.adx(b, 2, 2)["adx"]
    position, width = band_position(close)
    channel = K.keltner(b, 20, 1.5, 10)
    # Monday is 0, and the first day of the epoch was a Thursday
    weekday = (seconds // 86_400 + 3) % 7
    return {
        **by_day(b, seconds, start, end), "adp_rsi": strength, "rsi_divergence": np.sign(change(close)) - np.sign(change(strength)),
        "atr_adaptive": share_below(K.adaptive_atr(b, K.dominant_period(typical, 1.0)), 89), "atr_5": K.atr(b, 5) / close, "atr_21": K.atr(b, 21) / close,
        "realized_vol_20": rolled(r, 20, 10).std().to_numpy() * math.sqrt(252), "vol_of_vol_40": rolled(r, 40, 20).std().to_numpy(),
        "vol_term_structure": K.atr(b, 5) / K.atr(b, 21), "roc_20": roc, "adx_4": K.adx(b, 4, 4)["adx"], "adx_10": trend,
        "dollar_vol_pressure": rolled(np.sign(change(close)) * dollars, 21).sum().to_numpy() / rolled(dollars, 21).sum().to_numpy(),
        "momentum_composite": (zscore(roc, 50) + zscore(strength - 50, 50) + zscore(trend, 50)) / 3, "stoch_k_1": whole["adaptive_stoch"], "stoch_k_2": double["adaptive_stoch"],
        "stoch2_stoch1": whole["adaptive_stoch"] - double["adaptive_stoch"], "adap_cci": whole["adaptive_cci"], "dow_sin": np.sin(2 * np.pi * weekday / 5), "dow_cos": np.cos(2 * np.pi * weekday / 5),
        "bb_position": position, "squeeze": width / ((channel["kc_up"] - channel["kc_low"]) / channel["kc_mid"]),
        "body_ratio": rolled(np.abs(close - b["open"]) / np.where(b["high"] == b["low"], np.nan, b["high"] - b["low"]), 5).mean().to_numpy(),
    }


def middle_features(b: Frame) -> Frame:
    close = b["close"]
    typical = (b["high"] + b["low"] + close) / 3
    r = np.nan_to_num(rate_of_change(close, 1) / 100)
    strength, short = K.adaptive_oscillators(b, 1.0)["adaptive_rsi"], K.dominant_period(close, 0.2)
    return {
        "slow_vol": zscore(rolled(r, 20, 1).std().to_numpy() * math.sqrt(252), 89), "rsi_divergence": np.sign(change(close)) - np.sign(change(strength)),
        "atr_adaptive": share_below(K.adaptive_atr(b, K.dominant_period(typical, 1.0)), 89), "atr_10": share_below(K.atr(b, 10), 89), "roc_20": zscore(rate_of_change(close, 20), 89),
        "adx_4": K.adx(b, 4, 4)["adx"], "adx_10": K.adx(b, 2, 2)["adx"], "dominant_period": zscore(short, 89), "adaptive_atr": zscore(share_below(K.adaptive_atr(b, short), 89), 89),
        "adaptive_rsi": K.adaptive_oscillators(b, 0.2)["adaptive_rsi"], "price_vs_ma": zscore((close - K.ema(close, 50)) / K.atr(b, 10), 89),
    }


def slow_features(b: Frame) -> Frame:
    return {"adx_10": K.adx(b, 2, 2)["adx"], "rsi": K.rsi(b, 14), "bb_position": band_position(b["close"])[0]}


def regime_features(b: Frame) -> Frame:
    """Both families of the regime matrix: volatility, and the range that follows the cycle."""
    close, tr = b["close"], K.true_range(b)
    r = change(np.log(close))
    out = {f"atr_{n}": rolled(tr, n).mean().to_numpy() / close for n in (5, 14, 21, 40)}
    out |= {f"rv_{n}": rolled(r, n).std().to_numpy() for n in (20, 40)}
    out |= {f"vov_{n}": rolled(out[f"rv_{n}"], n).std().to_numpy() for n in (20, 40)}
    typical = (b["high"] + b["low"] + close) / 3
    return out | {"adp_atr": K.adaptive_atr(b, K.dominant_period(typical, 0.5)) / close}


Work = Callable[[Frame, np.ndarray], Frame]


def in_one_pass(bars: DataFrame, frames: dict[str, tuple[int, Work]]) -> DataFrame:
    """``symbol, ts, close`` and every frame's features with its suffix: suffix -> (seconds of a bucket or 0, work on bars and their starts)."""
    probe = {k: np.linspace(1, 2, 3) for k in PRICES}
    names = {suffix: list(work(probe, np.arange(3) * 86_400)) for suffix, (_, work) in frames.items()}
    columns = [f"{n}_{suffix}" for suffix in frames for n in names[suffix]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        seconds = pdf["ts"].astype("int64").to_numpy() // {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}[np.datetime_data(pdf["ts"].dtype)[0]]
        b = {k: pdf[k].to_numpy(dtype=np.float64) for k in PRICES}
        out = {"symbol": pdf["symbol"].to_numpy(), "ts": pdf["ts"].to_numpy(), "close": pdf["close"].to_numpy()}
        with np.errstate(divide="ignore", invalid="ignore"):
            for suffix, (width, work) in frames.items():
                coarse, starts, own = buckets(b, seconds, width)
                for name, x in work(coarse, starts).items():
                    # of the bucket before the bar's own
                    known = np.concatenate(([np.nan], np.asarray(x, dtype=np.float64)))[own]
                    out[f"{name}_{suffix}"] = np.where(np.isfinite(known), known, 0.0)
        return pd.DataFrame(out)[["symbol", "ts", "close", *columns]]

    schema = "symbol string, ts timestamp, close double, " + ", ".join(f"{n} double" for n in columns)
    return bars.where("symbol is not null and ts is not null").select("symbol", "ts", *PRICES).groupBy("symbol").applyInPandas(run, schema)


def meta_label_matrix(bars: DataFrame, fast: int = 0, middle: int = 1800, slow: int = 3600, start: str = "03:00", end: str = "04:30", suffixes: tuple[str, str, str] = ("15m", "30m", "1h")) -> DataFrame:
    """The matrix for meta-labelling: session, volatility, momentum and calendar features of three timeframes, in seconds a bucket (0: the bars)."""
    first, last = (int(t[:2]) * 3600 + int(t[3:]) * 60 for t in (start, end))
    return in_one_pass(bars, {
        suffixes[0]: (fast, lambda b, s: fast_features(b, s, first, last)), suffixes[1]: (middle, lambda b, s: middle_features(b)), suffixes[2]: (slow, lambda b, s: slow_features(b)),
    })


def regime_matrix(bars: DataFrame, frames: dict[str, int]) -> DataFrame:
    """Both families of regime features of every timeframe: suffix -> seconds of a bucket."""
    return in_one_pass(bars, {suffix: (width, lambda b, s: regime_features(b)) for suffix, width in frames.items()})

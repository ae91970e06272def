"""Row-wise expressions: prices, candle shapes, transforms, bet sizes. All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def typical_price() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def is_doji(threshold: float = 0.1) -> Column:
    spread = c("high") - c("low")
    return F.coalesce(F.try_divide(F.abs(c("close") - c("open")), spread) < threshold, F.lit(False))


def _wick_rejection(wick: Column, tail: float, doji: float) -> Column:
    spread = c("high") - c("low")
    body = F.try_divide(F.abs(c("close") - c("open")), spread)
    return F.coalesce((F.try_divide(wick, spread) >= tail) & (body > doji), F.lit(False))


def is_upper_wick_rejection(tail: float = 0.5, doji: float = 0.1) -> Column:
    return _wick_rejection(c("high") - F.greatest("open", "close"), tail, doji)


def is_lower_wick_rejection(tail: float = 0.5, doji: float = 0.1) -> Column:
    return _wick_rejection(F.least("open", "close") - c("low"), tail, doji)


def fisher_transform(x: Column, limit: float = 0.999) -> Column:
    y = F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))
    return 0.5 * F.log((1 + y) / (1 - y))


def cube_root(x: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(1.0 / 3.0))


def inverse_fisher_transform(x: Column) -> Column:
    return F.tanh(x)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by the error function's rational approximation, |error| < 1.5e-7.

    Fixed values: the five coefficients of Abramowitz and Stegun, 7.1.26.
    """
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def probability_to_bet_size(p: Column) -> Column:
    """2 Phi(|z|) - 1 with z = p / sqrt(p (1 - p)), p kept inside (0, 1)."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return 2 * normal_cdf(F.abs(q / F.sqrt(q * (1 - q)))) - 1


def kelly_size(p: Column, ratio: Column, fraction: float = 0.5) -> Column:
    """fraction * ((b + 1) p - 1) / b, within 0 and 1."""
    raw = fraction * F.try_divide((ratio + 1) * p - 1, ratio)
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))


def meta_label(ratio: Column, sl: Column, exit_price: Column) -> Column:
    """0: lost its whole risk; 1: left at the stop (1 %); 2: won over a fifth of its risk; -1: else."""
    at_stop = F.abs(F.try_divide(exit_price - sl, sl)) <= 0.01
    return F.when(ratio < -0.99, 0).when(F.coalesce(at_stop, F.lit(False)), 1).when(ratio > 0.2, 2).otherwise(-1)


def meta_label_binary(reward: Column) -> Column:
    return F.when(reward < 0, 0).when(reward >= 0, 1).otherwise(-1)

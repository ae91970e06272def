"""Feature matrices in one pass: against operators that take one timeframe and one join each, and against plain recomputation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import features as FT
from tidemark.operators import kernels as K
from tidemark.operators import matrices as X
from tidemark.operators import windows as W
from tidemark.sources import views

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def bars(spark):
    return views.bars(spark, SF)


@pytest.fixture(scope="module")
def matrix(bars):
    return X.meta_label_matrix(bars, 0, 7200, 21600, suffixes=("b", "2h", "6h")).orderBy("symbol", "ts").toPandas()


def test_one_shuffle(bars):
    plan = X.meta_label_matrix(bars)._jdf.queryExecution().executedPlan().toString()
    own = bars._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - own.count("Exchange") == 1


def test_regime_matrix_equals_one_join_a_timeframe(bars):
    got = X.regime_matrix(bars, {"2h": 7200, "6h": 21600}).orderBy("symbol", "ts").toPandas()
    names = [f"atr_{n}" for n in (5, 14, 21, 40)] + ["rv_20", "rv_40", "vov_20", "vov_40"]
    want = FT.several_timeframes(bars, {"2h": "2 hours", "6h": "6 hours"}, W.volatility_features, names).orderBy("symbol", "ts").toPandas()
    assert len(got) == len(want) == bars.count()
    for n in names:
        for s in ("2h", "6h"):
            np.testing.assert_allclose(got[f"{n}_{s}"], want[f"{n}_{s}"], atol=1e-9, err_msg=f"{n}_{s}")
    assert (got["adp_atr_2h"] > 0).mean() > 0.9


def coarse(bars, rule):
    """Bars of one symbol by pandas' resampling."""
    pdf = bars.where("symbol = 'view'").orderBy("ts").toPandas().set_index("ts")
    return pdf, pdf.resample(rule).agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}).dropna()


def aligned(features, index):
    return features.shift(1).reindex(index, method="ffill").fillna(0.0)


def test_middle_and_slow_frames_by_pandas(bars, matrix):
    own = matrix[matrix.symbol == "view"]
    for rule, suffix, work in (("2h", "2h", X.middle_features), ("6h", "6h", X.slow_features)):
        pdf, frame = coarse(bars, rule)
        b = {k: frame[k].to_numpy() for k in X.PRICES}
        want = aligned(pd.DataFrame(work(b), index=frame.index).replace([np.inf, -np.inf], np.nan), pdf.index)
        for name in want:
            np.testing.assert_allclose(own[f"{name}_{suffix}"], want[name], atol=1e-9, err_msg=name)


def test_columns_by_plain_windows(bars, matrix):
    """Windowed columns of the bars themselves and of the slow frame, from pandas' own rolling functions."""
    pdf, slow = coarse(bars, "6h")
    r, dollars = np.log(pdf.close).diff(), pdf.close * pdf.volume
    mid, sd = pdf.close.rolling(20).mean(), pdf.close.rolling(20).std()
    day = pdf.index.normalize()
    inside = pdf[(pdf.index.time >= pd.Timestamp("03:00").time()) & (pdf.index.time <= pd.Timestamp("04:30").time())]
    most = pdf[pdf.index.time <= pd.Timestamp("23:15").time()]
    high, low = (pd.Series(day, index=pdf.index).map(g).ffill() for g in (inside.groupby(inside.index.normalize()).high.max(), inside.groupby(inside.index.normalize()).low.min()))
    ph, pl = (pd.Series(day, index=pdf.index).map(g.shift(1)).ffill() for g in (most.groupby(most.index.normalize()).high.max(), most.groupby(most.index.normalize()).low.min()))
    roc = 100 * pdf.close.pct_change(20)
    ends = pdf.groupby(day).agg({"open": "first", "close": "last"})
    want = pd.DataFrame({
        "realized_vol_20": r.rolling(20, min_periods=10).std() * np.sqrt(252), "vol_of_vol_40": r.rolling(40, min_periods=20).std(),
        "dollar_vol_pressure": (np.sign(pdf.close.diff()) * dollars).rolling(21).sum() / dollars.rolling(21).sum(),
        "bb_position": ((pdf.close - mid + 2 * sd) / (4 * sd)).clip(0, 1), "dow_sin": np.sin(2 * np.pi * pdf.index.dayofweek / 5), "dow_cos": np.cos(2 * np.pi * pdf.index.dayofweek / 5),
        "body_ratio": ((pdf.close - pdf.open).abs() / (pdf.high - pdf.low).replace(0, np.nan)).rolling(5).mean(), "roc_20": (roc - roc.rolling(89, min_periods=20).mean()) / roc.rolling(89, min_periods=20).std(),
        "range_high_vs_prev_high": 100 * high / ph, "range_high_vs_prev_range": 100 * (high - ph) / (ph - pl), "range_low_vs_prev_low": 100 * low / pl, "range_low_vs_prev_range": 100 * (low - ph) / (ph - pl),
        "session_range_vs_prev_range": ((high - low) / high) / ((ph - pl) / ph), "overnight_gap": pd.Series(day, index=pdf.index).map(100 * (ends.open / ends.close.shift(1) - 1)),
        "atr_5": K.atr({k: pdf[k].to_numpy() for k in X.PRICES}, 5) / pdf.close,
    }, index=pdf.index).replace([np.inf, -np.inf], np.nan)
    own = matrix[matrix.symbol == "view"]
    for name, x in aligned(want, pdf.index).items():
        np.testing.assert_allclose(own[f"{name}_b"], x, atol=1e-8, err_msg=name)
    mid, sd = slow.close.rolling(20).mean(), slow.close.rolling(20).std()
    np.testing.assert_allclose(own["bb_position_6h"], aligned(((slow.close - mid + 2 * sd) / (4 * sd)).clip(0, 1).to_frame("x"), pdf.index).x, atol=1e-9)


def test_columns_and_no_look_ahead(bars, matrix):
    assert matrix.shape == (bars.count(), 3 + 28 + 11 + 3) and not matrix.isna().any().any()
    early = X.meta_label_matrix(bars.where("ts < '2024-01-15'"), 0, 7200, 21600, suffixes=("b", "2h", "6h")).orderBy("symbol", "ts").toPandas()
    both = matrix[matrix.ts < "2024-01-15"].reset_index(drop=True)
    pd.testing.assert_frame_equal(early, both, check_exact=False, atol=1e-9)


def test_ranks_flat_bars_and_empty(spark, bars):
    x = np.array([3.0, 1.0, 2.0, 2.0, np.nan, 1.0])
    np.testing.assert_allclose(X.share_below(x, 3), [np.nan, np.nan, 2 / 3, 1.0, np.nan, np.nan])
    flat = bars.withColumns({n: F.lit(5.0) for n in X.PRICES})
    assert X.meta_label_matrix(flat, 0, 7200, 21600).count() == bars.count()
    assert X.meta_label_matrix(bars.limit(0)).count() == 0
    assert X.meta_label_matrix(bars.where("symbol = 'view'").limit(1)).count() == 1

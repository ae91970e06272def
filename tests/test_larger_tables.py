"""Queries on larger or other tables than the given ones, against DuckDB's result."""

from __future__ import annotations

import math
import statistics

import duckdb
import numpy as np
import pandas as pd

from tests.conftest import DATA
from tidemark.operators import kernels
from tidemark.plans import registry
from tidemark.sources import views


def oracle(name, folder, *tables):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    return con.execute(registry.oracle_sql()[name]).df()


def same(got, want, keys):
    got, want = (df[sorted(df.columns)].sort_values([*keys, *sorted(set(df.columns) - set(keys))]).reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


FOLD_QUERIES = {
    "reference_scores": ["param_id"], "combined_p_values": ["param_id"], "walk_forward_scorecard": ["param_id"], "path_scores": ["fold"], "path_statistics": ["fold"],
    "cpcv_path_metrics": ["param_id"], "dual_filter": ["param_id"], "tiers": ["param_id"], "normalised_scores": ["param_id"],
}


def test_ranks_of_equal_folds_go_by_key(spark, tmp_path):
    """Six copies of all trades under keys of their own have equal scores, in whatever order the rows come, in every query over folds."""
    line = pd.read_parquet(f"{DATA}/sf0.001/lineitem.parquet")
    step = int(line.l_suppkey.max()) + 1
    copies = pd.concat([line.assign(l_suppkey=line.l_suppkey + step * i) for i in range(6)], ignore_index=True)
    for name, rows in {"given": copies, "dealt": copies.sample(frac=1, random_state=7)}.items():
        (tmp_path / name).mkdir()
        rows.to_parquet(tmp_path / name / "lineitem.parquet", index=False, row_group_size=2000)
    for name, keys in FOLD_QUERIES.items():
        want = oracle(name, tmp_path / "given", "lineitem")
        same(oracle(name, tmp_path / "dealt", "lineitem"), want, keys)
        for folder in ("given", "dealt"):
            same(registry.queries()[name](spark, str(tmp_path / folder)).toPandas(), want, keys)


def test_folds_against_numpy(spark):
    """Means and deviations of the views are those of the plain formula."""
    got = views.folds(spark, f"{DATA}/sf0.001").toPandas().set_index(["param_id", "fold"]).sort_index()
    t = views.trades(spark, f"{DATA}/sf0.001").select("strategy", "l_linenumber", "return_pct").toPandas().groupby(["strategy", "l_linenumber"]).return_pct
    np.testing.assert_allclose(got.mean_ret, t.mean(), atol=1e-10)
    np.testing.assert_allclose(got.sd_ret, t.std(), atol=1e-9)
    assert (got.n == t.size()).all()


def plain_squeeze(high, low, close, period):
    """(on, off, momentum) bar by bar, from the definitions: no window is shared, nothing is carried on."""
    price = [(h + l + c) / 3 for h, l, c in zip(high, low, close, strict=True)]
    ranges = [high[0] - low[0]] + [max(h - l, abs(h - c), abs(l - c)) for h, l, c in zip(high[1:], low[1:], close[:-1], strict=True)]
    reach, out, gaps = sum(ranges[:3]) / 3, [], []
    for i, p in enumerate(period):
        n = int(p) if p >= 1 else 20
        first = max(0, i - n + 1)
        gaps.append(price[i] - ((max(high[first : i + 1]) + min(low[first : i + 1])) / 2 + statistics.mean(close[first : i + 1])) / 2)
        if i >= 3:
            reach += (ranges[i] - reach) / min(max(p, 3.0), 50.0)
        bounded = min(max(p, 6.0), 50.0)
        k, back, mid = int(bounded * 0.5), int(bounded * 0.7), price[i]
        if i >= k + back:
            weights = [abs(price[j] - price[j - back]) for j in range(i - k + 1, i + 1)]
            mid = sum(w * price[j] for w, j in zip(weights, range(i - k + 1, i + 1), strict=True)) / sum(weights)
        y = gaps[first:]
        line = statistics.linear_regression(range(len(y)), y) if len(y) > 1 else None
        momentum = line.slope * (len(y) - 1) + line.intercept if line and p >= 2 else 0.0
        if i < 20:
            out.append((0.0, 0.0, momentum))
            continue
        returns = [price[j] / price[j - 1] - 1 for j in range(i - 19, i + 1)]
        growth = statistics.geometric_mean([1 + r for r in returns])
        band = 0.7 * mid * math.sqrt(max((statistics.variance(returns) + growth**2) ** 20 - growth**40, 0.0))
        out.append((float(band < 1.5 * reach), float(band > 1.5 * reach), momentum))
    return out


def test_squeeze_against_plain_bars():
    """Golden values: all three columns over bars that are quiet, wild and rising in turn."""
    rng = np.random.default_rng(11)
    steps = rng.standard_normal(400) * np.repeat([0.02, 0.3, 0.02, 0.5], 100) + np.repeat([0, 0, 0.2, 0], 100)
    wide = np.repeat([1.0, 40.0, 9.0, 1.0], 100)
    close = 100 + np.cumsum(steps) + 4 * np.sin(np.arange(400) / 3)
    b = {"open": close, "close": close, "high": close + wide * rng.random(400), "low": close - wide * rng.random(400), "volume": close}
    got = kernels.squeeze(b)
    period = kernels.dominant_period((b["high"] + b["low"] + b["close"]) / 3, part=1.0)
    want = np.array(plain_squeeze(*(b[k].tolist() for k in ("high", "low", "close")), period.tolist()))
    np.testing.assert_array_equal(got["squeeze_on"], want[:, 0])
    np.testing.assert_array_equal(got["squeeze_off"], want[:, 1])
    np.testing.assert_allclose(got["squeeze_momentum"], want[:, 2], atol=1e-8)
    assert 20 < want[:, 0].sum() < 380 and 20 < want[:, 1].sum() < 380


def test_squeeze_needs_twenty_returns(spark, tmp_path):
    """Wide bars that close alike are a squeeze from bar 21 on, the first that has twenty returns, and no bar before is on or off."""
    start = pd.Timestamp("2024-01-01")
    rows = [(start + pd.Timedelta(hours=h, minutes=10 * k), v) for h in range(40) for k, v in enumerate((50.0, 90.0 + h % 3, 10.0, 50.0 + h % 4 / 100))]
    events = pd.DataFrame(rows, columns=["ts", "value"]).assign(event_type="view")
    events.assign(event_id=range(len(events)), ts=events.ts.astype("datetime64[us]")).to_parquet(tmp_path / "events.parquet", index=False)
    got = registry.queries()["squeeze"](spark, str(tmp_path)).toPandas()
    same(got, oracle("squeeze", tmp_path, "events"), ["symbol", "ts"])
    got = got.sort_values("ts")
    assert got.squeeze_on.tolist()[18:22] == [0.0, 0.0, 1.0, 1.0] and not got.squeeze_off.tolist()[0]
    assert (got.squeeze_on + got.squeeze_off).tolist()[:20] == [0.0] * 20

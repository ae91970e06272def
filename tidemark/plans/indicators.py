"""Registered queries of bars and bounded-window indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import resample as R
from tidemark.operators import windows as W
from tidemark.sources import views as V


def rounded(df: DataFrame, *names: str, keys: tuple[str, ...] = ("symbol",), digits: int = 6) -> DataFrame:
    """Keys, time in seconds, and the named values to a fixed number of digits."""
    return df.select(*keys, V.epoch(), *(F.round(n, digits).alias(n) for n in names))


def on_bars(work, *names: str, digits: int = 6):
    """A query that applies ``work`` to the hourly bars and returns the named columns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(V.bars(spark, sf_dir).transform(work), *names, digits=digits)

    return query


def flags(work, *names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = V.bars(spark, sf_dir).transform(work)
        return df.select("symbol", V.epoch(), *(F.col(n).cast("int").alias(n) for n in names))

    return query


def over_bars(body: str) -> str:
    """SQL over ``v_bars`` with the usual window ``w`` and the seconds of the bar's time as ``sec``."""
    return V.oracle(body, "v_bars")


TS = "CAST(epoch(ts) AS BIGINT) AS ts"
W_ = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {n} THEN avg({x}) OVER {rows(n)} END"


def sd(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {n} THEN stddev_samp({x}) OVER {rows(n)} END"


def ext(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {n} THEN {f}({x}) OVER {rows(n)} END"


TR = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"


def bars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.bars(spark, sf_dir), "open", "high", "low", "close", "volume")


def resample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.resample_ohlc(V.bars(spark, sf_dir), "6 hours"), "open", "high", "low", "close", "volume")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: trend, oscillator, volatility and volume indicators of every bar in one sort per symbol."""
    df = V.bars(spark, sf_dir)
    for step in (W.bollinger, W.williams_r, W.stochastic, W.roc, W.obv, W.zscore):
        df = df.transform(step)
    return rounded(df, "close", "bb_mid", "bb_width", "williams_r", "stoch_k", "stoch_d", "roc", "obv", "zscore")


def asof_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = V.bars(spark, sf_dir)
    daily = R.resample_ohlc(bars, "1 day").select("symbol", "ts", "close", "high")
    out = R.align_higher(bars.select("symbol", "ts"), daily, ["close", "high"], "_1d")
    return rounded(out, "close_1d", "high_1d")


def news_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.mark_news(V.bars(spark, sf_dir), V.news(spark, sf_dir), n_bars=1, timezone="UTC", impacts=("red",))
    return out.select("symbol", V.epoch(), "news")


def scalars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.bars(spark, sf_dir)
    x = (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 1)
    df = df.withColumns({
        "typical": S.typical_price(), "fisher": S.fisher_transform(x), "cube": S.cube_root(x), "inv_fisher": S.inverse_fisher_transform(x),
        "doji": S.is_doji().cast("double"), "upper_wick": S.is_upper_wick_rejection().cast("double"),
        "lower_wick": S.is_lower_wick_rejection().cast("double"), "bet": S.kelly_size(F.abs(x), F.lit(1.5)),
    })
    return rounded(df, "typical", "fisher", "cube", "inv_fisher", "doji", "upper_wick", "lower_wick", "bet")


def month_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.resample_returns(V.returns(spark, sf_dir)), "ret", keys=("asset",), digits=8)


def daily_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.resample_last(V.equity(spark, sf_dir), "asset", "equity", "WEEK"), "equity", keys=("asset",), digits=4)


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rebalance_dates(V.returns(spark, sf_dir)).select(V.epoch("period"), V.epoch())


def annualization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.annualization_factor(V.bars(spark, sf_dir), "symbol").select("symbol", F.round("factor", 6).alias("factor"))


def next_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.extend_with_next_month(V.returns(spark, sf_dir)), "ret", keys=("asset",), digits=12)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.normalize_equity(V.equity(spark, sf_dir)), "equity_normalized", keys=("asset",), digits=2)


def frac_sql() -> str:
    w = W.fracdiff_weights(0.4, 1e-2)
    terms = " + ".join(f"({x!r}) * lag(close, {k}) OVER w" for k, x in enumerate(w))
    return over_bars(f"SELECT symbol, {TS}, round({terms}, 6) AS fracdiff FROM v_bars {W_}")


QUERIES = {
    "bars": (bars_query, over_bars(f"SELECT symbol, {TS}, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, volume FROM v_bars")),
    "resample_ohlc": (resample_query, over_bars(
        """SELECT symbol, CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS ts, round(first(open ORDER BY ts), 6) AS open,
        round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, sum(volume) AS volume
        FROM v_bars GROUP BY symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')""")),
    "indicator_panel": (panel, over_bars(f"""WITH a AS (SELECT symbol, ts, close,
        {sma('close', 20)} AS mid, {sd('close', 20)} AS dev, {ext('max', 'high', 14)} AS h14, {ext('min', 'low', 14)} AS l14,
        {ext('max', 'high', 18)} AS h18, {ext('min', 'low', 18)} AS l18, lag(close, 10) OVER w AS c10,
        coalesce(sign(close - lag(close) OVER w) * volume, 0) AS step,
        CASE WHEN count(close) OVER {rows(252)} >= 20 THEN (close - avg(close) OVER {rows(252)}) / nullif(stddev_samp(close) OVER {rows(252)}, 0) END AS z
        FROM v_bars {W_}),
        b AS (SELECT *, 100 * (close - l18) / nullif(h18 - l18, 0) AS raw FROM a), k AS (SELECT *, {sma('raw', 2)} AS sk FROM b)
        SELECT symbol, {TS}, round(close, 6) AS close, round(mid, 6) AS bb_mid, round(2 * 2.0 * dev / (mid + 1e-9), 6) AS bb_width,
        round(-100 * (h14 - close) / nullif(h14 - l14, 0), 6) + 0.0 AS williams_r, round(sk, 6) AS stoch_k, round({sma('sk', 6)}, 6) AS stoch_d,
        round((close / nullif(c10, 0) - 1) * 100, 6) AS roc, round(sum(step) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS obv,
        round(z, 6) AS zscore FROM k""")),
    "bollinger": (on_bars(W.bollinger, "bb_mid", "bb_up", "bb_low", "bb_width"), over_bars(f"""WITH a AS (SELECT symbol, ts, {sma('close', 20)} AS m, {sd('close', 20)} AS d FROM v_bars)
        SELECT symbol, {TS}, round(m, 6) AS bb_mid, round(m + 2 * d, 6) AS bb_up, round(m - 2 * d, 6) AS bb_low, round(4 * d / (m + 1e-9), 6) AS bb_width FROM a""")),
    "percentile_rank": (on_bars(W.percentile_rank, "pct_rank"), over_bars(f"""WITH a AS (SELECT symbol, ts, list(close) OVER {rows(20)} AS l, close FROM v_bars)
        SELECT symbol, {TS}, round(CASE WHEN len(l) >= 20 THEN len(list_filter(l, lambda v: v <= close)) / 20.0 END, 6) AS pct_rank FROM a""")),
    "chandelier": (on_bars(W.chandelier, "ce_long", "ce_short"), over_bars(f"""WITH a AS (SELECT *, {TR} AS tr FROM v_bars {W_})
        SELECT symbol, {TS}, round({ext('max', 'high', 22)} - 9 * {sma('tr', 22)}, 6) AS ce_long, round({ext('min', 'low', 22)} + 9 * {sma('tr', 22)}, 6) AS ce_short FROM a""")),
    "combined_volatility": (on_bars(lambda d: W.combined_volatility(d.withColumns({x: F.col(x) + 1000 for x in ("open", "high", "low", "close")})), "vol_parkinson", "vol_rs", "vol_yz", "vol_geo", "vol_combined", digits=5), over_bars(f"""
        WITH s AS (SELECT symbol, ts, open + 1000 AS open, high + 1000 AS high, low + 1000 AS low, close + 1000 AS close FROM v_bars),
        a AS (SELECT *, ln(high / low) AS p, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / lag(close) OVER w) AS onr,
          ln(close / open) AS oc, close / lag(close) OVER w - 1 AS r FROM s {W_}),
        b AS (SELECT *, ln(1 + r) AS lr FROM a),
        v AS (SELECT symbol, ts, sqrt(({sma('p', 20)}) / (4 * ln(2)) * 252) AS vp, sqrt(({sma('rs', 20)}) * 252) AS vrs,
          sqrt((({ext('var_samp', 'onr', 20)}) + 0.34 / (1.34 + 21.0 / 19.0) * ({ext('var_samp', 'oc', 20)}) + (1 - 0.34 / (1.34 + 21.0 / 19.0)) * ({sma('rs', 20)})) * 252) AS vyz,
          exp({sma('lr', 40)}) - 1 AS g, {ext('var_samp', 'r', 40)} AS v2 FROM b),
        u AS (SELECT *, sqrt(pow(v2 + (1 + g) * (1 + g), 252) - pow(1 + g, 504)) AS vg FROM v),
        k AS (SELECT symbol, median(vg / nullif(vp, 0)) AS kp, median(vg / nullif(vrs, 0)) AS krs, median(vg / nullif(vyz, 0)) AS kyz FROM u GROUP BY symbol)
        SELECT symbol, {TS}, round(vp, 5) AS vol_parkinson, round(vrs, 5) AS vol_rs, round(vyz, 5) AS vol_yz, round(vg, 5) AS vol_geo,
        round((vg + vp * kp + vrs * krs + vyz * kyz) / 4, 5) AS vol_combined FROM u JOIN k USING (symbol)""")),
    "rolling_ols": (on_bars(W.rolling_ols, "ols_slope", "ols_intercept", digits=5), over_bars(f"""
        WITH a AS (SELECT symbol, ts, list(close) OVER {rows(20)} AS l FROM v_bars), b AS (SELECT *, list_sum(list_transform(l, lambda y, i: y * (20 - i))) AS sxy, list_sum(l) AS sy FROM a)
        SELECT symbol, {TS}, round(CASE WHEN len(l) = 20 THEN (20 * sxy - 190 * sy) / (20 * 2470 - 190 * 190) END, 5) AS ols_slope,
        round(CASE WHEN len(l) = 20 THEN (sy - 190 * (20 * sxy - 190 * sy) / (20 * 2470 - 190 * 190)) / 20 END, 5) AS ols_intercept FROM b""")),
    "vwap": (on_bars(W.vwap, "vwap"), over_bars(f"""SELECT symbol, {TS}, round(sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0), 6) AS vwap
        FROM v_bars WINDOW d AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)""")),
    "detrended": (on_bars(W.detrended, "dpo", "wma"), over_bars(f"""WITH a AS (SELECT *, list(close) OVER {rows(30)} AS l FROM v_bars)
        SELECT symbol, {TS}, round(lag(close, 11) OVER w - ({sma('close', 20)}), 6) AS dpo,
        round(CASE WHEN len(l) = 30 THEN list_sum(list_transform(l, lambda y, i: y * i)) / 465 END, 6) AS wma FROM a {W_}""")),
    "fractals": (flags(W.fractals, "fractal_up", "fractal_down", "fractal_up_known", "fractal_down_known"), over_bars(f"""
        WITH a AS (SELECT symbol, ts, coalesce(count(*) OVER b = 2 AND count(*) OVER f = 2 AND high > max(high) OVER b AND high > max(high) OVER f, false) AS u,
          coalesce(count(*) OVER b = 2 AND count(*) OVER f = 2 AND low < min(low) OVER b AND low < min(low) OVER f, false) AS d FROM v_bars
          WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
        SELECT symbol, {TS}, CAST(u AS INT) AS fractal_up, CAST(d AS INT) AS fractal_down, CAST(coalesce(lag(u, 2) OVER w, false) AS INT) AS fractal_up_known,
        CAST(coalesce(lag(d, 2) OVER w, false) AS INT) AS fractal_down_known FROM a {W_}""")),
    "day_change": (flags(W.day_change, "day_change"), over_bars(f"""SELECT symbol, {TS}, CAST(coalesce(CAST(lead(ts, 2) OVER w AS DATE) <> CAST(ts AS DATE), true)
        OR strftime(ts, '%H:%M:%S') = '15:45:00' AS INT) AS day_change FROM v_bars {W_}""")),
    "market_calls": (flags(W.market_calls, "market_call"), over_bars(f"""
        WITH a AS (SELECT *, CAST(close > lag(close) OVER w AS INT) AS up, CAST(close < lag(close) OVER w AS INT) AS dn, sign(close - lag(close, 5) OVER w) AS tr,
          sign(({sma('close', 10)}) - ({sma('close', 20)})) AS mom FROM v_bars {W_}),
        b AS (SELECT *, sum(up) OVER {rows(20)} / nullif(sum(dn) OVER {rows(20)}, 0) AS ratio, lag(tr, 5) OVER w AS tr5 FROM a {W_}),
        k AS (SELECT *, CASE WHEN ratio > 1 AND tr = 1 AND tr5 = 1 AND mom > 0 THEN 1 WHEN ratio < 1 AND tr = -1 AND tr5 = -1 AND mom < 0 THEN -1 END AS call FROM b)
        SELECT symbol, {TS}, coalesce(last_value(call IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS market_call FROM k""")),
    "extend_signal": (flags(lambda d: W.extend_signal(W.fractals(d), "fractal_up", 3), "fractal_up_extended"), over_bars(f"""
        WITH a AS (SELECT symbol, ts, CAST(coalesce(count(*) OVER b = 2 AND count(*) OVER f = 2 AND high > max(high) OVER b AND high > max(high) OVER f, false) AS INT) AS u FROM v_bars
          WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
        SELECT symbol, {TS}, max(u) OVER {rows(3)} AS fractal_up_extended FROM a""")),
    "geometric_mean": (on_bars(lambda d: W.geometric_mean(d.withColumn("close", F.col("close") + 1000)), "geo_mean", digits=8), over_bars(f"""
        WITH a AS (SELECT *, ln(1 + coalesce((close + 1000) / lag(close + 1000) OVER w - 1, 0)) AS r FROM v_bars {W_}) SELECT symbol, {TS}, round(exp({sma('r', 20)}) - 1, 8) AS geo_mean FROM a""")),
    "session_ranges": (on_bars(W.session_ranges, "session_high", "session_low", "session_range_pct"), over_bars(f"""
        WITH a AS (SELECT symbol, ts, max(CASE WHEN strftime(ts, '%H:%M') BETWEEN '03:00' AND '04:30' THEN high END) OVER d AS h, min(CASE WHEN strftime(ts, '%H:%M') BETWEEN '03:00' AND '04:30' THEN low END) OVER d AS l
          FROM v_bars WINDOW d AS (PARTITION BY symbol, CAST(ts AS DATE))),
        b AS (SELECT symbol, ts, last_value(h IGNORE NULLS) OVER c AS h, last_value(l IGNORE NULLS) OVER c AS l FROM a WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))
        SELECT symbol, {TS}, round(h, 6) AS session_high, round(l, 6) AS session_low, round((h - l) / nullif(h, 0) * 100, 6) AS session_range_pct FROM b""")),
    "gap_features": (on_bars(W.gap_features, "gap", "gap_pct", "gap_beyond_range", "gap_direction"), over_bars(f"""
        WITH d AS (SELECT symbol, date_trunc('day', ts) AS u, first(open ORDER BY ts) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS c FROM v_bars GROUP BY 1, 2),
        g AS (SELECT symbol, u, o, lag(c) OVER x AS pc, lag(h) OVER x AS ph, lag(l) OVER x AS pl FROM d WINDOW x AS (PARTITION BY symbol ORDER BY u))
        SELECT symbol, {TS}, round(o - pc, 6) AS gap, round((o - pc) / nullif(pc, 0) * 100, 6) AS gap_pct, CASE WHEN o > ph THEN 1.0 WHEN o < pl THEN -1.0 END::DOUBLE AS gap_beyond_range,
        CAST(sign(o - pc) AS DOUBLE) AS gap_direction FROM v_bars b JOIN g USING (symbol) WHERE date_trunc('day', ts) = u""")),
    "fracdiff": (on_bars(W.fracdiff, "fracdiff"), frac_sql()),
    "volatility_features": (on_bars(lambda d: W.volatility_features(d.withColumns({x: F.col(x) + 1000 for x in ("open", "high", "low", "close")})), "atr_14", "rv_20", "vov_20", digits=8), over_bars(f"""
        WITH s AS (SELECT symbol, ts, high + 1000 AS high, low + 1000 AS low, close + 1000 AS close FROM v_bars), a AS (SELECT *, {TR} AS tr, ln(close / lag(close) OVER w) AS r FROM s {W_}),
        b AS (SELECT *, {sd('r', 20)} AS rv FROM a)
        SELECT symbol, {TS}, round(coalesce(({sma('tr', 14)}) / close, 0), 8) AS atr_14, round(coalesce(rv, 0), 8) AS rv_20, round(coalesce({sd('rv', 20)}, 0), 8) AS vov_20 FROM b""")),
    "asof_align": (asof_query, over_bars(f"""WITH d AS (SELECT symbol, date_trunc('day', ts) AS u, max(high) AS h, last(close ORDER BY ts) AS c FROM v_bars GROUP BY 1, 2),
        g AS (SELECT symbol, u, lag(c) OVER x AS c, lag(h) OVER x AS h FROM d WINDOW x AS (PARTITION BY symbol ORDER BY u))
        SELECT b.symbol, {TS.replace('epoch(ts)', 'epoch(b.ts)')}, round(g.c, 6) AS close_1d, round(g.h, 6) AS high_1d FROM v_bars b ASOF LEFT JOIN g ON b.symbol = g.symbol AND b.ts >= g.u""")),
    "news_flags": (news_query, V.oracle(f"""WITH b AS (SELECT symbol, ts FROM v_bars), y AS (SELECT DISTINCT symbol FROM b), h AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM v_news WHERE event = 'Bank Holiday'),
        e AS (SELECT DISTINCT ts FROM v_news WHERE impact = 'red' AND event <> 'Bank Holiday'), z AS (SELECT e.ts, symbol FROM e CROSS JOIN y),
        n AS (SELECT DISTINCT b.symbol, b.ts FROM z ASOF JOIN b ON z.symbol = b.symbol AND z.ts <= b.ts),
        f AS (SELECT b.symbol, b.ts, CASE WHEN n.ts IS NOT NULL OR h.d IS NOT NULL THEN 1 ELSE 0 END AS f FROM b LEFT JOIN n ON n.symbol = b.symbol AND n.ts = b.ts LEFT JOIN h ON h.d = CAST(b.ts AS DATE))
        SELECT symbol, {TS}, max(f) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS news FROM f""", "v_bars", "v_news")),
    "scalar_functions": (scalars_query, over_bars(f"""WITH a AS (SELECT *, (close - open) / (high - low + 1) AS x, high - low AS s FROM v_bars)
        SELECT symbol, {TS}, round((high + low + close) / 3, 6) AS typical, round(0.5 * ln((1 + greatest(least(x, 0.999), -0.999)) / (1 - greatest(least(x, 0.999), -0.999))), 6) AS fisher,
        round(sign(x) * pow(abs(x), 1.0 / 3), 6) AS cube, round((exp(2 * x) - 1) / (exp(2 * x) + 1), 6) AS inv_fisher, CAST(coalesce(abs(close - open) / nullif(s, 0) < 0.1, false) AS DOUBLE) AS doji,
        CAST(coalesce((high - greatest(open, close)) / nullif(s, 0) >= 0.5 AND abs(close - open) / nullif(s, 0) > 0.1, false) AS DOUBLE) AS upper_wick,
        CAST(coalesce((least(open, close) - low) / nullif(s, 0) >= 0.5 AND abs(close - open) / nullif(s, 0) > 0.1, false) AS DOUBLE) AS lower_wick,
        round(greatest(least(0.5 * (2.5 * abs(x) - 1) / 1.5, 1.0), 0.0), 6) AS bet FROM a""")),
    "monthly_returns": (month_returns, V.oracle("SELECT asset, CAST(epoch(date_trunc('month', ts)) AS BIGINT) AS ts, round(product(1 + ret) - 1, 8) AS ret FROM v_returns GROUP BY asset, date_trunc('month', ts)", "v_returns")),
    "weekly_equity": (daily_last, V.oracle("SELECT asset, CAST(epoch(date_trunc('week', ts)) AS BIGINT) AS ts, round(arg_max(equity, ts), 4) AS equity FROM v_equity GROUP BY asset, date_trunc('week', ts)", "v_equity")),
    "rebalance_dates": (schedule, V.oracle("SELECT CAST(epoch(date_trunc('quarter', ts)) AS BIGINT) AS period, CAST(epoch(max(ts)) AS BIGINT) AS ts FROM v_returns GROUP BY date_trunc('quarter', ts)", "v_returns")),
    "annualization_factor": (annualization, over_bars("SELECT symbol, round(median(n) * 252, 6) AS factor FROM (SELECT symbol, CAST(ts AS DATE) AS d, count(*) AS n FROM v_bars GROUP BY 1, 2) GROUP BY symbol")),
    "extend_next_month": (next_month, V.oracle(f"""WITH m AS (SELECT asset, date_trunc('month', max(ts)) + INTERVAL 1 MONTH AS ts, 0.0 AS ret FROM v_returns GROUP BY asset)
        SELECT asset, {TS}, round(ret, 12) AS ret FROM v_returns UNION ALL SELECT asset, {TS}, ret FROM m""", "v_returns")),
    "normalize_equity": (normalized, V.oracle(f"""WITH a AS (SELECT *, ln(equity / lag(equity) OVER w) AS r FROM v_equity WINDOW w AS (PARTITION BY asset ORDER BY ts)),
        b AS (SELECT *, coalesce(r * 0.1 / nullif(CASE WHEN count(r) OVER x >= 60 THEN stddev_samp(r) OVER x * sqrt(252) END, 0), 0) AS s FROM a WINDOW x AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
        SELECT asset, {TS}, round(first_value(equity) OVER y * exp(sum(s) OVER y), 2) AS equity_normalized FROM b WINDOW y AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)""", "v_equity")),
}

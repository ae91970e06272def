"""Registered queries of equity and trade metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.sources import views as V

ORDER = V.TRADE_ORDER
ORDER_SQL = ", ".join(ORDER)


#: Values that are short decimals can lie halfway between two rounded ones, where engines differ in the
#: last bit; seven digits are rounded after this shift in both.
NUDGE = 1.7e-8


def out(df: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    shift = NUDGE if digits == 7 else 0.0
    return df.select(*keys, *(F.round(F.col(n).cast("double") + shift, digits).alias(n) for n in names))


def on_equity(work, keys, names, digits=6):
    return lambda spark, sf_dir: out(work(V.equity(spark, sf_dir)), keys, names, digits)


def on_trades(work, keys, names, digits=6):
    return lambda spark, sf_dir: out(work(V.trades(spark, sf_dir)), keys, names, digits)


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE) + {NUDGE if digits == 7 else 0.0!r}, {digits}) AS {name}"


DAILY = """dd AS (SELECT asset, CAST(ts AS DATE) AS day, arg_max(equity, ts) AS equity FROM v_equity GROUP BY 1, 2),
 dr AS (SELECT asset, day, equity / lag(equity) OVER (PARTITION BY asset ORDER BY day) - 1 AS r FROM dd), d AS (SELECT * FROM dr WHERE r IS NOT NULL)"""
DRAW = "x AS (SELECT *, 1 - equity / max(equity) OVER c AS dd, ln(equity / lag(equity) OVER (PARTITION BY asset ORDER BY ts)) AS lr FROM v_equity WINDOW c AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING))"
RR = """rr AS (SELECT *, (size * (exit_price - entry_price) - commission) / nullif(abs(entry_price - sl) * abs(size), 0) AS rr,
 CASE WHEN size > 0 THEN 'long' ELSE 'short' END AS dir FROM v_trades)"""
TRADE_NAMES = ["trades", "win_rate", "profit_factor", "profit_factor_returns", "avg_trade", "avg_win", "avg_loss", "mean_rr", "median_rr", "sd_rr"]
TRADE_SQL = ", ".join([
    r("count(*)", "trades"), r("avg(CAST(pnl > 0 AS DOUBLE)) * 100", "win_rate"), r("sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0)", "profit_factor", 4),
    r("sum(return_pct) FILTER (return_pct > 0) / -sum(return_pct) FILTER (return_pct < 0)", "profit_factor_returns", 4),
    r("(exp(avg(ln(1 + return_pct))) - 1) * 100", "avg_trade"), r("(exp(avg(ln(1 + return_pct)) FILTER (pnl > 0)) - 1) * 100", "avg_win"),
    r("(exp(avg(ln(1 + return_pct)) FILTER (pnl < 0)) - 1) * 100", "avg_loss"), r("avg(rr)", "mean_rr"), r("median(rr)", "median_rr"), r("stddev_samp(rr)", "sd_rr"),
])


def trade_query(work, keys):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = work(V.trades(spark, sf_dir))
        return df.select(*keys, *(F.round(F.col(n).cast("double"), 4 if n.startswith("profit") else 6).alias(n) for n in TRADE_NAMES))

    return query


def regime_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.equity(spark, sf_dir).select(F.col("asset").alias("test_id"), "ts", "equity")
    return M.merge_curves(e).select("test_id", V.epoch(), F.round("equity", 4).alias("equity"))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(M.drawdown_episodes(V.equity(spark, sf_dir)).withColumn("start", F.unix_timestamp("start")), ["asset", "start", "seconds"], ["depth"], 6)


def deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.deepest_drawdown(V.equity(spark, sf_dir))
    return d.select("asset", F.round("depth", 6).alias("depth"), V.epoch("low_ts"), V.epoch("peak_ts"))


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.trades(spark, sf_dir)
    zone = M.binned(t, "entry_indicator", [0.0, 10, 20, 30, 40, 50])
    return trade_query(lambda _: M.trade_metrics(t.withColumn("zone", zone).where("zone is not null"), "zone"), ["zone"])(spark, sf_dir)


REPORT = ["total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown", "ulcer", "calmar"]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.full_report(V.equity(spark, sf_dir)).where(F.col("metric").isin(REPORT))
    return out(rows, ["asset", "metric"], ["value"], 5)


ANNUAL_SQL = f"""WITH {DAILY}, g AS (SELECT asset, count(*) AS days, exp(avg(ln(1 + r))) - 1 AS g, var_samp(r) AS v, avg(pow(least(r, 0), 2)) AS dn FROM d GROUP BY asset),
 a AS (SELECT *, pow(1 + g, 252) - 1 AS ar, sqrt(pow(v + (1 + g) * (1 + g), 252) - pow(1 + g, 504)) AS av FROM g)"""
MOMENTS = "m AS (SELECT asset, count(*) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) AS sk, kurtosis(r) + 3 AS ku FROM d GROUP BY asset)"

#: The normal distribution function of ``z``, by its series of odd powers over odd factorials.
PHI = """0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))))"""

QUERIES = {
    "drawdown": (on_equity(lambda e: M.drawdown(e).withColumn("ts", F.unix_timestamp("ts")), ["asset", "ts"], ["drawdown"]),
                 V.oracle(f"WITH {DRAW} SELECT asset, CAST(epoch(ts) AS BIGINT) AS ts, {r('dd', 'drawdown')} FROM x", "v_equity")),
    "log_returns": (on_equity(lambda e: M.log_returns(e).withColumn("ts", F.unix_timestamp("ts")), ["asset", "ts"], ["log_ret"], 9),
                    V.oracle(f"WITH {DRAW} SELECT asset, CAST(epoch(ts) AS BIGINT) AS ts, {r('lr', 'log_ret', 9)} FROM x", "v_equity")),
    "drawdown_episodes": (islands, V.oracle(f"""WITH {DRAW}, i AS (SELECT *, sum(CAST(dd = 0 AS INT)) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM x)
        SELECT asset, CAST(epoch(min(ts)) AS BIGINT) AS start, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS seconds, {r('max(dd)', 'depth')} FROM i GROUP BY asset, island HAVING max(dd) > 0""", "v_equity")),
    "annualized_metrics": (on_equity(M.annualized, ["asset"], ["days", "annual_return", "annual_vol", "sharpe", "sortino"]),
        V.oracle(f"{ANNUAL_SQL} SELECT asset, {r('days', 'days')}, {r('ar', 'annual_return')}, {r('av', 'annual_vol')}, {r('ar / av', 'sharpe')}, {r('ar / (sqrt(dn) * sqrt(252))', 'sortino')} FROM a", "v_equity")),
    "rolling_sharpe": (on_equity(lambda e: M.rolling_sharpe(e).withColumn("day", F.unix_timestamp(F.col("day").cast("timestamp"))), ["asset", "day"], ["rolling_sharpe"], 5),
        V.oracle(f"""WITH {DAILY}, g AS (SELECT asset, day, count(r) OVER w AS n, exp(avg(ln(1 + r)) OVER w) - 1 AS g, var_samp(r) OVER w AS v FROM d WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
        SELECT asset, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS day, {r('(pow(1 + g, 252) - 1) / sqrt(pow(v + (1 + g) * (1 + g), 252) - pow(1 + g, 504))', 'rolling_sharpe', 5)} FROM g WHERE n >= 60""", "v_equity")),
    "probabilistic_sharpe": (on_equity(lambda e: M.probabilistic_sharpe(e).drop("psr"), ["asset"], ["n", "sr", "skew", "kurt", "min_trl"]),
        V.oracle(f"""WITH {DAILY}, {MOMENTS} SELECT asset, {r('n', 'n')}, {r('sr', 'sr')}, {r('sk', 'skew')}, {r('ku', 'kurt')},
        {r("CASE WHEN sr > 1 / sqrt(252) THEN ceil(1 + (1 - sk * sr + (ku - 1) / 4 * sr * sr) * pow(1.6448536269514715 / (sr - 1 / sqrt(252)), 2)) ELSE 'inf'::DOUBLE END", 'min_trl')} FROM m""", "v_equity")),
    "deflated_sharpe": (on_equity(lambda e: M.deflated_sharpe(e, 20, 0.5), ["asset"], ["dsr"], 5),
        V.oracle(f"""WITH {DAILY}, {MOMENTS}, z AS (SELECT asset, (sr - {M.expected_max_sharpe(20, 0.5)!r} / 252) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM m) SELECT asset, {r(PHI, 'dsr', 5)} FROM z""", "v_equity")),
    "curve_risk": (on_equity(M.curve_risk, ["asset"], ["max_drawdown", "mean_drawdown", "ulcer", "best", "worst", "var", "cvar"]),
        V.oracle(f"""WITH {DRAW}, b AS (SELECT asset, max(dd) AS md, avg(dd) AS ad, sqrt(avg(dd * dd)) * 100 AS u, max(lr) * 100 AS b, min(lr) * 100 AS w, quantile_cont(lr, 0.05) AS q FROM x GROUP BY asset),
        t AS (SELECT asset, avg(lr) AS cv FROM x JOIN b USING (asset) WHERE lr <= q GROUP BY asset)
        SELECT asset, {r('md', 'max_drawdown')}, {r('ad', 'mean_drawdown')}, {r('u', 'ulcer')}, {r('b', 'best')}, {r('w', 'worst')}, {r('q', 'var')}, {r('cv', 'cvar')} FROM b JOIN t USING (asset)""", "v_equity")),
    "full_report": (report, V.oracle(f"""{ANNUAL_SQL}, {DRAW}, k AS (SELECT asset, max(dd) AS md, sqrt(avg(dd * dd)) * 100 AS u, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS tr FROM x GROUP BY asset),
        j AS (SELECT asset, tr AS total_return, ar AS annual_return, av AS annual_vol, ar / av AS sharpe, md AS max_drawdown, u AS ulcer, ar / md AS calmar FROM a JOIN k USING (asset))
        SELECT asset, metric, round(value, 5) AS value FROM j UNPIVOT (value FOR metric IN ({', '.join(REPORT)}))""", "v_equity")),
    "deepest_drawdown": (deepest, V.oracle(f"""WITH {DRAW}, p AS (SELECT *, arg_max(ts, (equity, -epoch(ts))) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM x)
        SELECT asset, {r('max(dd)', 'depth')}, CAST(epoch(arg_max(ts, dd)) AS BIGINT) AS low_ts, CAST(epoch(arg_max(peak, dd)) AS BIGINT) AS peak_ts FROM p GROUP BY asset""", "v_equity")),
    "weekday_stats": (on_equity(M.weekday_stats, ["asset", "weekday"], ["n", "win_rate", "mean", "median", "sd", "profit_factor", "total"]),
        V.oracle(f"""WITH {DAILY}, w AS (SELECT asset, product(1 + r) - 1 AS r FROM d GROUP BY asset, date_trunc('week', day)),
        u AS (SELECT asset, dayofweek(day) + 1 AS weekday, r FROM d UNION ALL SELECT asset, 0, r FROM w)
        SELECT asset, CAST(weekday AS INT) AS weekday, {r('count(*)', 'n')}, {r('avg(CAST(r > 0 AS DOUBLE)) * 100', 'win_rate')}, {r('avg(r)', 'mean')}, {r('median(r)', 'median')}, {r('stddev_samp(r)', 'sd')},
        {r('sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0)', 'profit_factor')}, {r('sum(r)', 'total')} FROM u GROUP BY 1, 2""", "v_equity")),
    "monthly_performance": (on_equity(lambda e: M.monthly_performance(e).withColumn("month", F.unix_timestamp(F.col("month").cast("timestamp"))), ["asset", "month"], ["ret", "vol", "rolling_sharpe"]),
        V.oracle(f"""WITH {DAILY}, g AS (SELECT asset, date_trunc('month', day) AS month, product(1 + r) - 1 AS ret, stddev_samp(r) * sqrt(252) AS vol FROM d GROUP BY 1, 2)
        SELECT asset, CAST(epoch(CAST(month AS TIMESTAMP)) AS BIGINT) AS month, {r('ret', 'ret')}, {r('vol', 'vol')}, {r('CASE WHEN count(ret) OVER w >= 12 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(12) END', 'rolling_sharpe')}
        FROM g WINDOW w AS (PARTITION BY asset ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "v_equity")),
    "merge_equity_curves": (regime_merge, V.oracle("SELECT min(asset) AS test_id, CAST(epoch(ts) AS BIGINT) AS ts, round(arg_min(equity, asset), 4) AS equity FROM v_equity GROUP BY ts", "v_equity")),
    "equal_weight": (lambda s, d: M.equal_weight(V.equity(s, d)).select(F.unix_timestamp(F.col("day").cast("timestamp")).alias("day"), F.round("r", 5).alias("r"), F.round("growth", 6).alias("growth")),
        V.oracle("""WITH q AS (SELECT *, equity / lag(equity) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM v_equity), m AS (SELECT CAST(ts AS DATE) AS day, avg(r) AS r FROM q GROUP BY 1)
        SELECT CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS day, round(r, 5) AS r, round(exp(sum(coalesce(ln(1 + r), 0)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)), 6) AS growth FROM m""", "v_equity")),
    "trade_metrics": (trade_query(lambda t: M.trade_metrics(t, "strategy"), ["strategy"]), V.oracle(f"WITH {RR} SELECT strategy, {TRADE_SQL} FROM rr GROUP BY strategy", "v_trades")),
    "metrics_by_regime": (trade_query(lambda t: M.metrics_by_direction(t, F.col("entry_regime")), ["side", "grp"]), V.oracle(f"""WITH {RR}, u AS (SELECT *, unnest(['both', dir]) AS side FROM rr), v AS (SELECT *, unnest([CAST(entry_regime AS VARCHAR), 'all']) AS grp FROM u)
        SELECT side, grp, {TRADE_SQL} FROM v GROUP BY side, grp""", "v_trades")),
    "metrics_by_weekday": (trade_query(lambda t: M.metrics_by_direction(t, F.weekday("entry_time")), ["side", "grp"]), V.oracle(f"""WITH {RR}, u AS (SELECT *, unnest(['both', dir]) AS side FROM rr), v AS (SELECT *, unnest([CAST((isodow(entry_time) - 1) AS VARCHAR), 'all']) AS grp FROM u)
        SELECT side, grp, {TRADE_SQL} FROM v GROUP BY side, grp""", "v_trades")),
    "binned_indicator": (binned, V.oracle(f"WITH {RR}, z AS (SELECT *, CAST(floor(entry_indicator / 10) AS INT) AS zone FROM rr WHERE entry_indicator >= 0 AND entry_indicator < 50) SELECT zone, {TRADE_SQL} FROM z GROUP BY zone", "v_trades")),
    "nth_trade": (trade_query(lambda t: M.nth_trade_of_day(t, "strategy", ORDER), ["nth"]), V.oracle(f"WITH {RR}, z AS (SELECT *, row_number() OVER (PARTITION BY strategy, CAST(entry_time AS DATE) ORDER BY {ORDER_SQL}) AS nth FROM rr) SELECT CAST(nth AS INT) AS nth, {TRADE_SQL} FROM z GROUP BY nth", "v_trades")),
    "losing_streaks": (on_trades(lambda t: M.losing_streaks(t, "strategy", ORDER), ["strategy"], ["longest", "mean", "median", "p75", "p95"]),
        V.oracle(f"""WITH a AS (SELECT strategy, CAST(pnl < 0 AS INT) AS lost, row_number() OVER w - sum(CAST(pnl < 0 AS INT)) OVER (PARTITION BY strategy ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS island FROM v_trades WINDOW w AS (PARTITION BY strategy ORDER BY {ORDER_SQL})),
        b AS (SELECT strategy, count(*) AS n FROM a WHERE lost = 1 GROUP BY strategy, island)
        SELECT strategy, {r('max(n)', 'longest')}, {r('avg(n)', 'mean')}, {r('median(n)', 'median')}, {r('quantile_cont(n, 0.75)', 'p75')}, {r('quantile_cont(n, 0.95)', 'p95')} FROM b GROUP BY strategy""", "v_trades")),
    "aggregate_trades": (on_trades(lambda t: M.aggregate_trades(t, "strategy"), ["strategy", "entry_bar"], ["size", "entry_price", "exit_price", "pnl", "commission", "return_pct"], 7),
        V.oracle(f"""SELECT strategy, entry_bar, {r('sum(size)', 'size', 7)}, {r('sum(abs(size) * entry_price) / sum(abs(size))', 'entry_price', 7)}, {r('sum(abs(size) * exit_price) / sum(abs(size))', 'exit_price', 7)}, {r('sum(pnl)', 'pnl', 7)},
        {r('sum(commission)', 'commission', 7)}, {r('sum(pnl) / nullif(sum(abs(size) * entry_price), 0)', 'return_pct', 7)} FROM v_trades GROUP BY 1, 2""", "v_trades")),
    "aggregate_trades_net": (on_trades(lambda t: M.aggregate_trades(t, "strategy", net=True), ["strategy", "entry_bar"], ["return_pct"], 4),
        V.oracle(f"SELECT strategy, entry_bar, {r('sum(pnl) / nullif(abs(sum(size)) * (sum(abs(size) * entry_price) / sum(abs(size))), 0)', 'return_pct', 4)} FROM v_trades GROUP BY 1, 2", "v_trades")),
    "risk_reward": (on_trades(lambda t: M.risk_reward(t).groupBy("strategy", "entry_bar").agg(F.sum("potential_risk").alias("potential_risk"), F.sum("realized_reward").alias("realized_reward"), F.sum("rr").alias("rr")), ["strategy", "entry_bar"], ["potential_risk", "realized_reward", "rr"], 7),
        V.oracle(f"WITH {RR} SELECT strategy, entry_bar, {r('sum(abs(entry_price - sl) * abs(size))', 'potential_risk', 7)}, {r('sum(pnl)', 'realized_reward', 7)}, {r('sum(rr)', 'rr', 7)} FROM rr GROUP BY 1, 2", "v_trades")),
    "trend_fit": (on_trades(lambda t: M.trend_fit(t, "strategy", ORDER), ["strategy"], ["total_rr", "r2"], 5),
        V.oracle(f"""WITH {RR}, a AS (SELECT strategy, row_number() OVER w AS n, sum(rr) OVER (PARTITION BY strategy ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS cum FROM rr WINDOW w AS (PARTITION BY strategy ORDER BY {ORDER_SQL}))
        SELECT strategy, {r('arg_max(cum, n)', 'total_rr', 5)}, {r('regr_r2(cum, n)', 'r2', 5)} FROM a GROUP BY strategy""", "v_trades")),
    "ratio_matrix": (lambda s, d: M.ratio_matrix(V.trades(s, d), "strategy", ORDER).select("strategy", "row", F.size("rr").alias("n"), F.round(F.aggregate("rr", F.lit(0.0), lambda a, b: a + b), 4).alias("total")),
        V.oracle(f"WITH {RR}, a AS (SELECT strategy, (row_number() OVER (PARTITION BY strategy ORDER BY {ORDER_SQL}) - 1) // 100 AS row, rr FROM rr) SELECT strategy, row, CAST(count(*) AS INT) AS n, round(sum(rr), 4) AS total FROM a GROUP BY 1, 2", "v_trades")),
}

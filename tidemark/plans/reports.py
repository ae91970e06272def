"""Registered queries of reports, risk models in portfolios, the allocator, and scorecards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import learning as L
from tidemark.operators import metrics as M
from tidemark.operators import portfolio as PF
from tidemark.operators import regimes as G
from tidemark.operators import reports as RP
from tidemark.operators import resample as R
from tidemark.operators import risk as RK
from tidemark.operators import search as SE
from tidemark.operators import splits as SP
from tidemark.plans.research import DAY, ORDER, ORDER_SQL, REGIME, RR, cross_sql, daily_returns, labelled, r, replayed, rnd
from tidemark.sources import views as V

ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
COLUMNS = [a.split("-")[1].lower().replace(" ", "_") for a in ASSETS]


def wide_query(source, value, digits):
    def query(spark, sf_dir):
        df = RP.wide(source(spark, sf_dir), "ts", "asset", value, ASSETS)
        return df.select(V.epoch(), *(F.round(F.col(f"`{a}`"), digits).alias(n) for a, n in zip(ASSETS, COLUMNS, strict=True)))

    return query


def wide_sql(view, value, digits, *needs):
    columns = ", ".join(f"round(max(CASE WHEN asset = '{a}' THEN {value} END), {digits}) AS {n}" for a, n in zip(ASSETS, COLUMNS, strict=True))
    return V.oracle(f"SELECT CAST(epoch(ts) AS BIGINT) AS ts, {columns} FROM {view} GROUP BY ts", *needs)


def curve_points(spark, sf_dir):
    points = RP.interpolate(RP.interest_points(V.equity(spark, sf_dir), "asset", "equity"), "asset", "equity")
    return points.select("asset", V.epoch(), "kept", F.round("line", 4).alias("line"))


CURVE = """WITH a AS (SELECT asset, ts, equity, row_number() OVER o AS n, count(*) OVER (PARTITION BY asset) AS al, max(equity) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk,
 max(equity) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS hi, min(equity) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS lo
 FROM v_equity WINDOW o AS (PARTITION BY asset ORDER BY ts)),
 d AS (SELECT asset, arg_max(n, 1 - equity / pk) AS low FROM (SELECT * FROM a ORDER BY asset, n) GROUP BY asset), t AS (SELECT a.asset, any_value(low) AS low, max(n) FILTER (n <= low AND equity = pk) AS top FROM a JOIN d ON a.asset = d.asset GROUP BY a.asset),
 k AS (SELECT a.*, n = 1 OR n = al OR n = low OR n = top OR equity = hi OR equity = lo AS kept FROM a JOIN t ON a.asset = t.asset),
 p AS (SELECT *, last_value(CASE WHEN kept THEN n END IGNORE NULLS) OVER b AS n0, last_value(CASE WHEN kept THEN equity END IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN kept THEN n END IGNORE NULLS) OVER f AS n1, first_value(CASE WHEN kept THEN equity END IGNORE NULLS) OVER f AS v1 FROM k
  WINDOW b AS (PARTITION BY asset ORDER BY n ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY asset ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT asset, CAST(epoch(ts) AS BIGINT) AS ts, kept, round(v0 + coalesce((n - n0) / nullif(n1 - n0, 0), 0) * (v1 - v0), 4) AS line FROM p"""


def month_rates(spark, sf_dir):
    g = V.trades(spark, sf_dir).groupBy("strategy").agg((F.sum("return_pct") / 10).alias("total"), F.count_distinct(F.date_trunc("MONTH", "entry_time")).cast("double").alias("months"))
    return rnd(g.withColumn("monthly", RP.monthly_return(F.col("total"), F.col("months"))), ["strategy"], ["total", "months", "monthly"], 8)


def card(spark, sf_dir):
    f = V.folds(spark, sf_dir)
    w = Window.partitionBy("param_id").orderBy("fold")
    metrics = ["sharpe", "mean_ret", "sd_ret", "n"]
    pairs = f.withColumns({f"is_{m}": F.lag(m).over(w) for m in metrics}).where("is_n is not null")
    return rnd(RP.scorecard(pairs, metrics, "param_id"), ["param_id", "metric"], ["folds", "inside", "outside", "held", "efficiency"])


CARD = f"""WITH p AS (SELECT param_id, fold, {', '.join(f'{m}, lag({m}) OVER w AS is_{m}' for m in ('sharpe', 'mean_ret', 'sd_ret', 'n'))} FROM v_folds WINDOW w AS (PARTITION BY param_id ORDER BY fold)),
 l AS ({' UNION ALL '.join(f"SELECT param_id, '{m}' AS metric, is_{m}::DOUBLE AS a, {m}::DOUBLE AS b FROM p WHERE is_n IS NOT NULL" for m in ('sharpe', 'mean_ret', 'sd_ret', 'n'))})
 SELECT param_id, metric, {r('count(*)', 'folds')}, {r('avg(a)', 'inside')}, {r('avg(b)', 'outside')}, {r('avg(CAST(b > 0 AS DOUBLE))', 'held')}, {r('avg(b) / nullif(avg(a), 0)', 'efficiency')} FROM l GROUP BY 1, 2"""


def paths(spark, sf_dir):
    return rnd(RP.path_scores(V.folds(spark, sf_dir), "fold", "sharpe"), ["fold"], ["median", "n", "place"])


STATS = ["n", "mean", "median", "sd", "var", "low", "high", "p01", "p05", "p10", "p25", "p75", "p90", "p95", "p99", "positive", "range", "iqr", "se"]


def statistics(spark, sf_dir):
    return rnd(RP.path_statistics(V.folds(spark, sf_dir), "fold", "sharpe"), ["fold"], STATS)


STATS_SQL = {
    "n": "count(*)", "mean": "avg(sharpe)", "median": "median(sharpe)", "sd": "stddev_samp(sharpe)", "var": "var_samp(sharpe)", "low": "min(sharpe)", "high": "max(sharpe)",
    **{f"p{q:02d}": f"quantile_cont(sharpe, {q / 100})" for q in (1, 5, 10, 25, 75, 90, 95, 99)}, "positive": "avg(CAST(sharpe > 0 AS DOUBLE))",
    "range": "max(sharpe) - min(sharpe)", "iqr": "quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25)", "se": "stddev_samp(sharpe) / sqrt(count(*))",
}


def numeric_trials(spark, sf_dir):
    t = V.trials(spark, sf_dir).withColumn("brand", F.regexp_extract("p_brand", r"(\d+)", 1))
    return RP.completed(t, ["p_size", "brand"])


TRIALS = "t AS (SELECT number, CAST(p_size AS DOUBLE) AS p_size, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS brand, CAST(score AS DOUBLE) AS score FROM v_trials WHERE state = 'COMPLETE')"


def trial_tiers(spark, sf_dir):
    return rnd(RP.quartile_tiers(numeric_trials(spark, sf_dir)).groupBy("tier").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("p_size").alias("p_size")), ["tier"], ["n", "score", "p_size"])


def trial_radar(spark, sf_dir):
    return rnd(RP.radar(numeric_trials(spark, sf_dir), ["p_size", "brand"]), ["parameter"], ["level", "focus", "agreement", "strength", "span"])


def radar_sql():
    parts = []
    for n in ("p_size", "brand"):
        edges = ", ".join(f"(SELECT quantile_cont({n}, {k}/6::DOUBLE) FROM t)" for k in range(1, 7))
        parts.append(f"""SELECT '{n}' AS parameter, (SELECT 1 / (1 + coalesce(abs(stddev_samp(m) / nullif(avg(m), 0)), 0)) FROM (SELECT avg(score) AS m FROM (SELECT *, CASE WHEN (SELECT count(DISTINCT {n}) FROM t) <= 6 THEN {n}
          ELSE list_min(list_filter([{edges}], lambda e: e >= {n})) END AS bin FROM t) GROUP BY bin)) AS level,
         (SELECT 1 / (1 + coalesce(abs(stddev_samp({n}) / nullif(avg({n}), 0)), 0)) FROM b) AS focus, (SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM b GROUP BY {n})) AS agreement,
         (SELECT abs(corr({n}, score)) FROM t) AS strength, (SELECT max({n}) - min({n}) FROM b) / (SELECT nullif(max({n}) - min({n}), 0) FROM t) AS span""")
    return V.oracle(f"WITH {TRIALS}, b AS (SELECT * FROM t WHERE score >= (SELECT quantile_cont(score, 0.9) FROM t)), u AS ({' UNION ALL '.join(parts)}) SELECT parameter, {', '.join(r(n, n) for n in ('level', 'focus', 'agreement', 'strength', 'span'))} FROM u", "v_trials")


def trial_importance(spark, sf_dir):
    return RP.tree_importance(numeric_trials(spark, sf_dir), ["p_size", "brand"])


def presets(spark, sf_dir):
    t = V.trades(spark, sf_dir).withColumn("move", F.col("return_pct") * 100)
    values = {"rsi": F.col("entry_indicator") * 2, "gap": F.col("move") / 5, "gap_sigma": F.col("move") / 3, "vix": F.col("entry_indicator")}
    out = None
    for name, value in values.items():
        g = t.withColumn("bin", RP.preset_bin(value, name)).groupBy(F.lit(name).alias("preset"), "bin").agg(F.count("*").alias("n"), F.avg("pnl").alias("pnl"))
        out = g if out is None else out.unionByName(g)
    return rnd(out, ["preset", "bin"], ["n", "pnl"], 4)


def presets_sql():
    values = {"rsi": "entry_indicator * 2", "gap": "return_pct * 100 / 5", "gap_sigma": "return_pct * 100 / 3", "vix": "entry_indicator"}
    parts = []
    for name, value in values.items():
        edges = RP.PRESETS[name]
        number = lambda x: f"'{'-' if x < 0 else ''}Infinity'::DOUBLE" if abs(x) == float("inf") else str(x)
        whens = " ".join(
            f"WHEN v >= {number(a)} AND v {'<=' if k == len(edges) - 2 else '<'} {number(b)} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        )
        parts.append(f"SELECT '{name}' AS preset, CAST(CASE {whens} END AS INT) AS bin, pnl FROM (SELECT CAST({value} AS DOUBLE) AS v, pnl FROM v_trades)")
    return V.oracle(f"WITH u AS ({' UNION ALL '.join(parts)}) SELECT preset, bin, {r('count(*)', 'n', 4)}, {r('avg(pnl)', 'pnl', 4)} FROM u GROUP BY 1, 2", "v_trades")


def range_bins(spark, sf_dir):
    bars = V.bars(spark, sf_dir).withColumn("width", F.col("high") - F.col("low"))
    return rnd(RP.percentile_bins(bars, "width").groupBy("bin").agg(F.count("*").alias("n"), F.avg("width").alias("width")), ["bin"], ["n", "width"])


HISTORY = 30


def with_history(spark, sf_dir):
    """State features of each strategy's later trades, from its earlier ones as history."""
    t = M.risk_reward(V.trades(spark, sf_dir))
    at = F.row_number().over(Window.partitionBy("strategy").orderBy(*ORDER))
    t = t.withColumn("_i", at)
    df = L.state_with_history(t.where(F.col("_i") > HISTORY), t.where(F.col("_i") <= HISTORY), "strategy", ORDER, (20,))
    return rnd(df.groupBy("strategy").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in L.state_columns((20,)))), ["strategy"], ["n", *L.state_columns((20,))], 5)


def per_path(spark, sf_dir):
    """State features of the trades of each CPCV path, from its own rows up to each only."""
    t = M.risk_reward(V.trades(spark, sf_dir))
    paths = t.withColumn("path", F.explode(F.array(*(F.lit(k) for k in range(3))))).where("l_linenumber % 3 <> path")
    df = L.state_per_path(paths, "path", "strategy", ORDER, (20,))
    return rnd(df.groupBy("path", "strategy").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in L.state_columns((20,)))), ["path", "strategy"], ["n", *L.state_columns((20,))], 5)


def path_auc(spark, sf_dir):
    """AUC of every feature on train and validation rows of five folds: mean and deviation over the folds."""
    return rnd(L.rank_features_by_path(V.features(spark, sf_dir), 5), ["feature", "role"], ["mean", "sd"])


def inverse_vol(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    dates = R.rebalance_dates(d, "YEAR").select("ts")
    out = None
    for model in ("sample", "pairwise", "ewma"):
        w = PF.weights_at(d, dates, strategies=("inverse_vol",), risk_model=model).withColumn("model", F.lit(model))
        out = w if out is None else out.unionByName(w)
    return rnd(out.withColumn("date", F.unix_timestamp("date")), ["date", "model", "asset"], ["weight"])


INVERSE = f"""WITH {DAY}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM d)), e AS (SELECT max(ts) AS date FROM d GROUP BY year(ts)),
 a AS (SELECT date, i AS pos FROM e JOIN t ON t.ts = e.date), x AS (SELECT date, i, asset, ret FROM a JOIN t ON t.i < pos AND t.i >= pos - 252 JOIN d ON d.ts = t.ts),
 n AS (SELECT date, count(DISTINCT i) AS n FROM x GROUP BY date), g AS (SELECT DISTINCT date, asset FROM x), h AS (SELECT DISTINCT date, i FROM x),
 j AS (SELECT date, i, row_number() OVER (PARTITION BY date ORDER BY i) - 1 AS k FROM h),
 f AS (SELECT j.date, j.k, n.n, g.asset, coalesce(x.ret, 0) AS z, x.ret AS raw FROM j JOIN n ON n.date = j.date JOIN g ON g.date = j.date LEFT JOIN x ON x.date = j.date AND x.i = j.i AND x.asset = g.asset),
 m AS (SELECT *, z - avg(z) OVER (PARTITION BY date, asset) AS y FROM f),
 v AS (SELECT date, asset, any_value(n) AS n, var_samp(z) AS sample, var_samp(raw) AS pairwise,
  greatest(sum(CASE WHEN k < n - 1 THEN 0.06 * pow(0.94::DOUBLE, n - 2 - k) ELSE 0 END * y * y) + pow(0.94::DOUBLE, any_value(n) - 1) * sum(y * y) / any_value(n), 1e-12) AS ewma FROM m GROUP BY date, asset),
 u AS (UNPIVOT (SELECT * FROM v) ON sample, pairwise, ewma INTO NAME model VALUE var)
 SELECT CAST(epoch(date) AS BIGINT) AS date, model, asset, {r("CASE WHEN n >= 60 THEN 1 / sqrt(var) / sum(1 / sqrt(var)) OVER (PARTITION BY date, model) ELSE 1 / count(*) OVER (PARTITION BY date, model) END", 'weight')} FROM u"""


def scheme_models(spark, sf_dir):
    """Weights of every scheme under the EWMA model, denoised as the shape of the window asks."""
    d = daily_returns(spark, sf_dir)
    w = PF.weights_at(d, R.rebalance_dates(d, "YEAR").select("ts"), risk_model="ewma", denoising="auto")
    return rnd(w.withColumn("date", F.unix_timestamp("date")), ["date", "strategy", "asset"], ["weight"])


START = "1996-01-01"


def schedule(spark, sf_dir):
    return PF.allocate(daily_returns(spark, sf_dir), START).withColumn("date", F.unix_timestamp("date"))


def allocated(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    plan = PF.allocate(d, START).select("date", F.lit("allocated").alias("strategy"), "asset", "weight")
    return rnd(PF.backtest(PF.hold(d, plan)).withColumn("ts", F.unix_timestamp("ts")), ["strategy", "ts"], ["ret", "equity"])


def fractions(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    f = PF.fractions_at(d, R.rebalance_dates(d, "YEAR").select("ts"))
    return f.withColumn("date", F.unix_timestamp("date"))


def sweep(spark, sf_dir):
    t = V.trades(spark, sf_dir).withColumn("p", F.round(F.col("entry_indicator") / 50, 6))
    return rnd(RP.gate_sweep(t, "p", [0.2, 0.4, 0.6, 0.8], "pnl", "strategy"), ["strategy", "gate"], ["n", "win_rate", "mean", "total"], 4)


def combined(spark, sf_dir):
    f = V.folds(spark, sf_dir).where("sharpe is not null")
    p = f.withColumn("p", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("sharpe"), "param_id")) / (F.count("*").over(Window.partitionBy("fold")) + 1))
    return rnd(RP.combined_p_values(p, "p", "param_id"), ["param_id"], ["n", "fisher", "pearson", "fisher_p", "pearson_p"])


def normalised(spark, sf_dir):
    m = SE.path_metrics(V.folds(spark, sf_dir))
    out = m.withColumns({
        "place": RP.minmax(F.col("median")), "calm": RP.minmax(F.col("sd"), inverted=True), "blend": RP.blended(F.col("median"), F.col("p25"), F.col("mean")),
        "penalty": RP.soft_penalty(F.col("median"), -0.5, 0.25),
    })
    return rnd(out, ["param_id"], ["place", "calm", "blend", "penalty"])


def gaps(spark, sf_dir):
    d = daily_returns(spark, sf_dir).withColumn("x", F.when(F.dayofmonth("ts") % 3 == 0, F.lit(None)).otherwise(F.col("ret")))
    return rnd(RP.filled(d, ["x"], "asset", "ts").withColumn("ts", F.unix_timestamp("ts")), ["asset", "ts"], ["x"], 12)


def regime_checks(spark, sf_dir):
    return rnd(G.validate(labelled(spark, sf_dir)), ["symbol", "regime"], ["share", "entries", "mean_stay"])


def pc_loadings(spark, sf_dir):
    """The ten features that load most on each component of the features' correlation."""
    corr = RK.vector_correlation(V.read(spark, sf_dir, "embeddings").select("embedding"), "embedding")
    return RK.component_loadings(corr, 10)


def cleaned(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    return rnd(RK.clean_returns(d).withColumn("ts", F.unix_timestamp("ts")), ["ts", "asset"], ["ret"], 12)


def sessions(spark, sf_dir):
    return rnd(RP.session_heatmap(V.trades(spark, sf_dir), "entry_time", "pnl"), ["weekday", "month"], ["n", "mean", "smooth"], 4)


def referenced(spark, sf_dir):
    m = SE.path_metrics(V.folds(spark, sf_dir))
    ranked = m.select("param_id", "median", F.row_number().over(Window.orderBy(F.desc("median"), "param_id")).alias("rank"))
    whole = V.trades(spark, sf_dir).groupBy(F.col("strategy").alias("param_id")).agg(F.try_divide(F.avg("return_pct"), F.stddev_samp("return_pct")).alias("sharpe"))
    return rnd(RP.with_reference(ranked, whole, "param_id", "sharpe", 20), ["param_id", "rank"], ["median", "reference"])


SCHEDULE = {"slow": "YEAR", "middle": "QUARTER", "fast": "MONTH"}


def union_schedule(spark, sf_dir):
    found = R.rebalance_schedule(daily_returns(spark, sf_dir), SCHEDULE)
    return found.select(V.epoch(), F.array_join("strategies", ",").alias("strategies"))


def latest(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    last = SP.MonthWalkForward(in_months=10, out_months=3).latest_train(d)
    return rnd(last.groupBy("asset").agg(F.count("*").alias("n"), F.sum("ret").alias("total")), ["asset"], ["n", "total"])


def held_out_paths(spark, sf_dir):
    df = SP.CombinatorialPurged(seed=None, paths=3).split_with_holdout(daily_returns(spark, sf_dir), 0.2)
    return rnd(df.groupBy("path", "fold", "role").agg(F.count("*").alias("n"), F.sum("ret").alias("total")), ["path", "fold", "role"], ["n", "total"])


def versus_hold(spark, sf_dir):
    bars = V.bars(spark, sf_dir)
    one = lambda text: spark.createDataFrame([(0, text)], "param_id int, params string")
    rule, hold = SE.run_grid(bars, one('{"fast": 3, "slow": 13}'), SE.moving_cross), SE.run_grid(bars, one("{}"), SE.buy_and_hold)
    return rnd(SE.versus(rule, hold), ["symbol"], [*SE.SCORES, *(f"base_{k}" for k in SE.SCORES), "sharpe_gain", "total_return_gain", "max_drawdown_gain"], 5)


def equal_risk(spark, sf_dir):
    w = PF.equal_risk(daily_returns(spark, sf_dir), 20)
    return rnd(w.withColumn("ts", F.unix_timestamp("ts")), ["ts", "asset"], ["weight"], 7)


def cluster_cohesion(spark, sf_dir):
    corr = RK.vector_correlation(V.read(spark, sf_dir, "embeddings").select("embedding"), "embedding")
    clusters = spark.range(64).select(F.col("id").cast("int").alias("feature"), (F.col("id") % 7).cast("int").alias("cluster"))
    return rnd(RK.cohesion(corr, clusters), ["cluster"], ["n", "cohesion", "weight"])


def bets(spark, sf_dir):
    t = V.trades(spark, sf_dir).withColumn("p", F.round(F.col("entry_indicator") / 50, 6))
    g = L.gate_and_bet(t, "p", 0.6).groupBy("strategy").agg(F.sum("gate_col").alias("taken"), F.sum("bet_col").alias("stake"), F.sum(F.col("bet_col") * F.col("pnl")).alias("pnl"))
    return rnd(g, ["strategy"], ["taken", "stake", "pnl"], 4)


QUERIES = {
    "clean_returns": (cleaned, V.oracle(f"""WITH {DAY}, g AS (SELECT t.ts, a.asset, d.ret FROM (SELECT DISTINCT ts FROM d) t CROSS JOIN (SELECT DISTINCT asset FROM d) a LEFT JOIN d ON d.ts = t.ts AND d.asset = a.asset),
        w AS (SELECT ts, count(ret) = count(*) AS w FROM g GROUP BY ts), k AS (SELECT sum(w::INT) >= greatest(20, 0.5 * count(*)) AS enough FROM w)
        SELECT CAST(epoch(g.ts) AS BIGINT) AS ts, asset, {r('coalesce(ret, 0)', 'ret', 12)} FROM g JOIN w ON w.ts = g.ts, k WHERE w OR NOT enough""", "v_returns")),
    "session_heatmap": (sessions, V.oracle(f"""WITH g AS (SELECT isodow(entry_time) - 1 AS d, month(entry_time) AS m, count(*) AS n, avg(pnl) AS v FROM v_trades GROUP BY 1, 2)
        SELECT CAST(a.d AS INT) AS weekday, CAST(a.m AS INT) AS month, {r('any_value(a.n)', 'n', 4)}, {r('any_value(a.v)', 'mean', 4)}, {r('avg(b.v)', 'smooth', 4)} FROM g a JOIN g b ON abs(a.d - b.d) <= 1 AND abs(a.m - b.m) <= 1 GROUP BY a.d, a.m""", "v_trades")),
    "reference_scores": (referenced, V.oracle(f"""WITH m AS (SELECT param_id, median(sharpe) AS median FROM v_folds WHERE sharpe IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY median DESC, param_id) AS rank FROM m),
        w AS (SELECT strategy, avg(return_pct) / nullif(stddev_samp(return_pct), 0) AS s FROM v_trades GROUP BY 1) SELECT param_id, CAST(rank AS INT) AS rank, {r('median', 'median')}, {r('CASE WHEN rank <= 20 THEN s END', 'reference')} FROM k LEFT JOIN w ON strategy = param_id""", "v_folds")),
    "rebalance_schedule": (union_schedule, V.oracle(f"""WITH {DAY}, u AS ({' UNION '.join(f"SELECT max(ts) AS ts, '{k}' AS s FROM d GROUP BY date_trunc('{v.lower()}', ts)" for k, v in SCHEDULE.items())})
        SELECT CAST(epoch(ts) AS BIGINT) AS ts, string_agg(s, ',' ORDER BY s) AS strategies FROM u GROUP BY ts""", "v_returns")),
    "latest_train": (latest, V.oracle(f"WITH {DAY}, m AS (SELECT *, year(ts) * 12 + month(ts) AS m FROM d) SELECT asset, {r('count(*)', 'n')}, {r('sum(ret)', 'total')} FROM m WHERE m > (SELECT max(m) FROM m) - 10 GROUP BY asset", "v_returns")),
    "cpcv_with_holdout": (held_out_paths, V.oracle(f"""WITH {DAY}, k AS (SELECT ts, sum(count(*)) OVER (ORDER BY ts) AS upto FROM d GROUP BY ts), z AS (SELECT max(ts) AS c FROM k WHERE upto <= 0.8::DOUBLE * (SELECT count(*) FROM d)), v AS (SELECT d.* FROM d, z WHERE ts <= c),
        e AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM v), g AS (SELECT k AS g, a + to_months(CAST(6 * k AS INT)) AS s, a + to_months(CAST(6 * k + 6 AS INT)) AS t FROM e, range(1000) u(k) WHERE a + to_months(CAST(6 * k + 6 AS INT)) <= z),
        p AS (SELECT x.g AS g0, y.g AS g1, row_number() OVER (ORDER BY x.g, y.g) - 1 AS path FROM g x JOIN g y ON x.g < y.g QUALIFY row_number() OVER (ORDER BY x.g, y.g) <= 3),
        f AS (SELECT path, 0 AS fold, g0 AS g, g1 AS o FROM p UNION ALL SELECT path, 1, g1, g0 FROM p), t AS (SELECT path, fold, s, t, s - to_days(CASE WHEN o = f.g - 1 THEN 0 ELSE 5 END) AS s5, t + to_days(CASE WHEN o = f.g + 1 THEN 0 ELSE 5 END) AS t5 FROM f JOIN g ON g.g = f.g),
        u AS (SELECT path, fold, 'test' AS role, ret FROM v JOIN t ON ts >= s AND ts < t UNION ALL SELECT path, -1, 'train', ret FROM v, (SELECT DISTINCT path FROM t) q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.path = q.path AND v.ts >= s5 AND v.ts < t5)
          UNION ALL SELECT -1, -1, 'holdout', ret FROM d, z WHERE ts > c)
        SELECT CAST(path AS INT) AS path, CAST(fold AS INT) AS fold, role, {r('count(*)', 'n')}, {r('sum(ret)', 'total')} FROM u GROUP BY 1, 2, 3""", "v_returns")),
    "versus_buy_and_hold": (versus_hold, V.oracle(f"""WITH src AS (SELECT symbol AS k, ts, open, close FROM v_bars), {replayed('src', [('rule', cross_sql(3, 13)), ('hold', '1')])}
        SELECT a.k AS symbol, {', '.join(r(f'a.{n}', n, 5) for n in SE.SCORES)}, {', '.join(r(f'b.{n}', f'base_{n}', 5) for n in SE.SCORES)}, {', '.join(r(f'a.{n} - b.{n}', f'{n}_gain', 5) for n in ('sharpe', 'total_return', 'max_drawdown'))}
        FROM scores a JOIN scores b ON a.k = b.k AND a.params = 'rule' AND b.params = 'hold'""", "v_bars")),
    "equal_risk_weights": (equal_risk, V.oracle(f"""WITH {DAY}, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS n FROM d),
        x AS (SELECT a.asset, a.ts, a.n, b.ret AS x, pow(0.94::DOUBLE, a.n - 1 - b.n) AS w FROM n a LEFT JOIN n b ON b.asset = a.asset AND b.n BETWEEN a.n - 20 AND a.n - 1),
        m AS (SELECT *, sum(w * x) OVER (PARTITION BY asset, n) / sum(w) OVER (PARTITION BY asset, n) AS m FROM x), v AS (SELECT asset, ts, count(x) AS k, sum(w * (x - m) * (x - m)) / sum(w) AS v FROM m GROUP BY asset, ts),
        i AS (SELECT *, CASE WHEN k >= 20 AND v > 0 THEN 1 / sqrt(v) END AS i FROM v)
        SELECT CAST(epoch(ts) AS BIGINT) AS ts, asset, {r('CASE WHEN count(i) OVER (PARTITION BY ts) = count(*) OVER (PARTITION BY ts) THEN i / sum(i) OVER (PARTITION BY ts) ELSE 1 / count(*) OVER (PARTITION BY ts) END', 'weight', 7)} FROM i""", "v_returns")),
    "cluster_cohesion": (cluster_cohesion, V.oracle(f"""WITH c AS (SELECT a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM v_features a JOIN v_features b ON a.id = b.id AND a.feature < b.feature WHERE a.feature % 7 = b.feature % 7 GROUP BY 1, 2),
        n AS (SELECT g AS cluster, count(*) AS n FROM (SELECT unnest(range(64)) % 7 AS g) GROUP BY g) SELECT CAST(cluster AS INT) AS cluster, {r('any_value(n)', 'n')}, {r('avg(c.r)', 'cohesion')}, {r('any_value(n * n) / (SELECT sum(n * n) FROM n)', 'weight')} FROM n JOIN c ON c.i % 7 = cluster GROUP BY cluster""", "v_features")),
    "gated_bets": (bets, V.oracle(f"""WITH t AS (SELECT strategy, pnl, round(entry_indicator / 50, 6) AS p FROM v_trades), b AS (SELECT *, greatest(least((p - 0.6::DOUBLE) / (1 - 0.6::DOUBLE), 1), 0) AS s FROM t)
        SELECT strategy, {r('sum(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END)', 'taken', 4)}, {r('sum(s)', 'stake', 4)}, {r('sum(s * pnl)', 'pnl', 4)} FROM b GROUP BY strategy""", "v_trades")),
    "wide_returns": (wide_query(daily_returns, "ret", 12), wide_sql("(SELECT asset, date_trunc('day', ts) AS ts, avg(ret) AS ret FROM v_returns GROUP BY 1, 2)", "ret", 12, "v_returns")),
    "wide_equity": (wide_query(V.equity, "equity", 4), wide_sql("v_equity", "equity", 4, "v_equity")),
    "curve_points": (curve_points, V.oracle(CURVE, "v_equity")),
    "monthly_rates": (month_rates, V.oracle(f"""WITH g AS (SELECT strategy, sum(return_pct) / 10 AS total, count(DISTINCT date_trunc('month', entry_time))::DOUBLE AS months FROM v_trades GROUP BY 1)
        SELECT strategy, {r('total', 'total', 8)}, {r('months', 'months', 8)}, {r('CASE WHEN total >= 0 THEN pow(1 + total, 1 / months) - 1 ELSE greatest(total / months, -1) END', 'monthly', 8)} FROM g""", "v_trades")),
    "walk_forward_scorecard": (card, V.oracle(CARD, "v_folds")),
    "path_scores": (paths, V.oracle(f"WITH g AS (SELECT fold, median(sharpe) AS m, count(*) AS n FROM v_folds WHERE sharpe IS NOT NULL GROUP BY fold) SELECT fold, {r('m', 'median')}, {r('n', 'n')}, {r('rank() OVER (ORDER BY m DESC, fold)', 'place')} FROM g", "v_folds")),
    "path_statistics": (statistics, V.oracle(f"SELECT fold, {', '.join(r(x, n) for n, x in STATS_SQL.items())} FROM v_folds WHERE sharpe IS NOT NULL GROUP BY fold", "v_folds")),
    "trial_tiers": (trial_tiers, V.oracle(f"""WITH {TRIALS}, q AS (SELECT quantile_cont(score, [0.25, 0.5, 0.75]) AS e FROM t), k AS (SELECT t.*, 1 + (score > e[1])::INT + (score > e[2])::INT + (score > e[3])::INT AS tier FROM t, q)
        SELECT tier, {r('count(*)', 'n')}, {r('avg(score)', 'score')}, {r('avg(p_size)', 'p_size')} FROM k GROUP BY tier""", "v_trials")),
    "trial_radar": (trial_radar, radar_sql()),
    "trial_importance": (trial_importance, None),
    "preset_bins": (presets, presets_sql()),
    "session_range_bins": (range_bins, V.oracle(f"""WITH b AS (SELECT high - low AS w FROM v_bars), e AS (SELECT quantile_cont(w, 0.1) AS lo, quantile_cont(w, 0.9) AS hi FROM b)
        SELECT CAST(greatest(least(floor((w - lo) / nullif(hi - lo, 0) * 15), 14), 0) AS INT) AS bin, {r('count(*)', 'n')}, {r('avg(w)', 'width')} FROM b, e GROUP BY 1""", "v_bars")),
    "state_features_history": (with_history, V.oracle(f"""WITH {RR}, w AS (SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY {ORDER_SQL}) AS i, CASE WHEN count(rr) OVER p >= 10 THEN avg(rr) OVER p END AS a, CASE WHEN count(rr) OVER p >= 10 THEN avg(CAST(rr > 0 AS DOUBLE)) OVER p END AS b
        FROM rr WINDOW p AS (PARTITION BY strategy ORDER BY {ORDER_SQL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        SELECT strategy, {r('count(*)', 'n', 5)}, {r('sum(coalesce(a, 0))', 'state_rr_20', 5)}, {r('sum(coalesce(b, 0.5))', 'state_winrate_20', 5)} FROM w WHERE i > {HISTORY} GROUP BY strategy""", "v_trades")),
    "state_features_paths": (per_path, V.oracle(f"""WITH {RR}, x AS (SELECT rr.*, path FROM rr, range(3) t(path) WHERE l_linenumber % 3 <> path), w AS (SELECT path, strategy, CASE WHEN count(rr) OVER p >= 10 THEN avg(rr) OVER p END AS a, CASE WHEN count(rr) OVER p >= 10 THEN avg(CAST(rr > 0 AS DOUBLE)) OVER p END AS b
        FROM x WINDOW p AS (PARTITION BY path, strategy ORDER BY {ORDER_SQL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        SELECT CAST(path AS INT) AS path, strategy, {r('count(*)', 'n', 5)}, {r('sum(coalesce(a, -1))', 'state_rr_20', 5)}, {r('sum(coalesce(b, -1))', 'state_winrate_20', 5)} FROM w GROUP BY 1, 2""", "v_trades")),
    "feature_path_auc": (path_auc, V.oracle(f"""WITH x AS (SELECT f.*, fold, CASE WHEN id % 5 = fold THEN 'validation' ELSE 'train' END AS role FROM v_features f, range(5) t(fold)),
        k AS (SELECT *, rank() OVER (PARTITION BY feature, fold, role ORDER BY value) + (count(*) OVER (PARTITION BY feature, fold, role, value) - 1) / 2 AS rk FROM x),
        a AS (SELECT feature, fold, role, (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM k GROUP BY 1, 2, 3)
        SELECT feature, role, {r('avg(auc)', 'mean')}, {r('stddev_samp(auc)', 'sd')} FROM a GROUP BY 1, 2""", "v_features")),
    "inverse_vol_models": (inverse_vol, V.oracle(INVERSE, "v_returns")),
    "scheme_weights_ewma": (scheme_models, None),
    "allocator_schedule": (schedule, None),
    "allocator_backtest": (allocated, None),
    "rolling_optimal_fraction": (fractions, None),
    "gate_sweep": (sweep, V.oracle(f"""WITH g AS (SELECT NULL::DOUBLE AS gate UNION ALL SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE)
        SELECT strategy, gate, {r('count(*)', 'n', 4)}, {r('avg(CAST(pnl > 0 AS DOUBLE))', 'win_rate', 4)}, {r('avg(pnl)', 'mean', 4)}, {r('sum(pnl)', 'total', 4)} FROM v_trades, g WHERE gate IS NULL OR round(entry_indicator / 50, 6) >= gate GROUP BY 1, 2""", "v_trades")),
    "combined_p_values": (combined, V.oracle(f"""WITH f AS (SELECT param_id, rank() OVER (PARTITION BY fold ORDER BY sharpe DESC, param_id) / (count(*) OVER (PARTITION BY fold) + 1) AS p FROM v_folds WHERE sharpe IS NOT NULL),
        g AS (SELECT param_id, count(*) AS n, -2 * sum(ln(p)) AS x, -2 * sum(ln(1 - p)) AS y FROM f GROUP BY 1)
        SELECT param_id, {r('n', 'n')}, {r('x', 'fisher')}, {r('y', 'pearson')}, {r("list_sum(list_transform(range(0, n), lambda i: exp(i * ln(x / 2) - lgamma(i + 1) - x / 2)))", 'fisher_p')}, {r("1 - list_sum(list_transform(range(0, n), lambda i: exp(i * ln(y / 2) - lgamma(i + 1) - y / 2)))", 'pearson_p')} FROM g""", "v_folds")),
    "normalised_scores": (normalised, V.oracle(f"""WITH m AS (SELECT param_id, avg(sharpe) AS mean, median(sharpe) AS median, quantile_cont(sharpe, 0.25) AS p25, stddev_samp(sharpe) AS sd FROM v_folds WHERE sharpe IS NOT NULL GROUP BY 1)
        SELECT param_id, {r('coalesce((median - min(median) OVER ()) / nullif(max(median) OVER () - min(median) OVER (), 0), 0.5)', 'place')}, {r('1 - coalesce((sd - min(sd) OVER ()) / nullif(max(sd) OVER () - min(sd) OVER (), 0), 0.5)', 'calm')},
        {r('0.6 * median + 0.4 * p25', 'blend')}, {r('exp(-greatest(0, -0.5 - median) / 0.25)', 'penalty')} FROM m""", "v_folds")),
    "filled_gaps": (gaps, V.oracle(f"""WITH {DAY}, x AS (SELECT asset, ts, CASE WHEN day(ts) % 3 = 0 THEN NULL ELSE ret END AS x FROM d)
        SELECT asset, CAST(epoch(ts) AS BIGINT) AS ts, {r('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT median(x) FROM x))', 'x', 12)} FROM x""", "v_returns")),
    "regime_validation": (regime_checks, V.oracle(f"""WITH {REGIME}, k AS (SELECT symbol, regime, CASE WHEN lag(regime) OVER w IS NULL OR lag(regime) OVER w <> regime THEN 1 ELSE 0 END AS s FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        n AS (SELECT symbol, regime, count(*) AS n, sum(s) AS e FROM k GROUP BY 1, 2) SELECT symbol, CAST(regime AS INT) AS regime, {r('n / sum(n) OVER (PARTITION BY symbol)', 'share')}, {r('e', 'entries')}, {r('n / e', 'mean_stay')} FROM n""", "v_bars")),
    "component_loadings": (pc_loadings, None),
}

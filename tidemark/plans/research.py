"""Registered queries of splits, risk, portfolios, simulation, learning, regimes, search and patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import boosting as BO
from tidemark.operators import ensembles as EN
from tidemark.operators import features as FT
from tidemark.operators import information as I
from tidemark.operators import learning as L
from tidemark.operators import matrices as MX
from tidemark.operators import metrics as M
from tidemark.operators import neighbours as NB
from tidemark.operators import patterns as P
from tidemark.operators import portfolio as PF
from tidemark.operators import reality as RC
from tidemark.operators import regimes as G
from tidemark.operators import resample as R
from tidemark.operators import risk as RK
from tidemark.operators import search as SE
from tidemark.operators import simulation as SI
from tidemark.operators import spectra as SX
from tidemark.operators import splits as SP
from tidemark.operators import studies as ST
from tidemark.operators import tuning as TU
from tidemark.operators import windows as W
from tidemark.plans.recursion import CONFIRMED
from tidemark.sources import views as V

ORDER = V.TRADE_ORDER
ORDER_SQL = ", ".join(ORDER)
RR = "rr AS (SELECT *, (size * (exit_price - entry_price) - commission) / nullif(abs(entry_price - sl) * abs(size), 0) AS rr FROM v_trades)"
FOLDS = SP.MonthWalkForward(in_months=10, out_months=3)


def rnd(df: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(n).cast("double"), digits).alias(n) for n in names))


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) AS {name}"


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.returns(spark, sf_dir).withColumn("ts", F.date_trunc("DAY", "ts")).groupBy("asset", "ts").agg(F.avg("ret").alias("ret"))


# splits


def three_way(spark, sf_dir):
    df = V.returns(spark, sf_dir).withColumn("part", SP.three_way("1998-01-01", "2000-01-01"))
    return rnd(df.groupBy("asset", "part").agg(F.count("*").alias("n"), F.sum("ret").alias("total")), ["asset", "part"], ["n", "total"])


def walk_forward_split(spark, sf_dir):
    df = FOLDS.split(V.returns(spark, sf_dir))
    return rnd(df.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("ret").alias("total")), ["fold", "role"], ["n", "total"])


def cpcv_split(spark, sf_dir):
    df = SP.CombinatorialPurged(seed=None, paths=6).split(V.returns(spark, sf_dir))
    return rnd(df.groupBy("path", "fold", "role").agg(F.count("*").alias("n"), F.sum("ret").alias("total")), ["path", "fold", "role"], ["n", "total"])


def merged(spark, sf_dir):
    t = V.read(spark, sf_dir, "orders").select("o_orderpriority", F.unix_timestamp("o_orderdate").alias("start"), (F.unix_timestamp("o_orderdate") + 86400 * (F.col("o_custkey") % 3)).alias("end"))
    return SP.merge_intervals(t, "o_orderpriority")


def holdout(spark, sf_dir):
    df = SP.holdout(V.returns(spark, sf_dir), 0.2, "asset")
    return df.groupBy("asset", "role").agg(F.count("*").alias("n"), F.max(F.unix_timestamp("ts")).alias("last"))


def bounds(spark, sf_dir):
    return SP.entry_time_bounds(V.trades(spark, sf_dir), "strategy", ORDER).select("strategy", V.epoch("train_end"), V.epoch("val_end"))


# risk


def cov_query(work, digits=12):
    def query(spark, sf_dir):
        return rnd(work(daily_returns(spark, sf_dir)), ["asset_i", "asset_j"], ["cov"], digits)

    return query


def dense(work):
    """A query of dense work on the covariance matrix."""

    def query(spark, sf_dir):
        names, m = RK.matrix(RK.sample_covariance(daily_returns(spark, sf_dir)))
        return rnd(RK.long(spark, names, work(m)), ["asset_i", "asset_j"], ["cov"], 12)

    return query


def eigen(spark, sf_dir):
    return RK.rolling_top_eigenvalue(daily_returns(spark, sf_dir), 60).withColumn("day", F.unix_timestamp(F.col("day").cast("timestamp")))


def vectors(spark, sf_dir):
    return V.read(spark, sf_dir, "embeddings").select("embedding")


def feature_correlation(spark, sf_dir):
    return rnd(RK.vector_correlation(vectors(spark, sf_dir), "embedding"), ["i", "j"], ["corr"], 6)


def correlation_matrix(spark, sf_dir):
    corr = RK.vector_correlation(vectors(spark, sf_dir), "embedding")
    return RK.matrix(corr.select(F.col("i").alias("asset_i"), F.col("j").alias("asset_j"), F.col("corr").alias("cov")))


def pca_spectrum(spark, sf_dir):
    """Eigenvalues of the features' correlation: an aggregate over all rows, a small matrix here."""
    names, m = correlation_matrix(spark, sf_dir)
    import numpy as np

    values = np.linalg.eigvalsh(m)[::-1]
    edge = float((1 + (len(names) / max(V.read(spark, sf_dir, "embeddings").count(), 1)) ** 0.5) ** 2)
    rows = [(k + 1, float(v), float(v / values.sum()), bool(v > edge)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "component int, eigenvalue double, share double, above_noise boolean")


def onc_clusters(spark, sf_dir):
    names, m = correlation_matrix(spark, sf_dir)
    return spark.createDataFrame([(int(names[i]), k, s) for i, k, s in RK.feature_silhouettes(m)], "feature int, cluster int, silhouette double")


# information


def neighbour_information(spark, sf_dir):
    return rnd(NB.neighbour_information(V.features(spark, sf_dir).select("id", "feature", "value")), ["i", "j", "n"], ["mi"])


def asset_features(spark, sf_dir):
    return V.returns(spark, sf_dir).select(F.unix_timestamp("ts").alias("id"), F.col("asset").alias("feature"), F.col("ret").alias("value"))


def neighbour_pairs(spark, sf_dir):
    return rnd(NB.neighbour_information(asset_features(spark, sf_dir), cell_rows=200), ["i", "j", "n"], ["mi"])


#: Psi of whole numbers, as a sum.
HARMONIC = "h AS (SELECT m AS n, sum(CASE WHEN m > 1 THEN 1 / (m - 1)::DOUBLE ELSE 0 END) OVER (ORDER BY m) - 0.5772156649015329::DOUBLE AS psi FROM range(1, (SELECT count(*) + 2 FROM v_returns)) t(m))"
NEIGHBOURS = f"""WITH {HARMONIC}, z AS (SELECT ts, asset, ret / stddev_pop(ret) OVER (PARTITION BY asset) AS v FROM v_returns),
 p AS (SELECT a.asset AS i, b.asset AS j, ts, a.v AS x, b.v AS y FROM z a JOIN z b USING (ts) WHERE a.asset < b.asset), k AS (SELECT i, j, count(*) AS n FROM p GROUP BY i, j HAVING count(*) > 3),
 d AS (SELECT a.i, a.j, a.ts, a.x, a.y, list_sort(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3))[3] AS e FROM p a JOIN p b ON a.i = b.i AND a.j = b.j AND a.ts <> b.ts GROUP BY ALL),
 c AS (SELECT d.i, d.j, d.ts, count(*) FILTER (abs(d.x - p.x) < e) AS nx, count(*) FILTER (abs(d.y - p.y) < e) AS ny FROM d JOIN p ON p.i = d.i AND p.j = d.j GROUP BY ALL)
 SELECT i, j, k.n AS n, round(greatest(avg(1.5 - 0.5772156649015329::DOUBLE + hn.psi - hx.psi - hy.psi), 0), 6) AS mi FROM c JOIN k USING (i, j) JOIN h hx ON hx.n = nx JOIN h hy ON hy.n = ny JOIN h hn ON hn.n = k.n GROUP BY i, j, k.n"""


def mutual(spark, sf_dir):
    return rnd(I.vector_information(vectors(spark, sf_dir), "embedding"), ["i", "j"], ["mi", "nmi", "corr"], 6)


def gauss(spark, sf_dir):
    return rnd(I.rank_gaussian(V.features(spark, sf_dir), "value", "feature"), ["id", "feature"], ["gauss"], 5)


def rank_share(spark, sf_dir):
    return rnd(V.features(spark, sf_dir).withColumn("share", I.rank_share("value", "feature")), ["id", "feature"], ["share"], 6)


def rolling_pairs(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    names = d.select("asset").distinct()
    pairs = names.select(F.col("asset").alias("a")).crossJoin(names.select(F.col("asset").alias("b"))).where("a < b")
    return I.rolling_pairs(d, pairs, 252, 60).withColumn("ts", F.unix_timestamp("ts"))


# portfolio


def weights(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    return PF.weights_at(d, R.rebalance_dates(d, "YEAR").select("ts")).withColumn("date", F.unix_timestamp("date"))


def portfolio_backtest(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    held = PF.hold(d, PF.weights_at(d, R.rebalance_dates(d, "YEAR").select("ts"), strategies=("equal", "inverse_vol", "minimum_variance", "hrp")))
    return rnd(PF.backtest(held).withColumn("ts", F.unix_timestamp("ts")), ["strategy", "ts"], ["ret", "equity"], 6)


def ruled_backtest(spark, sf_dir):
    d = daily_returns(spark, sf_dir).select(F.col("asset").alias("strategy"), "ts", "ret")
    return rnd(PF.backtest(d, rules=PF.RiskRules()).withColumn("ts", F.unix_timestamp("ts")), ["strategy", "ts"], ["ret", "equity", "exposure"], 5)


def equal_hold(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    dates = R.rebalance_dates(d, "YEAR").select(F.col("ts").alias("date"))
    w = dates.crossJoin(d.select("asset").distinct()).withColumns({"strategy": F.lit("equal"), "weight": F.lit(0.2)})
    held = PF.backtest(PF.hold(d, w), 100000.0)
    return rnd(held.withColumn("ts", F.unix_timestamp("ts")), ["strategy", "ts"], ["ret", "equity"], 6)


def scales(spark, sf_dir):
    return rnd(PF.scale_factors(daily_returns(spark, sf_dir)).withColumn("ts", F.unix_timestamp("ts")), ["asset", "ts"], ["scale"], 6)


# simulation


#: The reference's defaults; permutations come in batches of ``PER_BATCH``.
SIMULATED_PATHS, PERMUTATIONS, PER_BATCH = 2000, 200, 5


def monte_carlo(method):
    def query(spark, sf_dir):
        d = daily_returns(spark, sf_dir)
        return SI.summarise(SI.monte_carlo(d, "asset", "ret", ["ts"], method, paths=SIMULATED_PATHS, batch=50), "asset", SI.real_path(d, "asset", "ret", ["ts"]))

    return query


def tail_var(spark, sf_dir):
    import pandas as pd

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][["asset"]].assign(evt_var=SI.tail_value(-pdf["ret"].to_numpy()), block=SI.optimal_block(pdf.sort_values("ts")["ret"].to_numpy()))

    return daily_returns(spark, sf_dir).groupBy("asset").applyInPandas(work, "asset string, evt_var double, block double")


def permutation(spark, sf_dir):
    """P-value of the moving-average rule per symbol against permuted bars, a task per batch of permutations."""
    import numpy as np
    import pandas as pd

    fields = ("ts", "open", "high", "low", "close")
    # permuted bars are products of ratios: prices of nothing have none
    bars = V.bars(spark, sf_dir).where("low > 0")
    packed = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("bars"))
    dealt = packed.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(PERMUTATIONS // PER_BATCH - 1)))).repartition("symbol", "batch")

    def work(batches):
        for pdf in batches:
            out = []
            for symbol, rows, batch in zip(pdf["symbol"], pdf["bars"], pdf["batch"], strict=True):
                b = {k: np.array([x[k] for x in rows], dtype=np.float64) for k in fields[1:]}
                days = np.array([x["ts"].toordinal() for x in rows])
                real = SE.score(*SE.replay(b, SE.moving_cross(b, {"fast": 5, "slow": 20})))["sharpe"]
                for k in range(PER_BATCH):
                    p = SI.permute_bars(b, days, np.random.default_rng([11, batch, k]))
                    got = SE.score(*SE.replay(p, SE.moving_cross(p, {"fast": 5, "slow": 20})))["sharpe"]
                    out.append((symbol, real, int(got >= real)))
            yield pd.DataFrame(out, columns=["symbol", "real", "beaten"])

    g = dealt.mapInPandas(work, "symbol string, real double, beaten int").groupBy("symbol")
    return g.agg(F.max("real").alias("real"), F.count("*").alias("n"), ((F.sum("beaten") + 1) / (F.count("*") + 1)).alias("p_value"))


# learning


def state(spark, sf_dir):
    df = L.state_features(M.risk_reward(V.trades(spark, sf_dir)), "strategy", ORDER, windows=(20, 50))
    g = df.groupBy("strategy").agg(*(F.sum(n).alias(n) for n in L.state_columns((20, 50))))
    return rnd(g, ["strategy"], L.state_columns((20, 50)), 5)


def probabilities(spark, sf_dir) -> DataFrame:
    return V.features(spark, sf_dir).withColumn("p", F.round(1 / (1 + F.exp(-F.col("value"))), 6))


def auc(spark, sf_dir):
    return rnd(L.auc(probabilities(spark, sf_dir), "p", "label", "feature"), ["feature"], ["auc"])


def classifier_metrics(spark, sf_dir):
    names = ["n", "log_loss", "brier", "accuracy", "precision", "recall", "f1"]
    return rnd(L.evaluate(probabilities(spark, sf_dir), "p", "label", "feature"), ["feature"], names)


def best_threshold(spark, sf_dir):
    return rnd(L.best_threshold(probabilities(spark, sf_dir), "p", "label", "feature"), ["feature"], ["threshold", "value"])


PROB = "p AS (SELECT id, feature, label, round(1 / (1 + exp(-value)), 6) AS p FROM v_features)"


def votes(spark, sf_dir):
    e = V.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return L.fold_votes(e, folds=4, repeats=3)


def calibrated(spark, sf_dir):
    return L.evaluate(L.calibrate(probabilities(spark, sf_dir), "p", "label"), "calibrated", "label", "feature")


def labels(spark, sf_dir):
    t = M.risk_reward(V.trades(spark, sf_dir))
    t = t.withColumns({"meta": S.meta_label(F.col("rr"), F.col("sl"), F.col("exit_price")), "meta_binary": S.meta_label_binary(F.col("realized_reward"))})
    return t.groupBy("strategy", "meta", "meta_binary").agg(F.count("*").alias("n"))


def boosted(spark, sf_dir, trees=10) -> tuple[DataFrame, BO.Boosted]:
    rows = V.vectors(spark, sf_dir)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    return rows, BO.boost(rows, width, trees=trees, patience=5)


def boosting_losses(spark, sf_dir):
    _, found = boosted(spark, sf_dir)
    return rnd(spark.createDataFrame(found.losses, "round int, part string, loss double"), ["round", "part"], ["loss"])


def boosting_metrics(spark, sf_dir):
    rows, found = boosted(spark, sf_dir)
    return rnd(BO.split_metrics(BO.predict(rows, found.forest)), ["part", "n", "positive", "negative"], ["accuracy", "precision", "recall", "f1", "log_loss"])


def permuted_importance(spark, sf_dir):
    rows, found = boosted(spark, sf_dir)
    return rnd(BO.permutation_importance(rows.where("part <> 'train'"), found.forest), ["group"], ["mean", "se"])


def purged(spark, sf_dir) -> DataFrame:
    rows = V.vectors(spark, sf_dir)
    return TU.purged_paths(rows.withColumn("t", F.col("id")), 4, embargo=5)


def tuned_trials(spark, sf_dir):
    _, found = TU.halving(purged(spark, sf_dir), TU.grid({"depth": [1, 3], "trees": [5, 15], "rate": [0.05, 0.3]}), gap=0.1)
    return rnd(found, ["trial", "params", "rung", "place"], ["objective", "mean", "sd", "overfit"])


def learning_curve(spark, sf_dir):
    found = TU.learning_curve(purged(spark, sf_dir), {"trees": 15, "rate": 0.1})
    return rnd(found, ["share"], ["rows", "train", "train_sd", "test", "test_sd"])


def rolling_spectrum(spark, sf_dir):
    found = SX.rolling_spectrum(daily_returns(spark, sf_dir), 60).withColumn("day", F.unix_timestamp(F.col("day").cast("timestamp")))
    return rnd(found, ["day", "component"], ["value", "share"])


def noise_spectrum(spark, sf_dir):
    names, r = correlation_matrix(spark, sf_dir)
    found = SX.noise_spectrum(r, vectors(spark, sf_dir).count())
    frame = spark.createDataFrame(found, "place int, value double, signal boolean, cleaned double, q double, variance double, edge double")
    return rnd(frame, ["place", "signal"], ["value", "cleaned", "q", "variance", "edge"])


def reality_check(spark, sf_dir):
    monthly = V.trades(spark, sf_dir).groupBy("strategy", F.date_trunc("month", "entry_time").alias("ts")).agg(F.avg("return_pct").alias("value"))
    return RC.reality_check(monthly)


def denoised_vectors(spark, sf_dir):
    rows = []
    for method in ("auto", "shrinkage", "nonlinear"):
        used, cov = SX.denoised_vectors(vectors(spark, sf_dir), "embedding", method)
        rows += [(method, used, i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return rnd(spark.createDataFrame(rows, "method string, used string, i int, j int, cov double"), ["method", "used", "i", "j"], ["cov"], 9)


def ensemble_diagnosis(spark, sf_dir):
    daily = daily_returns(spark, sf_dir)
    times = daily.select("ts").distinct().count()
    names, cov = RK.matrix(RK.sample_covariance(daily))
    sums = {r.asset: r.s for r in daily.groupBy("asset").agg(F.sum("ret").alias("s")).collect()}
    mean = np.array([sums[n] / times for n in names])
    rows = [(how, *r) for how in ("equal", "minvar", "hrp") for r in PF.diagnose_moments(mean, cov, how)]
    return rnd(spark.createDataFrame(rows, "how string, strategy string, share double, mean double, sd double, correlation double"), ["how", "strategy"], ["share", "mean", "sd", "correlation"], 9)


def perturbed_trials(spark, sf_dir):
    trials = V.trials(spark, sf_dir).select(F.col("number").alias("param_id"), "p_size", "p_brand", "score")
    brands = [f"Brand#{i}" for i in range(1, 26)]
    return SE.perturb_within(trials, {"p_size": (1, 50), "score": (0.0, 100.0), "p_brand": brands}, 3)


def selection_report(spark, sf_dir):
    rows = V.vectors(spark, sf_dir)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    _, found = BO.selection_report(rows, width, repeats=5, trees=8, patience=5)
    return rnd(found, ["cluster", "feature", "kept"], ["mean", "se", "silhouette", "gain"])


# matrices

REGIME_FRAMES = {"2h": 7200, "6h": 21600}
VOLATILITY = [*(f"atr_{n}" for n in (5, 14, 21, 40)), "rv_20", "rv_40", "vov_20", "vov_40"]


def meta_label_matrix(spark, sf_dir):
    found = MX.meta_label_matrix(V.bars(spark, sf_dir), 0, 7200, 21600, suffixes=("b", "2h", "6h")).withColumn("ts", F.unix_timestamp("ts"))
    return rnd(found, ["symbol", "ts"], [n for n in found.columns if n not in ("symbol", "ts", "close")])


def regime_matrix(spark, sf_dir):
    found = MX.regime_matrix(V.bars(spark, sf_dir), REGIME_FRAMES).withColumn("ts", F.unix_timestamp("ts"))
    return rnd(found, ["symbol", "ts"], [f"{n}_{s}" for s in REGIME_FRAMES for n in VOLATILITY])


def _frame_sql(suffix: str, seconds: int) -> str:
    """A timeframe's volatility features as the table f_<suffix> of bucket starts ``b``, each of the bucket before."""

    def over(n: int) -> str:
        return f"(PARTITION BY symbol ORDER BY b ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    atr = ", ".join(f"CASE WHEN count(*) OVER {over(n)} = {n} THEN avg(tr) OVER {over(n)} / close END AS atr_{n}" for n in (5, 14, 21, 40))
    rv = ", ".join(f"CASE WHEN count(r) OVER {over(n)} = {n} THEN stddev_samp(r) OVER {over(n)} END AS rv_{n}" for n in (20, 40))
    vov = ", ".join(f"CASE WHEN count(rv_{n}) OVER {over(n)} = {n} THEN stddev_samp(rv_{n}) OVER {over(n)} END AS vov_{n}" for n in (20, 40))
    return f"""c_{suffix} AS (SELECT symbol, time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '1970-01-01') AS b, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM v_bars GROUP BY 1, 2),
 r_{suffix} AS (SELECT *, ln(close / lag(close) OVER o) AS r, coalesce(greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)), high - low) AS tr FROM c_{suffix} WINDOW o AS (PARTITION BY symbol ORDER BY b)),
 v_{suffix} AS (SELECT *, {atr}, {rv} FROM r_{suffix}), w_{suffix} AS (SELECT *, {vov} FROM v_{suffix}),
 f_{suffix} AS (SELECT symbol, b, {', '.join(f'lag({n}) OVER (PARTITION BY symbol ORDER BY b) AS {n}_{suffix}' for n in VOLATILITY)} FROM w_{suffix})"""


REGIME_SQL = f"""WITH {', '.join(_frame_sql(s, n) for s, n in REGIME_FRAMES.items())}
 SELECT v_bars.symbol, CAST(epoch(ts) AS BIGINT) AS ts, {', '.join(r(f'coalesce({n}_{s}, 0)', f'{n}_{s}') for s in REGIME_FRAMES for n in VOLATILITY)} FROM v_bars
 {' '.join(f"JOIN f_{s} ON f_{s}.symbol = v_bars.symbol AND f_{s}.b = time_bucket(INTERVAL {n} SECOND, ts, TIMESTAMP '1970-01-01')" for s, n in REGIME_FRAMES.items())}"""


# regimes


def labelled(spark, sf_dir) -> DataFrame:
    return G.volatility_regime(V.bars(spark, sf_dir))


REGIME = """x AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM v_bars),
 y AS (SELECT *, CASE WHEN count(d) OVER w >= 20 THEN stddev_samp(d) OVER w END AS v FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 g AS (SELECT symbol, ts, close, ntile(3) OVER (PARTITION BY symbol ORDER BY v, ts) - 1 AS regime FROM y WHERE v IS NOT NULL)"""


def detected(spark, sf_dir):
    bars = W.volatility_features(V.bars(spark, sf_dir))
    return G.detect(bars, ["atr_14", "rv_20", "vov_20"]).withColumn("ts", F.unix_timestamp("ts"))


MEMBERS, REGIME_FEATURES = EN.EnsembleSpec(states=3, least_features=2), ["atr_14", "rv_20", "vov_20"]


def ensemble_regimes(spark, sf_dir):
    bars = W.volatility_features(V.bars(spark, sf_dir))
    found = EN.expected_next(bars, REGIME_FEATURES, EN.ensemble_regimes(bars, REGIME_FEATURES, MEMBERS), MEMBERS)
    return found.withColumn("ts", F.unix_timestamp("ts"))


def ensemble_members(spark, sf_dir):
    return EN.rejections(EN.fit_members(W.volatility_features(V.bars(spark, sf_dir)), REGIME_FEATURES, MEMBERS))


def learned(spark, sf_dir):
    return SE.learned_search(V.bars(spark, sf_dir), {"fast": [2, 3, 5, 8], "slow": [10, 13, 21, 34]}, SE.moving_cross)


# search

SPACE = {"fast": (3, 5, 8), "slow": (13, 21)}


def grid_search(spark, sf_dir):
    return rnd(SE.run_grid(V.bars(spark, sf_dir), SE.grid(spark, SPACE), SE.moving_cross), ["symbol", "param_id", "params"], list(SE.SCORES), 5)


def walk_forward(spark, sf_dir):
    bars = V.bars(spark, sf_dir)
    third = F.ntile(3).over(Window.partitionBy("symbol").orderBy("ts"))
    parts = bars.withColumn("third", third)
    train = parts.where("third < 3").select("*", (F.col("third") - 1).alias("fold"), F.lit("train").alias("role"))
    test = parts.where("third > 1").select("*", (F.col("third") - 2).alias("fold"), F.lit("test").alias("role"))
    found = SE.walk_forward(bars, train.unionByName(test), SE.grid(spark, SPACE), SE.moving_cross)
    return rnd(found, ["symbol", "fold", "param_id", "params"], ["is_score", *SE.SCORES, "efficiency"], 4)


def cross_sql(fast: int, slow: int) -> str:
    """The moving-average rule's signal in SQL."""
    f, w = (f"(PARTITION BY k ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (fast, slow))
    return f"CASE WHEN count(*) OVER {f} = {fast} AND count(*) OVER {w} = {slow} THEN sign(avg(close) OVER {f} - avg(close) OVER {w}) ELSE 0 END"


def replayed(source: str, signals: list[tuple[str, str]] | None = None) -> str:
    """DuckDB's own replay of signals (params, SQL) over ``source`` (k, ts, open, close): ``scores`` per (k, param_id).

    Without signals, the moving-average rule with every parameter set of ``SPACE``.
    """
    every = [(f'{{"fast": {f}, "slow": {s}}}', cross_sql(f, s)) for f in SPACE["fast"] for s in SPACE["slow"]]
    union = " UNION ALL ".join(
        f"SELECT {i} AS param_id, '{params}' AS params, k, ts, open, close, CAST({signal} AS DOUBLE) AS sig FROM {source}" for i, (params, signal) in enumerate(signals or every)
    )
    return f"""sg AS ({union}),
 ps AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS p, lag(close) OVER w AS pc, row_number() OVER w AS n FROM sg WINDOW w AS (PARTITION BY k, param_id ORDER BY ts)),
 st AS (SELECT *, coalesce(lag(p) OVER w, 0) AS pp FROM ps WINDOW w AS (PARTITION BY k, param_id ORDER BY ts)),
 eq AS (SELECT *, 100000 + sum(coalesce(pp * (open - pc), 0) + p * (close - open)) OVER w AS e, sum(CASE WHEN p <> pp THEN 1 ELSE 0 END) OVER w AS seg FROM st WINDOW w AS (PARTITION BY k, param_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 rt AS (SELECT *, e / lag(e) OVER w - 1 AS r, max(e) OVER (PARTITION BY k, param_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk, lead(open) OVER w AS nxt FROM eq WINDOW w AS (PARTITION BY k, param_id ORDER BY ts)),
 tr AS (SELECT k, param_id, seg, any_value(p) AS p, arg_min(open, n) AS o, arg_max(coalesce(nxt, close), n) AS x FROM rt GROUP BY k, param_id, seg),
 tt AS (SELECT k, param_id, count(*) AS trades, avg(CAST(p * (x - o) > 0 AS DOUBLE)) AS wins, sum(greatest(p * (x - o), 0)) / nullif(-sum(least(p * (x - o), 0)), 0) AS pf FROM tr WHERE p <> 0 GROUP BY k, param_id),
 sc AS (SELECT k, param_id, any_value(params) AS params, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, arg_max(e, n) / arg_min(e, n) - 1 AS total_return, max(1 - e / pk) AS max_drawdown FROM rt GROUP BY k, param_id),
 scores AS (SELECT sc.*, coalesce(trades, 0)::DOUBLE AS trades, coalesce(wins, 0) AS win_rate, coalesce(pf, 0) AS profit_factor FROM sc LEFT JOIN tt USING (k, param_id))"""


def cpcv_metrics(spark, sf_dir):
    return rnd(SE.path_metrics(V.folds(spark, sf_dir)), ["param_id"], ["mean", "median", "p25", "low", "sd", "n", "consistency"])


PATHS = """m AS (SELECT param_id, avg(sharpe) AS mean, median(sharpe) AS median, quantile_cont(sharpe, 0.25) AS p25, min(sharpe) AS low, stddev_samp(sharpe) AS sd, count(*) AS n,
 1 / (1 + coalesce(abs(stddev_samp(sharpe) / nullif(avg(sharpe), 0)), 0)) AS consistency FROM v_folds WHERE sharpe IS NOT NULL GROUP BY param_id)"""


def dual(spark, sf_dir):
    return rnd(SE.dual_filter(SE.path_metrics(V.folds(spark, sf_dir))), ["param_id"], ["median", "consistency", "low", "score"])


def tier(spark, sf_dir):
    m = SE.path_metrics(V.folds(spark, sf_dir))
    return rnd(SE.tiers(m, {"median": 0.4, "consistency": 0.3, "low": 0.3}), ["param_id", "tier"], ["composite"])


def stability(spark, sf_dir):
    return rnd(SE.trial_stability(V.trials(spark, sf_dir), "p_size"), ["part"], ["n", "mean", "sd", "cv", "mode"])


def heat(spark, sf_dir):
    return rnd(SE.heatmap(V.trials(spark, sf_dir), "p_size", "p_brand"), ["p_size", "p_brand"], ["mean", "smooth"])


def near(spark, sf_dir):
    t = V.trials(spark, sf_dir).where("state = 'COMPLETE'").withColumn("second", F.col("score"))
    return rnd(SE.neighbours(t, ["p_size", "second"], "score", 0.05), ["number"], ["mean", "sd", "n", "stability"], 5)


# patterns


def pivots(spark, sf_dir):
    return P.confirmed_pivots(V.bars(spark, sf_dir), 3, 2.0).withColumn("ts", F.unix_timestamp("ts"))


def springs(spark, sf_dir):
    bars = V.bars(spark, sf_dir)
    return P.spring_signals(bars, P.confirmed_pivots(bars, 2, 2.0), 1.0).withColumn("ts", F.unix_timestamp("ts"))


def zones(spark, sf_dir):
    bars = V.bars(spark, sf_dir)
    return P.zone_entries(bars, P.rolling_zones(bars, step=20)).select("symbol", V.epoch(), "in_zone")


def optimal_d(spark, sf_dir):
    return SE.optimal_difference(V.bars(spark, sf_dir))


# studies


def multi_timeframe(spark, sf_dir):
    bars = V.bars(spark, sf_dir)
    names = ["roc", "williams_r"]
    out = FT.several_timeframes(bars, {"6h": "6 hours"}, lambda d: W.williams_r(W.roc(d, 3), 5), names)
    return out.select("symbol", V.epoch(), *(F.round(f"{n}_6h", 6).alias(f"{n}_6h") for n in names))


def squeeze_windows(spark, sf_dir):
    return rnd(FT.squeeze_momentum(V.bars(spark, sf_dir)).withColumn("ts", F.unix_timestamp("ts")), ["symbol", "ts"], ["squeeze_on", "squeeze_slope"], 9)


def meta_matrix(spark, sf_dir):
    names = ["session_width", "session_width_ratio", "session_position", "prev_session_position", *(f"{n}_{h}h" for h in (2, 6) for n in ("bb_width", "williams_r", "roc", "zscore"))]
    return rnd(FT.meta_features(V.bars(spark, sf_dir)).withColumn("ts", F.unix_timestamp("ts")), ["symbol", "ts"], names)


def rescaled(spark, sf_dir):
    e = V.equity(spark, sf_dir)
    return rnd(FT.dynamic_normalized(e, R.rebalance_dates(e).select("ts")).withColumn("ts", F.unix_timestamp("ts")), ["asset", "ts"], ["scale", "equity_scaled"], 4)


def suite(spark, sf_dir):
    found = ST.suite(V.bars(spark, sf_dir), {"cross": SE.moving_cross, "hold": SE.buy_and_hold}, {"1h": "1 hour", "6h": "6 hours"}, {"fast": 3, "slow": 13})
    return rnd(found, ["symbol", "timeframe", "strategy", "rank"], list(SE.SCORES), 5)


SUITE = V.oracle(f"""WITH src AS (SELECT symbol || '/1h' AS k, ts, open, close FROM v_bars UNION ALL SELECT symbol || '/6h', time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), first(open ORDER BY ts), last(close ORDER BY ts) FROM v_bars GROUP BY symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')),
 {replayed('src', [('cross', cross_sql(3, 13)), ('hold', '1')])}, sp AS (SELECT *, split_part(k, '/', 1) AS symbol, split_part(k, '/', 2) AS timeframe FROM scores)
 SELECT symbol, {', '.join(r(n, n, 5) for n in SE.SCORES)}, timeframe, params AS strategy, CAST(row_number() OVER (PARTITION BY timeframe, params ORDER BY sharpe DESC NULLS LAST, symbol) AS INT) AS rank FROM sp""", "v_bars")


def five_phases(spark, sf_dir):
    return ST.stability_study(V.bars(spark, sf_dir), SE.moving_cross, {"fast": (3, 5, 8), "slow": (13, 21)})


def pilot(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    return ST.pilot(d, R.rebalance_dates(d, "YEAR").select("ts"))


def turnovers(spark, sf_dir):
    d = daily_returns(spark, sf_dir)
    dates = R.rebalance_dates(d, "YEAR").select(F.col("ts").alias("date"))
    n = F.dense_rank().over(Window.orderBy("asset"))
    w = dates.crossJoin(d.select("asset").distinct().withColumn("k", n)).withColumns({"strategy": F.lit("moving"), "weight": (F.col("k") + F.year("date") % 3) / 20})
    return rnd(PF.turnover(w).withColumn("date", F.unix_timestamp("date")), ["strategy", "date"], ["turnover"])


DAY = "d AS (SELECT asset, date_trunc('day', ts) AS ts, avg(ret) AS ret FROM v_returns GROUP BY 1, 2)"
COV = f"""WITH {DAY}, n AS (SELECT count(DISTINCT ts) AS n FROM d), s AS (SELECT asset, sum(ret) AS s FROM d GROUP BY asset),
 c AS (SELECT a.asset AS i, b.asset AS j, sum(a.ret * b.ret) AS xy FROM d a JOIN d b USING (ts) GROUP BY 1, 2),
 k AS (SELECT p.asset AS i, q.asset AS j, (coalesce(xy, 0) - p.s * q.s / n) / (n - 1) AS cov FROM s p CROSS JOIN s q CROSS JOIN n LEFT JOIN c ON c.i = p.asset AND c.j = q.asset)"""



def phi(x: str, terms: int = 120) -> str:
    """The normal distribution function in SQL, by its series of odd powers over odd factorials."""
    series = f"list_sum(list_transform(range(0, {terms}), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))))"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {series})"


def newton(x: str) -> str:
    return f"{x} - ({phi(x)} - p) * sqrt(2 * pi()) * exp({x} * {x} / 2)"


#: Normal quantiles ``x2`` of the shares ``p`` of the table ``s``: a rational start and two steps of Newton's method.
QUANTILES = f"""t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM s), x0 AS (SELECT *, sign(p - 0.5) * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)) AS x0 FROM t),
 x1 AS (SELECT *, {newton('x0')} AS x1 FROM x0), x2 AS (SELECT *, {newton('x1')} AS x2 FROM x1)"""
TWENTY = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
ROWS = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN"


def oscillators_sql(hours: int) -> str:
    """The oscillators of a timeframe as table ``o<hours>``, each with the last complete bar's values at ``b``."""
    return f"""c{hours} AS (SELECT symbol, time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01') AS ts, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM v_bars GROUP BY 1, 2),
 f{hours} AS (SELECT symbol, ts, CASE WHEN count(*) OVER a = 20 THEN 2 * 2.0 * stddev_samp(close) OVER a / (avg(close) OVER a + 1e-9) END AS bb_width,
  CASE WHEN count(*) OVER b = 14 THEN -100 * (max(high) OVER b - close) / nullif(max(high) OVER b - min(low) OVER b, 0) END AS williams_r, (close / nullif(lag(close, 10) OVER w, 0) - 1) * 100 AS roc,
  CASE WHEN count(*) OVER z >= 20 THEN (close - avg(close) OVER z) / nullif(stddev_samp(close) OVER z, 0) END AS zscore FROM c{hours}
  WINDOW a AS ({ROWS} 19 PRECEDING AND CURRENT ROW), b AS ({ROWS} 13 PRECEDING AND CURRENT ROW), z AS ({ROWS} 251 PRECEDING AND CURRENT ROW), w AS (PARTITION BY symbol ORDER BY ts)),
 o{hours} AS (SELECT symbol, ts, lag(bb_width) OVER w AS bb_width, lag(williams_r) OVER w AS williams_r, lag(roc) OVER w AS roc, lag(zscore) OVER w AS zscore FROM f{hours} WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


META = f"""WITH q AS (SELECT *, max(CASE WHEN strftime(ts, '%H:%M') BETWEEN '03:00' AND '04:30' THEN high END) OVER d AS h0, min(CASE WHEN strftime(ts, '%H:%M') BETWEEN '03:00' AND '04:30' THEN low END) OVER d AS l0 FROM v_bars WINDOW d AS (PARTITION BY symbol, CAST(ts AS DATE))),
 e AS (SELECT *, last_value(h0 IGNORE NULLS) OVER c AS sh, last_value(l0 IGNORE NULLS) OVER c AS sl FROM q WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 dy AS (SELECT symbol, CAST(ts AS DATE) AS day, max(sh) AS h, min(sl) AS l FROM e GROUP BY 1, 2), pv AS (SELECT symbol, day, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 {oscillators_sql(2)}, {oscillators_sql(6)}, j AS (SELECT e.*, ph, pl FROM e LEFT JOIN pv ON pv.symbol = e.symbol AND pv.day = CAST(e.ts AS DATE))
 SELECT j.symbol, CAST(epoch(j.ts) AS BIGINT) AS ts, {r('(sh - sl) / nullif(close, 0)', 'session_width')}, {r('(sh - sl) / nullif(ph - pl, 0)', 'session_width_ratio')}, {r('(close - sl) / nullif(sh - sl, 0)', 'session_position')}, {r('(close - pl) / nullif(ph - pl, 0)', 'prev_session_position')},
 {', '.join(f"round(coalesce(o{h}.{n}, 0), 6) + 0.0 AS {n}_{h}h" for h in (2, 6) for n in ('bb_width', 'williams_r', 'roc', 'zscore'))}
 FROM j ASOF LEFT JOIN o2 ON o2.symbol = j.symbol AND j.ts >= o2.ts ASOF LEFT JOIN o6 ON o6.symbol = j.symbol AND j.ts >= o6.ts"""

QUERIES = {
    "three_way_split": (three_way, V.oracle(f"SELECT asset, CASE WHEN ts <= '1998-01-01' THEN 'train' WHEN ts <= '2000-01-01' THEN 'test' ELSE 'live' END AS part, {r('count(*)', 'n')}, {r('sum(ret)', 'total')} FROM v_returns GROUP BY 1, 2", "v_returns")),
    "walk_forward_split": (walk_forward_split, V.oracle(f"""WITH m AS (SELECT *, year(ts) * 12 + month(ts) AS m FROM v_returns), e AS (SELECT min(m) AS a, max(m) AS b FROM m),
        f AS (SELECT k AS fold, a + 3 * k AS tr, a + 3 * k + 10 AS te FROM e, range(1000) t(k) WHERE a + 3 * k + 12 <= b)
        SELECT CAST(fold AS INT) AS fold, CASE WHEN m < te THEN 'train' ELSE 'test' END AS role, {r('count(*)', 'n')}, {r('sum(ret)', 'total')} FROM m JOIN f ON m BETWEEN tr AND te + 2 GROUP BY 1, 2""", "v_returns")),
    "cpcv_split": (cpcv_split, V.oracle(f"""WITH e AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM v_returns), g AS (SELECT k AS g, a + to_months(CAST(6 * k AS INT)) AS s, a + to_months(CAST(6 * k + 6 AS INT)) AS t FROM e, range(1000) u(k) WHERE a + to_months(CAST(6 * k + 6 AS INT)) <= z),
        p AS (SELECT x.g AS g0, y.g AS g1, row_number() OVER (ORDER BY x.g, y.g) - 1 AS path FROM g x JOIN g y ON x.g < y.g QUALIFY row_number() OVER (ORDER BY x.g, y.g) <= 6),
        f AS (SELECT path, 0 AS fold, g0 AS g, g1 AS o FROM p UNION ALL SELECT path, 1, g1, g0 FROM p), t AS (SELECT path, fold, s, t, s - to_days(CASE WHEN o = f.g - 1 THEN 0 ELSE 5 END) AS s5, t + to_days(CASE WHEN o = f.g + 1 THEN 0 ELSE 5 END) AS t5 FROM f JOIN g ON g.g = f.g),
        u AS (SELECT path, fold, 'test' AS role, ret FROM v_returns JOIN t ON ts >= s AND ts < t UNION ALL
          SELECT path, -1, 'train', ret FROM v_returns v, (SELECT DISTINCT path FROM t) q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.path = q.path AND v.ts >= s5 AND v.ts < t5))
        SELECT CAST(path AS INT) AS path, CAST(fold AS INT) AS fold, role, {r('count(*)', 'n')}, {r('sum(ret)', 'total')} FROM u GROUP BY 1, 2, 3""", "v_returns")),
    "merge_intervals": (merged, """WITH t AS (SELECT o_orderpriority, CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(epoch(o_orderdate) + 86400 * (o_custkey % 3) AS BIGINT) AS e FROM orders),
        a AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY o_orderpriority ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM t),
        b AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a)
        SELECT o_orderpriority, min(s) AS start, max(e) AS "end" FROM b GROUP BY o_orderpriority, i"""),
    "holdout_split": (holdout, V.oracle("""WITH a AS (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, count(*) OVER (PARTITION BY asset) AS n FROM v_returns)
        SELECT asset, CASE WHEN i <= floor(n * 0.8) THEN 'fit' ELSE 'holdout' END AS role, count(*) AS n, CAST(epoch(max(ts)) AS BIGINT) AS last FROM a GROUP BY 1, 2""", "v_returns")),
    "entry_time_bounds": (bounds, V.oracle(f"""WITH a AS (SELECT strategy, entry_time, row_number() OVER (PARTITION BY strategy ORDER BY {ORDER_SQL}) AS i, count(*) OVER (PARTITION BY strategy) AS n FROM v_trades)
        SELECT strategy, CAST(epoch(max(entry_time) FILTER (i <= floor(n * 0.7::DOUBLE))) AS BIGINT) AS train_end, CAST(epoch(max(entry_time) FILTER (i <= floor(n * 0.85::DOUBLE))) AS BIGINT) AS val_end FROM a GROUP BY strategy""", "v_trades")),
    "optimal_folds": (lambda s, d: SP.optimal_folds(s, 2000, 1500, 20), """WITH f AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * k / n AS p, 2000 * (n - k) / n AS t FROM (SELECT unnest(range(3, 101))::DOUBLE AS n), LATERAL (SELECT unnest(range(2, CAST(n AS INT)))::DOUBLE AS k))
        SELECT CAST(n AS INT) AS n_folds, CAST(k AS INT) AS n_test FROM f ORDER BY abs(p / 20 - 1) + abs(t / 1500 - 1), n, k LIMIT 1"""),
    "sample_covariance": (cov_query(RK.sample_covariance), V.oracle(f"{COV} SELECT i AS asset_i, j AS asset_j, {r('cov', 'cov', 12)} FROM k", "v_returns")),
    "pairwise_covariance": (cov_query(RK.pairwise_covariance), V.oracle(f"WITH {DAY} SELECT a.asset AS asset_i, b.asset AS asset_j, {r('covar_samp(a.ret, b.ret)', 'cov', 12)} FROM d a JOIN d b USING (ts) GROUP BY 1, 2", "v_returns")),
    "ewma_covariance": (cov_query(RK.ewma_covariance), V.oracle(f"""WITH {DAY}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM d)),
        mu AS (SELECT asset, sum(ret) / (SELECT max(n) FROM t) AS mu FROM d GROUP BY asset), x AS (SELECT i, n, mu.asset, coalesce(ret, 0) - mu AS r FROM t CROSS JOIN mu LEFT JOIN d ON d.ts = t.ts AND d.asset = mu.asset),
        g AS (SELECT a.asset AS i, b.asset AS j, sum(CASE WHEN a.i < a.n - 1 THEN 0.06 * pow(0.94::DOUBLE, a.n - 2 - a.i) ELSE 0 END * a.r * b.r) + pow(0.94::DOUBLE, max(a.n) - 1) * sum(a.r * b.r) / max(a.n) AS cov FROM x a JOIN x b ON a.i = b.i GROUP BY 1, 2)
        SELECT i AS asset_i, j AS asset_j, {r('CASE WHEN i = j THEN greatest(cov, 1e-12) ELSE cov END', 'cov', 12)} FROM g""", "v_returns")),
    "garch_covariance": (cov_query(RK.garch_covariance), None),
    "denoised_covariance": (dense(lambda m: RK.marchenko_pastur(m, 2000)), None),
    "rolling_eigenvalues": (eigen, None),
    "feature_correlation": (feature_correlation, V.oracle(f"SELECT a.feature AS i, b.feature AS j, {r('corr(a.value, b.value)', 'corr')} FROM v_features a JOIN v_features b USING (id) GROUP BY 1, 2", "v_features")),
    "pca_spectrum": (pca_spectrum, None),
    "onc_clusters": (onc_clusters, None),
    "neighbour_information": (neighbour_information, None),
    "neighbour_pairs": (neighbour_pairs, V.oracle(NEIGHBOURS, "v_returns")),
    "mutual_information": (mutual, V.oracle(f"""WITH e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v_features GROUP BY feature),
        b AS (SELECT id, feature, value, least(CAST(floor((value - lo) / (hi - lo) * 5) AS INT), 4) AS bin FROM v_features JOIN e USING (feature)),
        h AS (SELECT feature, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT feature, bin, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2) GROUP BY 1),
        j AS (SELECT i, j, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT a.feature AS i, c.feature AS j, a.bin, c.bin, count(*)::DOUBLE AS n FROM b a JOIN b c USING (id) WHERE a.feature < c.feature GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
        k AS (SELECT a.feature AS i, c.feature AS j, corr(a.value, c.value) AS corr FROM b a JOIN b c USING (id) WHERE a.feature < c.feature GROUP BY 1, 2)
        SELECT j.i, j.j, {r('greatest(x.h + y.h - j.h, 0)', 'mi')}, {r('2 * greatest(x.h + y.h - j.h, 0) / (x.h + y.h)', 'nmi')}, {r('corr', 'corr')} FROM j JOIN k ON j.i = k.i AND j.j = k.j JOIN h x ON x.feature = j.i JOIN h y ON y.feature = j.j""", "v_features")),
    "rank_share": (rank_share, V.oracle(f"SELECT id, feature, {r('(rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2) / count(*) OVER (PARTITION BY feature)', 'share')} FROM v_features", "v_features")),
    "rank_gaussian": (gauss, V.oracle(f"""WITH s AS (SELECT id, feature, least(greatest((rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2) / count(*) OVER (PARTITION BY feature), 1e-6), 1 - 1e-6)::DOUBLE AS p FROM v_features), {QUANTILES}
        SELECT id, feature, round(x2, 5) + 0.0 AS gauss FROM x2""", "v_features")),
    "rolling_dependence": (rolling_pairs, None),
    "portfolio_weights": (weights, None),
    "portfolio_backtest": (portfolio_backtest, None),
    "equal_weight_backtest": (equal_hold, V.oracle(f"""WITH {DAY}, a AS (SELECT max(ts) AS date FROM d GROUP BY year(ts)), f AS (SELECT min(date) AS first FROM a),
        p AS (SELECT ts, sum(0.2 * ret) AS ret FROM d, f WHERE ts >= first GROUP BY ts)
        SELECT 'equal' AS strategy, CAST(epoch(ts) AS BIGINT) AS ts, {r('ret', 'ret')}, {r('100000 * exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING))', 'equity')} FROM p""", "v_returns")),
    "ruled_backtest": (ruled_backtest, V.oracle(f"""WITH {DAY}, x AS (SELECT asset, ts, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS n FROM d),
        u AS (SELECT asset, n, ts, ret, 1.0::DOUBLE AS q, greatest(1 + ret, 1) AS pk, 1 + ret AS e, 1 - (1 + ret) / greatest(1 + ret, 1) >= 0.075 AS half FROM x WHERE n = 1
          UNION ALL SELECT asset, n, ts, ret, q, greatest(pk, e2), e2, 1 - e2 / greatest(pk, e2) >= 0.075 OR (half AND 1 - e2 / greatest(pk, e2) > 0.07)
          FROM (SELECT x.asset, x.n, x.ts, x.ret, CASE WHEN u.half THEN 0.5 ELSE 1 END::DOUBLE AS q, u.pk, u.half, u.e * (1 + CASE WHEN u.half THEN 0.5 ELSE 1 END * x.ret) AS e2 FROM u JOIN x ON x.asset = u.asset AND x.n = u.n + 1))
        SELECT asset AS strategy, CAST(epoch(ts) AS BIGINT) AS ts, {r('ret', 'ret', 5)}, {r('100000 * e', 'equity', 5)}, {r('q', 'exposure', 5)} FROM u""", "v_returns").replace("WITH ", "WITH RECURSIVE ", 1)),
    "scale_factors": (scales, V.oracle(f"""WITH {DAY} SELECT asset, CAST(epoch(ts) AS BIGINT) AS ts, {r("CASE WHEN count(ret) OVER w >= 60 THEN least(0.1 / greatest(stddev_samp(ret) OVER w * sqrt(252), 0.05), 10) ELSE 1 END", 'scale')}
        FROM d WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""", "v_returns")),
    "monte_carlo_iid": (monte_carlo("iid"), None),
    "monte_carlo_stationary": (monte_carlo("stationary"), None),
    "monte_carlo_semiparametric": (monte_carlo("semiparametric"), None),
    "tail_value_at_risk": (tail_var, None),
    "permutation_test": (permutation, None),
    "state_features": (state, V.oracle(f"""WITH {RR}, w AS (SELECT strategy, {', '.join(f"CASE WHEN count(rr) OVER w{n} >= 10 THEN avg(rr) OVER w{n} END AS a{n}, CASE WHEN count(rr) OVER w{n} >= 10 THEN avg(CAST(rr > 0 AS DOUBLE)) OVER w{n} END AS b{n}" for n in (20, 50))} FROM rr
        WINDOW {', '.join(f'w{n} AS (PARTITION BY strategy ORDER BY {ORDER_SQL} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)' for n in (20, 50))})
        SELECT strategy, {', '.join(f"{r(f'sum(coalesce(a{n}, 0))', f'state_rr_{n}', 5)}, {r(f'sum(coalesce(b{n}, 0.5))', f'state_winrate_{n}', 5)}" for n in (20, 50))} FROM w GROUP BY strategy""", "v_trades")),
    "meta_labels": (labels, V.oracle(f"""WITH {RR} SELECT strategy, CASE WHEN rr < -0.99 THEN 0 WHEN abs((exit_price - sl) / sl) <= 0.01 THEN 1 WHEN rr > 0.2 THEN 2 ELSE -1 END AS meta,
        CASE WHEN pnl < 0 THEN 0 WHEN pnl >= 0 THEN 1 ELSE -1 END AS meta_binary, count(*) AS n FROM rr GROUP BY 1, 2, 3""", "v_trades")),
    "auc": (auc, V.oracle(f"""WITH {PROB}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY p) + (count(*) OVER (PARTITION BY feature, p) - 1) / 2 AS rk FROM p)
        SELECT feature, {r('(sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))', 'auc')} FROM k GROUP BY feature""", "v_features")),
    "classifier_metrics": (classifier_metrics, V.oracle(f"""WITH {PROB}, k AS (SELECT *, greatest(least(p, 1 - 1e-15), 1e-15) AS q, CAST(p >= 0.5 AS INT) AS y FROM p)
        SELECT feature, {r('count(*)', 'n')}, {r('-avg(label * ln(q) + (1 - label) * ln(1 - q))', 'log_loss')}, {r('avg(pow(p - label, 2))', 'brier')}, {r('avg(CAST(y = label AS DOUBLE))', 'accuracy')},
        {r('sum(y * label) / sum(y)', 'precision')}, {r('sum(y * label) / sum(label)', 'recall')}, {r('2 * sum(y * label) / (sum(y) + sum(label))', 'f1')} FROM k GROUP BY feature""", "v_features")),
    "best_threshold": (best_threshold, V.oracle(f"""WITH {PROB}, n AS (SELECT feature, p, sum(label) AS pos, count(*) AS n FROM p GROUP BY 1, 2),
        k AS (SELECT feature, p, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER t AS ps, sum(n) OVER t AS al FROM n WINDOW w AS (PARTITION BY feature ORDER BY p DESC ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY feature)),
        j AS (SELECT feature, p, tp / ps - (said - tp) / (al - ps) AS v FROM k) SELECT feature, {r('arg_max(p, (v, p))', 'threshold')}, {r('max(v)', 'value')} FROM j GROUP BY feature""", "v_features")),
    "calibrated_metrics": (calibrated, None),
    "feature_votes": (votes, None),
    "transition_matrix": (lambda s, d: rnd(G.transition_matrix(labelled(s, d)), ["symbol", "from", "to"], ["n", "share"]), V.oracle(f"""WITH {REGIME}, t AS (SELECT symbol, regime AS f, lead(regime) OVER (PARTITION BY symbol ORDER BY ts) AS t FROM g)
        SELECT symbol, CAST(f AS INT) AS "from", CAST(t AS INT) AS "to", {r('count(*)', 'n')}, {r('count(*) / sum(count(*)) OVER (PARTITION BY symbol, f)', 'share')} FROM t WHERE t IS NOT NULL GROUP BY symbol, f, t""", "v_bars")),
    "run_lengths": (lambda s, d: rnd(G.run_lengths(labelled(s, d)), ["symbol", "regime"], ["runs", "mean_length", "longest"]), V.oracle(f"""WITH {REGIME}, k AS (SELECT symbol, regime, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, regime ORDER BY ts) AS k FROM g),
        n AS (SELECT symbol, regime, count(*) AS n FROM k GROUP BY symbol, regime, k) SELECT symbol, CAST(regime AS INT) AS regime, {r('count(*)', 'runs')}, {r('avg(n)', 'mean_length')}, {r('max(n)', 'longest')} FROM n GROUP BY 1, 2""", "v_bars")),
    "regime_returns": (lambda s, d: rnd(G.regime_returns(labelled(s, d)), ["symbol", "regime"], ["n", "mean", "sd", "var"]), V.oracle(f"""WITH {REGIME}, k AS (SELECT symbol, lag(regime) OVER w AS regime, close - lag(close) OVER w AS d FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts))
        SELECT symbol, CAST(regime AS INT) AS regime, {r('count(*)', 'n')}, {r('avg(d)', 'mean')}, {r('stddev_samp(d)', 'sd')}, {r('quantile_cont(d, 0.05)', 'var')} FROM k WHERE regime IS NOT NULL GROUP BY 1, 2""", "v_bars")),
    "detected_regimes": (detected, None),
    "ensemble_regimes": (ensemble_regimes, None),
    "ensemble_members": (ensemble_members, None),
    "boosting_losses": (boosting_losses, None),
    "boosting_metrics": (boosting_metrics, None),
    "permuted_importance": (permuted_importance, None),
    "tuned_trials": (tuned_trials, None),
    "denoised_vectors": (denoised_vectors, None),
    "ensemble_diagnosis": (ensemble_diagnosis, None),
    "perturbed_trials": (perturbed_trials, None),
    "selection_report": (selection_report, None),
    "meta_label_matrix": (meta_label_matrix, None),
    "regime_matrix": (regime_matrix, V.oracle(REGIME_SQL, "v_bars")),
    "rolling_spectrum": (rolling_spectrum, None),
    "noise_spectrum": (noise_spectrum, None),
    "reality_check": (reality_check, None),
    "learning_curve": (learning_curve, None),
    "learned_search": (learned, None),
    "grid_search": (grid_search, V.oracle(f"WITH src AS (SELECT symbol AS k, ts, open, close FROM v_bars), {replayed('src')} SELECT k AS symbol, param_id, params, {', '.join(r(n, n, 5) for n in SE.SCORES)} FROM scores", "v_bars")),
    "walk_forward": (walk_forward, V.oracle(f"""WITH th AS (SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY ts) AS third FROM v_bars),
        src AS (SELECT symbol || '/' || (third - 1) || '/train' AS k, ts, open, close FROM th WHERE third < 3 UNION ALL SELECT symbol || '/' || (third - 2) || '/test', ts, open, close FROM th WHERE third > 1), {replayed('src')},
        sp AS (SELECT *, split_part(k, '/', 1) AS symbol, CAST(split_part(k, '/', 2) AS INT) AS fold, split_part(k, '/', 3) AS role FROM scores),
        ch AS (SELECT symbol, fold, param_id, sharpe AS is_score FROM sp WHERE role = 'train' QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY round(sharpe, 9) DESC, param_id) = 1)
        SELECT symbol, fold, param_id, params, {r('is_score', 'is_score', 4)}, {', '.join(r(n, n, 4) for n in SE.SCORES)}, {r('sharpe / nullif(is_score, 0)', 'efficiency', 4)} FROM ch JOIN sp USING (symbol, fold, param_id) WHERE role = 'test'""", "v_bars")),
    "cpcv_path_metrics": (cpcv_metrics, V.oracle(f"WITH {PATHS} SELECT param_id, {', '.join(r(n, n) for n in ('mean', 'median', 'p25', 'low', 'sd', 'n', 'consistency'))} FROM m", "v_folds")),
    "dual_filter": (dual, V.oracle(f"""WITH {PATHS}, f AS (SELECT * FROM m WHERE median >= (SELECT quantile_cont(median, 0.5) FROM m)),
        s AS (SELECT *, 0.5 * (median - min(median) OVER ()) / (max(median) OVER () - min(median) OVER ()) + 0.3 * (consistency - min(consistency) OVER ()) / (max(consistency) OVER () - min(consistency) OVER ())
          + 0.2 * (low - min(low) OVER ()) / (max(low) OVER () - min(low) OVER ()) AS score FROM f)
        SELECT param_id, {r('median', 'median')}, {r('consistency', 'consistency')}, {r('low', 'low')}, {r('score', 'score')} FROM s ORDER BY round(s.score, 9) DESC, param_id LIMIT 20""", "v_folds")),
    "tiers": (tier, V.oracle(f"""WITH {PATHS}, d AS (SELECT median(median) AS m1, median(consistency) AS m2, median(low) AS m3 FROM m),
        a AS (SELECT median(abs(median - m1)) AS a1, median(abs(consistency - m2)) AS a2, median(abs(low - m3)) AS a3 FROM m, d),
        s AS (SELECT param_id, {' + '.join(f"{w} * (greatest(least(coalesce(({n} - m{k}) / nullif(1.4826 * a{k}, 0), 0), 3), -3) + 3) / 6" for k, n, w in ((1, 'median', 0.4), (2, 'consistency', 0.3), (3, 'low', 0.3)))} AS composite FROM m, d, a)
        SELECT param_id, {r('composite', 'composite')}, CASE WHEN composite >= 0.7 THEN 1 WHEN composite >= 0.55 THEN 2 WHEN composite >= 0.4 THEN 3 ELSE 4 END AS tier FROM s""", "v_folds")),
    "trial_stability": (stability, V.oracle(f"""WITH d AS (SELECT * FROM v_trials WHERE state = 'COMPLETE'), c AS (SELECT quantile_cont(score, 0.9) AS q FROM d), u AS (SELECT 'all' AS part, p_size FROM d UNION ALL SELECT 'top', p_size FROM d, c WHERE score >= q),
        n AS (SELECT part, p_size, count(*) AS n FROM u GROUP BY 1, 2), o AS (SELECT part, p_size AS mode FROM n QUALIFY row_number() OVER (PARTITION BY part ORDER BY n DESC, p_size) = 1)
        SELECT u.part, {r('count(*)', 'n')}, {r('avg(p_size)', 'mean')}, {r('stddev_samp(p_size)', 'sd')}, {r('stddev_samp(p_size) / avg(p_size) * 100', 'cv')}, {r('max(mode)', 'mode')} FROM u JOIN o USING (part) GROUP BY u.part""", "v_trials")),
    "heatmap": (heat, V.oracle(f"""WITH g AS (SELECT p_size, p_brand, avg(score) AS mean FROM v_trials WHERE state = 'COMPLETE' GROUP BY 1, 2)
        SELECT p_size, p_brand, {r('mean', 'mean')}, {r('avg(mean) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 'smooth')} FROM g""", "v_trials")),
    "neighbour_stability": (near, V.oracle(f"""WITH t AS (SELECT number, score, (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE AS a, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS b FROM v_trials WHERE state = 'COMPLETE'),
        j AS (SELECT x.number, y.score AS v, abs(x.a - y.a) + abs(x.b - y.b) AS d FROM t x JOIN t y ON abs(x.a - y.a) + abs(x.b - y.b) <= 0.05),
        g AS (SELECT number, sum((1 - d / (0.05 * 1.000001)) * v) / sum(1 - d / (0.05 * 1.000001)) AS mean, stddev_samp(v) AS sd, count(*) AS n FROM j GROUP BY number)
        SELECT number, {r('mean', 'mean', 5)}, {r('sd', 'sd', 5)}, {r('n', 'n', 5)}, {r('1 / (1 + coalesce(abs(sd / mean), 0))', 'stability', 5)} FROM g""", "v_trials")),
    "multi_timeframe": (multi_timeframe, V.oracle("""WITH c AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS close FROM v_bars GROUP BY 1, 2),
        f AS (SELECT symbol, b, (close / nullif(lag(close, 3) OVER w, 0) - 1) * 100 AS roc, CASE WHEN count(*) OVER x = 5 THEN -100 * (max(h) OVER x - close) / nullif(max(h) OVER x - min(l) OVER x, 0) END AS wr FROM c
          WINDOW w AS (PARTITION BY symbol ORDER BY b), x AS (PARTITION BY symbol ORDER BY b ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
        g AS (SELECT symbol, b, lag(roc) OVER w AS roc, lag(wr) OVER w AS wr FROM f WINDOW w AS (PARTITION BY symbol ORDER BY b))
        SELECT v.symbol, CAST(epoch(v.ts) AS BIGINT) AS ts, round(coalesce(roc, 0), 6) + 0.0 AS roc_6h, round(coalesce(wr, 0), 6) + 0.0 AS williams_r_6h FROM v_bars v ASOF LEFT JOIN g ON v.symbol = g.symbol AND v.ts >= g.b""", "v_bars")),
    "squeeze_windows": (squeeze_windows, V.oracle(f"""WITH t AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM v_bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        a AS (SELECT symbol, ts, close, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS d, avg(tr) OVER w AS g, (max(high) OVER w + min(low) OVER w) / 2 AS h FROM t WINDOW w AS {TWENTY}),
        y AS (SELECT *, CASE WHEN n = 20 THEN close - (h + m) / 2 END AS y FROM a), l AS (SELECT *, list(y) OVER {TWENTY} AS l FROM y), o AS (SELECT *, list_sum(list_transform(l, lambda y, i: y * (i - 1))) AS sxy, list_sum(l) AS sy FROM l)
        SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, CASE WHEN n = 20 AND m + 2 * d < m + 1.5 * g THEN 1.0 ELSE 0.0 END::DOUBLE AS squeeze_on,
        round(CASE WHEN len(list_filter(l, lambda v: v IS NOT NULL)) = 20 THEN (20 * sxy - 190 * sy) / (20 * 2470 - 190 * 190) END, 9) AS squeeze_slope FROM o""", "v_bars")),
    "meta_features": (meta_matrix, V.oracle(META, "v_bars")),
    "dynamic_normalized": (rescaled, V.oracle(f"""WITH q AS (SELECT max(ts) AS ts FROM v_equity GROUP BY date_trunc('quarter', ts)), a AS (SELECT asset, ts, equity / lag(equity) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM v_equity),
        b AS (SELECT a.*, q.ts IS NOT NULL AS hit, CASE WHEN count(r) OVER p >= 60 THEN stddev_samp(r) OVER p * sqrt(252) END AS v FROM a LEFT JOIN q USING (ts) WINDOW p AS (PARTITION BY asset ORDER BY a.ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
        k AS (SELECT asset, ts, r, coalesce(last_value(CASE WHEN hit THEN 0.1 / nullif(v, 0) END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) AS scale FROM b)
        SELECT asset, CAST(epoch(ts) AS BIGINT) AS ts, {r('scale', 'scale', 4)}, {r('100000 * exp(sum(ln(1 + coalesce(r * scale, 0))) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING))', 'equity_scaled', 4)} FROM k""", "v_equity")),
    "backtest_suite": (suite, SUITE),
    "stability_study": (five_phases, None),
    "risk_model_pilot": (pilot, None),
    "turnover": (turnovers, V.oracle(f"""WITH {DAY}, a AS (SELECT max(ts) AS date FROM d GROUP BY year(ts)), k AS (SELECT asset, row_number() OVER (ORDER BY asset) AS k FROM (SELECT DISTINCT asset FROM d)),
        w AS (SELECT date, asset, (k + year(date) % 3) / 20.0::DOUBLE AS w FROM a CROSS JOIN k), m AS (SELECT date, abs(w - lag(w) OVER (PARTITION BY asset ORDER BY date)) AS m FROM w)
        SELECT 'moving' AS strategy, CAST(epoch(date) AS BIGINT) AS date, {r('sum(m) * 0.5', 'turnover')} FROM m GROUP BY date""", "v_returns")),
    "confirmed_pivots": (pivots, CONFIRMED),
    "spring_signals": (springs, None),
    "zone_entries": (zones, None),
    "optimal_difference": (optimal_d, None),
}

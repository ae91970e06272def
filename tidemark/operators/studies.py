"""Studies composed of operators: backtest suites, the five-phase stability study, the risk-model pilot."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import portfolio as PF
from tidemark.operators import risk as RK
from tidemark.operators import search as SE
from tidemark.operators import simulation as SI
from tidemark.operators.resample import rebalance_dates, resample_ohlc
from tidemark.sources import files

c = F.col


@dataclass(frozen=True)
class Instrument:
    """What a backtest has to know of a symbol."""

    symbol: str
    spread: float = 0.0
    commission: float = 0.0
    timezone: str = "UTC"
    asset_class: str = "index"
    currencies: tuple[str, ...] = ("USD",)


def suite(bars: DataFrame, signals: dict[str, SE.Signal], rules: dict[str, str], params: dict | None = None, exclude: tuple[str, ...] = (), timezone: str = "UTC") -> DataFrame:
    """Scores of every strategy on every symbol and timeframe, and rank by Sharpe ratio within the timeframe.

    Timeframes begin at the local times of ``timezone``.
    """
    chosen = bars.where(~c("symbol").isin(*exclude)) if exclude else bars
    chosen = chosen.withColumn("ts", F.from_utc_timestamp("ts", timezone)) if timezone != "UTC" else chosen
    grid = bars.sparkSession.createDataFrame([(0, json.dumps(params or {}))], "param_id int, params string")
    parts = None
    for timeframe, rule in rules.items():
        coarse = resample_ohlc(chosen, rule)
        for name, signal in signals.items():
            part = SE.run_grid(coarse, grid, signal).withColumns({"timeframe": F.lit(timeframe), "strategy": F.lit(name)})
            parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("timeframe", "strategy").orderBy(F.desc_nulls_last("sharpe"), "symbol")
    return parts.drop("param_id", "params").withColumn("rank", F.row_number().over(order))


def stability_study(bars: DataFrame, signal: SE.Signal, space: dict, folds: int = 4, holdout: float = 0.25, bootstraps: int = 40, top: int = 5, quantile: float = 0.5, radius: float = 0.7) -> DataFrame:
    """Five phases per parameter set: fold scores, filter, neighbourhood, bootstrap of the equity, hold-out; then tiers.

    Folds are contiguous stretches of each symbol's first part. The filter keeps the sets of at least the
    ``quantile`` of the median score, ``top`` of them; what is known of their neighbours within ``radius`` comes
    from all sets.

    The grid is small; each phase is a fan-out over (symbol, parameter set) or an aggregate of the one before.
    """
    spark = bars.sparkSession
    params = SE.grid(spark, space)
    w = Window.partitionBy("symbol")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("ts"))
    marked = bars.withColumn("_share", i / n)
    head = marked.where(c("_share") <= 1 - holdout)
    keyed = head.withColumn("symbol", F.concat_ws("|", "symbol", F.floor(c("_share") / (1 - holdout) * folds - 1e-9).cast("string")))
    columns = ("symbol", "ts", "open", "high", "low", "close", "volume")
    scores = SE.run_grid(keyed.select(*columns), params, signal)
    phase1 = SE.path_metrics(scores.select("param_id", "sharpe", F.lit(0).alias("fold")))
    phase2 = SE.dual_filter(phase1, quantile, top)
    # the neighbourhood: how a set's scores compare with those of sets near to it
    numeric = [k for k, v in space.items() if all(isinstance(x, (int, float)) for x in (v if isinstance(v, (tuple, list)) else (v,)))]
    placed = phase1.join(params, "param_id").select(c("param_id").alias("number"), "median", *(F.get_json_object("params", f"$.{k}").cast("double").alias(k) for k in numeric))
    around = SE.neighbours(placed, numeric, "median", radius).select(c("number").alias("param_id"), c("mean").alias("near_mean"), c("stability").alias("near_stability"))
    chosen = phase2.join(params, "param_id").join(around, "param_id")
    out = SE.run_grid(marked.where(c("_share") > 1 - holdout).select(*columns), params, signal)
    tested = out.groupBy("param_id").agg(F.avg("sharpe").alias("oos_sharpe"), F.sum("trades").alias("oos_trades"))
    packed = head.select(*columns).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*columns[1:]))).alias("bars"))
    dealt = packed.crossJoin(F.broadcast(chosen.select("param_id", "params"))).repartition("symbol", "param_id")

    def boot(batches):
        for pdf in batches:
            rows = []
            for data, pid, text in zip(pdf["bars"], pdf["param_id"], pdf["params"], strict=True):
                b = {k: np.array([r[k] for r in data], dtype=np.float64) for k in columns[2:]}
                equity, _ = SE.replay(b, signal(b, json.loads(text)))
                r = np.diff(equity) / equity[:-1]
                rng = np.random.default_rng([3, pid])
                found = [SI.path_metrics(r[SI.stationary_indices(rng, len(r), len(r), 10)], len(r) / 252)["sharpe"] for _ in range(bootstraps)] if len(r) > 1 else [0.0]
                rows.append((pid, float(np.mean(found)), float(np.std(found))))
            yield pd.DataFrame(rows, columns=["param_id", "boot_mean", "boot_sd"])

    booted = dealt.mapInPandas(boot, "param_id int, boot_mean double, boot_sd double").groupBy("param_id").agg(F.avg("boot_mean").alias("boot_mean"), F.avg("boot_sd").alias("boot_sd"))
    booted = booted.withColumn("boot_stability", 1 / (1 + F.coalesce(F.abs(F.try_divide("boot_sd", "boot_mean")), F.lit(0.0))))
    merged = chosen.join(tested, "param_id").join(booted, "param_id")
    merged = merged.withColumn("degradation", F.coalesce(F.try_divide("oos_sharpe", "median"), F.lit(0.0)))
    ranked = SE.tiers(merged, {"median": 0.25, "consistency": 0.15, "near_stability": 0.15, "boot_stability": 0.15, "oos_sharpe": 0.3})
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("composite"), "param_id")))


def pilot(returns: DataFrame, dates: DataFrame, lookback: int = 252) -> DataFrame:
    """Least-variance backtests under several risk models on one calendar: figures per model, and against the sample model."""
    models = {
        "sample": lambda x: np.cov(x, rowvar=False), "shrinkage": lambda x: RK.ledoit_wolf(x)[0],
        "marchenko_pastur": lambda x: RK.marchenko_pastur(np.cov(x, rowvar=False), len(x)),
        "garch": lambda x: RK.project_correlation(RK.correlation(np.cov(x, rowvar=False))) * np.outer(*[np.sqrt([RK.garch_variance(col, 21) for col in x.T])] * 2),
    }
    times = returns.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")))
    anchors = dates.join(times, "ts").select(c("ts").alias("date"), c("i").alias("at"))
    dealt = returns.join(times, "ts").join(F.broadcast(anchors), (c("i") < c("at")) & (c("i") >= c("at") - lookback))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="ts", columns="asset", values="ret", aggfunc="mean").fillna(0.0).sort_index(axis=1)
        x = wide.to_numpy()
        rows = []
        for name, model in models.items():
            w = PF.minimum_variance(model(x)) if len(x) >= 60 and x.shape[1] > 1 else PF.equal(x.shape[1])
            rows += [(pdf["date"].iloc[0], name, a, float(v)) for a, v in zip(wide.columns, w, strict=True)]
        return pd.DataFrame(rows, columns=["date", "strategy", "asset", "weight"])

    weights = dealt.groupBy("date").applyInPandas(work, "date timestamp, strategy string, asset string, weight double")
    held = PF.backtest(PF.hold(returns, weights), 1.0)
    own = Window.partitionBy("strategy").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    fall = held.withColumn("fall", 1 - c("equity") / F.max("equity").over(own))
    figures = fall.groupBy("strategy").agg((F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * 252**0.5).alias("sharpe"), (F.max_by("equity", "ts") - 1).alias("total_return"), F.max("fall").alias("max_drawdown"))
    turned = PF.turnover(weights).groupBy("strategy").agg(F.avg("turnover").alias("mean_turnover"))
    base = figures.where("strategy = 'sample'").select(c("sharpe").alias("_s"), c("max_drawdown").alias("_d"))
    joined = figures.join(turned, "strategy").crossJoin(F.broadcast(base))
    better = (c("sharpe") > c("_s")) & (c("max_drawdown") <= c("_d"))
    return joined.withColumns({"sharpe_delta": c("sharpe") - c("_s"), "drawdown_delta": c("max_drawdown") - c("_d"), "better": better}).drop("_s", "_d")


def pilot_from_files(spark: SparkSession, returns_path: str, out_path: str, config_path: str | None = None) -> DataFrame:
    """The pilot on a CSV of returns: its figures, and those also as CSV below ``out_path``.

    The configuration may name ``unit`` (of rebalancing) and ``lookback``.
    """
    options = {"unit": "QUARTER", "lookback": 252} | (files.read_config(config_path) if config_path else {})
    returns = files.read_returns(spark, returns_path)
    found = pilot(returns, rebalance_dates(returns, options["unit"]).select("ts"), options["lookback"])
    files.write_table(found, out_path, "csv")
    return spark.read.option("header", True).option("inferSchema", True).csv(out_path)

"""Reports out of results: wide tables, curve points, scorecards, path statistics, trial reports, presets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def wide(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """One row per ``row`` with a column for each of the given values of ``column``; gaps are null."""
    return df.groupBy(row).agg(*(F.max(F.when(c(column) == n, c(value))).alias(n) for n in names))


def interest_points(curve: DataFrame, key: str, value: str, reach: int = 50) -> DataFrame:
    """``curve`` with ``kept``: first and last rows, the deepest drawdown's ends, and extremes of ``reach`` rows on both sides."""
    w = Window.partitionBy(key)
    order = w.orderBy("ts")
    around = order.rowsBetween(-reach, reach)
    peak = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumns({"_n": F.row_number().over(order), "_all": F.count("*").over(w), "_peak": peak})
    rows = rows.withColumn("_fall", 1 - c(value) / c("_peak"))
    rows = rows.withColumn("_low", F.max_by("_n", F.struct("_fall", -c("_n"))).over(w))
    rows = rows.withColumn("_top", F.max(F.when((c("_n") <= c("_low")) & (c(value) == c("_peak")), c("_n"))).over(w))
    extreme = (c(value) == F.max(value).over(around)) | (c(value) == F.min(value).over(around))
    kept = (c("_n") == 1) | (c("_n") == c("_all")) | (c("_n") == c("_low")) | (c("_n") == c("_top")) | extreme
    return rows.withColumn("kept", kept).drop("_n", "_all", "_peak", "_fall", "_low", "_top")


def interpolate(points: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` between kept rows on the straight line of their row numbers, as ``line``."""
    order = Window.partitionBy(key).orderBy("ts")
    rows = points.withColumn("_n", F.row_number().over(order))
    mark = F.when(c("kept"), F.struct("_n", c(value).alias("v")))
    before = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_a": before, "_b": after})
    share = F.try_divide(c("_n") - c("_a._n"), c("_b._n") - c("_a._n"))
    return rows.withColumn("line", c("_a.v") + F.coalesce(share, F.lit(0.0)) * (c("_b.v") - c("_a.v"))).drop("_n", "_a", "_b")


def monthly_return(total: Column, months: Column) -> Column:
    """A period's return per month: geometric where it is not negative, else linear, and never below -1."""
    return F.when(total >= 0, F.pow(1 + total, 1 / months) - 1).otherwise(F.greatest(total / months, F.lit(-1.0)))


def scorecard(pairs: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """Per metric the mean over folds in and out of sample, their ratio, and the share of folds that hold up.

    ``pairs`` holds ``is_<metric>`` and ``<metric>`` per fold.
    """
    entries = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c(f"is_{m}").cast("double").alias("inside"), c(m).cast("double").alias("outside")) for m in metrics)))
    rows = pairs.select(*keys, entries.alias("e")).select(*keys, "e.*")
    g = rows.groupBy(*keys, "metric").agg(F.count("*").alias("folds"), F.avg("inside").alias("inside"), F.avg("outside").alias("outside"), F.avg((c("outside") > 0).cast("double")).alias("held"))
    return g.withColumn("efficiency", F.try_divide("outside", "inside"))


def path_scores(folds: DataFrame, path: str, value: str) -> DataFrame:
    """Paths by the median of their scores, the best first; equal ones by number."""
    g = folds.where(c(value).isNotNull()).groupBy(path).agg(F.median(value).alias("median"), F.count("*").alias("n"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("median"), path)))


#: Name -> aggregate of a column: statistics across paths.
STATISTICS = {
    "n": F.count, "mean": F.avg, "median": F.median, "sd": F.stddev_samp, "var": F.var_samp, "low": F.min, "high": F.max,
    **{f"p{q:02d}": (lambda x, q=q: F.percentile(x, q / 100)) for q in (1, 5, 10, 25, 75, 90, 95, 99)},
    "skew": F.skewness, "kurt": F.kurtosis, "positive": lambda x: F.avg((c(x) > 0).cast("double")),
}


def path_statistics(folds: DataFrame, key: str, value: str) -> DataFrame:
    """The statistics of ``STATISTICS``, and range, spread of the quartiles and standard error."""
    g = folds.where(c(value).isNotNull()).groupBy(key).agg(*(work(value).cast("double").alias(n) for n, work in STATISTICS.items()))
    return g.withColumns({"range": c("high") - c("low"), "iqr": c("p75") - c("p25"), "se": c("sd") / F.sqrt("n")})


def completed(trials: DataFrame, names: list[str], value: str = "score") -> DataFrame:
    """Finished trials whose score and parameters are numbers."""
    rows = trials.where("state = 'COMPLETE'").select("number", *(c(n).cast("string").try_cast("double").alias(n) for n in [*names, value]))
    return rows.dropna()


def quartile_tiers(trials: DataFrame, value: str = "score") -> DataFrame:
    """``tier``: the quarter of the scores a trial falls in, by the quartiles' edges (4 is the best)."""
    edges = trials.agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("e")).withColumnRenamed("e", "_e")
    tier = 1 + sum(((c(value) > F.get("_e", F.lit(k))).cast("int") for k in range(3)), F.lit(0))
    return trials.crossJoin(F.broadcast(edges)).withColumn("tier", tier).drop("_e")


def parameter_bins(trials: DataFrame, name: str, most: int = 6) -> DataFrame:
    """``bin`` of a parameter: its own value where there are at most ``most``, else the upper edge of its quantile bin."""
    stats = trials.agg(F.count_distinct(name).alias("_d"), F.percentile(name, [k / most for k in range(1, most + 1)]).alias("_e"))
    upper = F.array_min(F.filter("_e", lambda e: e >= c(name)))
    return trials.crossJoin(F.broadcast(stats)).withColumn("bin", F.when(c("_d") <= most, c(name)).otherwise(upper)).drop("_d", "_e")


def radar(trials: DataFrame, names: list[str], value: str = "score", share: float = 0.1) -> DataFrame:
    """Per parameter, 0 to 1: how steady scores are over its bins, how steady and how agreed the best trials'
    values are, how strongly it goes with the score, and how much of its range the best trials take."""
    edge = trials.agg(F.percentile(value, 1 - share).alias("_edge"))
    out = None
    steady = lambda sd, mean: 1 / (1 + F.coalesce(F.abs(F.try_divide(sd, mean)), F.lit(0.0)))
    for name in names:
        binned = parameter_bins(trials, name).crossJoin(F.broadcast(edge)).withColumn("_top", c(value) >= c("_edge"))
        by_bin = binned.groupBy("bin").agg(F.avg(value).alias("m"))
        levels = by_bin.agg(steady(F.stddev_samp("m"), F.avg("m")).alias("level"))
        top = binned.where("_top")
        modal = top.groupBy(name).agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("agreement"))
        whole = binned.agg(F.abs(F.corr(name, value)).alias("strength"), (F.max(name) - F.min(name)).alias("all"))
        best = top.agg(steady(F.stddev_samp(name), F.avg(name)).alias("focus"), (F.max(name) - F.min(name)).alias("span"))
        row = levels.crossJoin(modal).crossJoin(whole).crossJoin(best)
        row = row.select(F.lit(name).alias("parameter"), "level", "focus", "agreement", "strength", F.try_divide("span", "all").alias("span"))
        out = row if out is None else out.unionByName(row)
    return out


def tree_importance(trials: DataFrame, names: list[str], value: str = "score", depth: int = 4, least: int = 20) -> DataFrame:
    """(parameter, importance) of a regression tree over the trials; zero for all with fewer than ``least``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    spark, found = trials.sparkSession, [0.0] * len(names)
    if trials.count() >= least:
        rows = VectorAssembler(inputCols=names, outputCol="_x").transform(trials)
        model = DecisionTreeRegressor(featuresCol="_x", labelCol=value, maxDepth=depth, seed=7).fit(rows)
        found = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, found, strict=True)], "parameter string, importance double")


_INF = math.inf
#: The edges of the usual analyses of an indicator.
PRESETS = {
    "rsi": [float(k) for k in range(0, 101, 10)],
    "gap": [-_INF, -1.0, -0.5, -0.2, 0.0, 0.2, 0.5, 1.0, _INF],
    "gap_sigma": [-_INF, -2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, _INF],
    "vix": [0.0, 12.0, 15.0, 20.0, 25.0, 30.0, 40.0, _INF],
}


def preset_bin(value: Column, preset: str) -> Column:
    """Number of the preset's bin, from 0: below its upper edge, the last one closed; null outside."""
    edges = PRESETS[preset]
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        last = k == len(edges) - 2
        inside = (value >= edges[k]) & ((value <= edges[k + 1]) if last else (value < edges[k + 1]))
        out = F.when(inside, k).otherwise(out)
    return out


def percentile_bins(df: DataFrame, value: str, low: float = 0.1, high: float = 0.9, n: int = 15) -> DataFrame:
    """``bin`` of equal width between two percentiles; what lies beyond them is in the first or last."""
    ends = df.agg(F.percentile(value, low).alias("_lo"), F.percentile(value, high).alias("_hi"))
    at = F.floor(F.try_divide(c(value) - c("_lo"), c("_hi") - c("_lo")) * n)
    return df.crossJoin(F.broadcast(ends)).withColumn("bin", F.greatest(F.least(at, F.lit(n - 1)), F.lit(0)).cast("int")).drop("_lo", "_hi")


def minmax(value: Column, inverted: bool = False, *keys: str) -> Column:
    """A value's place between the least and the largest, constants in the middle."""
    w = Window.partitionBy(*keys)
    share = F.coalesce(F.try_divide(value - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)), F.lit(0.5))
    return 1 - share if inverted else share


def blended(median: Column, p25: Column, fallback: Column, weights: tuple[float, float] = (0.6, 0.4)) -> Column:
    """Weighted mean of median and lower quartile; where one is missing the other, and else the fallback."""
    a, b = weights
    return F.coalesce((a * median + b * p25) / (a + b), median, p25, fallback)


def soft_penalty(value: Column, floor: float, softness: float) -> Column:
    """1 from the floor on, and less the farther a value falls below it; nothing for what is missing."""
    return F.coalesce(F.exp(-F.greatest(F.lit(0.0), floor - value) / softness), F.lit(0.0))


def near_threshold(votes: DataFrame, count: str, least: int, band: int) -> DataFrame:
    """Rows whose count is within ``band`` of the least."""
    return votes.where(F.abs(c(count) - least) <= band)


def filled(df: DataFrame, names: list[str], key: str, order: str) -> DataFrame:
    """Gaps filled by the value before, else the one after, else the column's median."""
    back = Window.partitionBy(key).orderBy(order)
    medians = df.agg(*(F.median(n).alias(f"_m_{n}") for n in names))
    before, after = back.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(0, Window.unboundedFollowing)
    value = lambda n: F.coalesce(F.last(n, ignorenulls=True).over(before), F.first(n, ignorenulls=True).over(after), c(f"_m_{n}"))
    return df.crossJoin(F.broadcast(medians)).withColumns({n: value(n) for n in names}).drop(*medians.columns)


def combined_p_values(tests: DataFrame, p: str, *keys: str) -> DataFrame:
    """Fisher's, Pearson's and Stouffer's statistics over the valid p-values of each key, and Fisher's and Pearson's p-value.

    The chi-squared tail with an even number of degrees of freedom is a finite sum.
    """
    valid = tests.where((c(p) >= 0) & (c(p) <= 1)).withColumn("_p", F.greatest(F.least(c(p), F.lit(1 - 1e-12)), F.lit(1e-12)))
    g = valid.groupBy(*keys).agg(F.count("*").alias("n"), (-2 * F.sum(F.log("_p"))).alias("fisher"), (-2 * F.sum(F.log1p(-c("_p")))).alias("pearson"))

    def tail(x: Column) -> Column:
        half = x / 2
        term = F.aggregate(
            F.sequence(F.lit(0), c("n").cast("int") - 1), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
            lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * half / (i + 1)).alias("term")),
        )
        return F.exp(-half) * term["sum"]

    return g.withColumns({"fisher_p": tail(c("fisher")), "pearson_p": 1 - tail(c("pearson"))})


def gate_sweep(trades: DataFrame, probability: str, gates: list[float], pnl: str, *keys: str) -> DataFrame:
    """Trades, wins, mean and sum of results of what each gate lets through, and of all (gate null)."""
    passed = F.concat(F.array(F.lit(None).cast("double")), F.filter(F.array(*map(F.lit, gates)), lambda g: c(probability) >= g))
    rows = trades.withColumn("gate", F.explode(passed))
    g = rows.groupBy(*keys, "gate").agg(F.count("*").alias("n"), F.avg((c(pnl) > 0).cast("double")).alias("win_rate"), F.avg(pnl).alias("mean"), F.sum(pnl).alias("total"))
    return g


def session_heatmap(trades: DataFrame, time: str, value: str) -> DataFrame:
    """(weekday, month, n, mean, smooth): mean of a value by weekday and month, and the mean of the cells around each."""
    g = trades.groupBy(F.weekday(time).alias("weekday"), F.month(time).alias("month")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    other = g.select(c("weekday").alias("_d"), c("month").alias("_m"), c("mean").alias("_v"))
    # twelve months of seven days, whatever the trades
    near = g.join(F.broadcast(other), (F.abs(c("weekday") - c("_d")) <= 1) & (F.abs(c("month") - c("_m")) <= 1))
    return near.groupBy("weekday", "month", "n", "mean").agg(F.avg("_v").alias("smooth"))


def with_reference(ranked: DataFrame, reference: DataFrame, key: str, value: str, top: int = 20) -> DataFrame:
    """``ranked`` (with ``rank``) and, for the first ``top``, the value that ``reference`` gives their key as ``reference``."""
    found = reference.select(c(key).alias("_key"), c(value).alias("_value"))
    joined = ranked.join(found, (c(key) == c("_key")) & (c("rank") <= top), "left")
    return joined.withColumn("reference", c("_value")).drop("_key", "_value")

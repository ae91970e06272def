"""Is the best of many strategies better than luck: the reality check and its studentised form over (strategy, time).

Stationary bootstraps are numbers of times that each time is drawn: a matrix of replicates by times that every task makes from the
seed. Strategies are dealt into blocks; a task has all times of its block, works out the replicates' means as one product, and
sends the greatest statistic of its block for every replicate. The greatest of those are merged by an aggregate, so that the driver sees
one row per replicate, however many strategies there are.

Statistics (Hansen): the root of the number of times by the mean over its deviation, at least 0; replicates are recentred by
the mean (upper p-value), by its positive part (lower), or by the mean unless it lies too far below zero (consistent). The plain check (White)
is not divided by deviations and recentres by the mean. The deviation is that of the replicates' means.

Values at missing times, and nulls, count as 0. Strategies without spread have no say. Repeated rows of one strategy and time are added.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.simulation import stationary_indices

c = F.col
KINDS = ("plain", "lower", "consistent", "upper")


def replicate_weights(times: int, replicates: int, block: float, seed: int) -> np.ndarray:
    """How often each time is drawn in each replicate, over the number of times."""
    out = np.empty((replicates, times))
    for b in range(replicates):
        rng = np.random.default_rng([seed, b])
        out[b] = np.bincount(stationary_indices(rng, times, times, block), minlength=times)
    return out / times


def block_maxima(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(observed, replicates): the greatest statistic of the columns of ``x`` by kind, as it is and of every replicate."""
    n = len(x)
    keep = x.std(axis=0) > 0
    if not keep.any():
        return np.full(len(KINDS), -np.inf), np.full((len(weights), len(KINDS)), -np.inf)
    x = x[:, keep]
    mean, drawn = x.mean(axis=0), weights @ x
    deviation = math.sqrt(n) * drawn.std(axis=0)
    deviation = np.where(deviation > 0, deviation, np.inf)
    far = mean < -deviation / math.sqrt(n) * math.sqrt(2 * math.log(max(math.log(max(n, 3)), 1.0)))
    centres = {"lower": np.maximum(mean, 0), "consistent": np.where(far, 0.0, mean), "upper": mean}
    studentised = math.sqrt(n) * float((mean / deviation).max())
    observed = np.array([math.sqrt(n) * float(mean.max()), *[max(studentised, 0.0)] * 3])
    found = [math.sqrt(n) * (drawn - mean).max(axis=1)]
    found += [np.maximum(math.sqrt(n) * ((drawn - centres[k]) / deviation).max(axis=1), 0) for k in KINDS[1:]]
    return observed, np.column_stack(found)


def p_values(observed: np.ndarray, replicates: np.ndarray) -> dict[str, float]:
    return {k: float((replicates[:, i] >= observed[i]).mean()) for i, k in enumerate(KINDS)}


def array_check(x: np.ndarray, replicates: int = 2000, block: float = 10.0, seed: int = 7) -> dict[str, float]:
    """P-values of one array of times by strategies."""
    return p_values(*block_maxima(x, replicate_weights(len(x), replicates, block, seed)))


def reality_check(performance: DataFrame, replicates: int = 2000, block: float = 10.0, per_task: int = 200, seed: int = 7) -> DataFrame:
    """One row (strategies, times, plain, lower, consistent, upper): p-values that the best of (strategy, ts, value) beats zero by luck."""
    spark = performance.sparkSession
    # a calendar: one row per time
    calendar = performance.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    times = calendar.count()
    strategies = performance.select("strategy").distinct().count()
    schema = "strategies long, times long, " + ", ".join(f"{k} double" for k in KINDS)
    if not times:
        return spark.createDataFrame([], schema)
    blocks = max(1, math.ceil(strategies / per_task))
    rows = performance.join(calendar, "ts").select("strategy", "i", F.coalesce(c("value").cast("double"), F.lit(0.0)).alias("value"), F.pmod(F.xxhash64("strategy"), F.lit(blocks)).alias("block"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, _ = pd.factorize(pdf["strategy"], sort=True, use_na_sentinel=False)
        x = np.zeros((times, codes.max() + 1))
        np.add.at(x, (pdf["i"].to_numpy(), codes), pdf["value"].to_numpy())
        observed, found = block_maxima(x, replicate_weights(times, replicates, block, seed))
        out = pd.DataFrame(np.vstack([observed, found]), columns=list(KINDS))
        out.insert(0, "replicate", np.arange(-1, replicates))
        return out

    found = rows.groupBy("block").applyInPandas(work, "replicate int, " + ", ".join(f"{k} double" for k in KINDS))
    top = found.groupBy("replicate").agg(*(F.max(k).alias(k) for k in KINDS)).toPandas().set_index("replicate")
    p = p_values(top.loc[-1].to_numpy(), top.drop(-1).to_numpy())
    return spark.createDataFrame([(strategies, times, *(p[k] for k in KINDS))], schema)

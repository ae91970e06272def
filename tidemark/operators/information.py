"""Entropy and dependence: histograms as aggregates, pairwise measures as one grouped pass."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import risk

c = F.col


def uniform_bin(x: str, n: int, *keys: str) -> Column:
    """Equal-width bin of a value between its key's minimum and maximum; constants are bin 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.coalesce(F.least(F.floor(F.try_divide(c(x) - low, high - low) * n), F.lit(n - 1)), F.lit(0)).cast("int")


def ranged_bin(df: DataFrame, x: str, n: int, *keys: str) -> DataFrame:
    """The same bins by a join with the ranges, for keys too large for a window."""
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.least(F.floor(F.try_divide(c(x) - c("_lo"), c("_hi") - c("_lo")) * n), F.lit(n - 1))
    return df.join(ends, list(keys)).withColumn("bin", F.coalesce(at, F.lit(0)).cast("int")).drop("_lo", "_hi")


def entropy(binned: DataFrame, *keys: str) -> DataFrame:
    """Shannon entropy in bits of ``bin`` per key."""
    n = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("all"), F.sum(c("n") * F.log2("n")).alias("s"))
    return total.select(*keys, (F.log2("all") - c("s") / c("all")).alias("entropy"))


def mutual_information(features: DataFrame, bins: int = 5) -> DataFrame:
    """(i, j, mi, nmi, corr) of all pairs of features of a long table (id, feature, value)."""
    b = ranged_bin(features, "value", bins, "feature").select("id", "feature", "bin", "value")
    h = entropy(b, "feature")
    left = b.select("id", c("feature").alias("i"), c("bin").alias("p"), c("value").alias("x"))
    right = b.select("id", c("feature").alias("j"), c("bin").alias("q"), c("value").alias("y"))
    both = left.join(right, "id").where("i < j")
    sums = {"n": F.count("*"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(c("x") * c("x")), "syy": F.sum(c("y") * c("y")), "sxy": F.sum(c("x") * c("y"))}
    cells = both.groupBy("i", "j", "p", "q").agg(*(v.alias(k) for k, v in sums.items()))
    g = cells.groupBy("i", "j").agg(F.sum(c("n") * F.log2("n")).alias("s"), *(F.sum(k).alias(k) for k in sums))
    g = g.withColumn("joint", F.log2("n") - c("s") / c("n"))
    cov = c("n") * c("sxy") - c("sx") * c("sy")
    corr = cov / F.sqrt((c("n") * c("sxx") - c("sx") * c("sx")) * (c("n") * c("syy") - c("sy") * c("sy")))
    hx, hy = h.select(c("feature").alias("i"), c("entropy").alias("hx")), h.select(c("feature").alias("j"), c("entropy").alias("hy"))
    g = g.join(hx, "i").join(hy, "j").withColumn("mi", F.greatest(c("hx") + c("hy") - c("joint"), F.lit(0.0)))
    return g.select("i", "j", "mi", F.try_divide(2 * c("mi"), c("hx") + c("hy")).alias("nmi"), corr.alias("corr"))


def vector_information(vectors: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """(i, j, mi, nmi, corr) of all pairs of places of a vector column.

    A place's values fall into equal bins of its range; the counts of all pairs of bins are one matrix of
    products of indicators per task, summed.
    """
    n, _, low, high = risk.vector_ends(vectors, column)
    width = np.where(high > low, high - low, 1.0)

    def indicators(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.floor((x - low) / width * bins), bins - 1).astype(np.int64)
        out = np.zeros((len(x), x.shape[1] * bins))
        out[np.arange(len(x))[:, None], np.arange(x.shape[1]) * bins + at] = 1
        return out

    cells = risk.gram(vectors, column, indicators).select((c("i") / bins).cast("int").alias("i"), (c("j") / bins).cast("int").alias("j"), "s")
    joint = cells.groupBy("i", "j").agg((F.log2(F.lit(float(max(n, 1)))) - F.sum(c("s") * F.log2("s")) / n).alias("joint"))
    # a place's entropy is the joint one with itself
    own = joint.where("i = j").select(c("i").alias("k"), c("joint").alias("h"))
    pairs = joint.where("i < j").join(own.select(c("k").alias("i"), c("h").alias("hx")), "i").join(own.select(c("k").alias("j"), c("h").alias("hy")), "j")
    pairs = pairs.withColumn("mi", F.greatest(c("hx") + c("hy") - c("joint"), F.lit(0.0)))
    corr = risk.vector_correlation(vectors, column)
    return pairs.join(corr, ["i", "j"]).select("i", "j", "mi", F.try_divide(2 * c("mi"), c("hx") + c("hy")).alias("nmi"), "corr")


def kl_divergence(p: np.ndarray, q: np.ndarray, epsilon: float = 1e-10) -> float:
    p, q = (p + epsilon) / (p + epsilon).sum(), (q + epsilon) / (q + epsilon).sum()
    return float((p * np.log(p / q)).sum())


def jensen_shannon(p: np.ndarray, q: np.ndarray, base: float = 2.0) -> float:
    """The square root of the divergence from the mixture: a distance."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log(a[a > 0] / m[a > 0])).sum())
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2 / math.log(base)))


def _bits(*labels: np.ndarray) -> float:
    _, n = np.unique(np.column_stack(labels), axis=0, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def quantile_bin(x: np.ndarray, n: int = 5) -> np.ndarray:
    return np.searchsorted(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]), x, side="right")


def transfer_entropy(source: np.ndarray, target: np.ndarray, lag: int = 1, bins: int = 5) -> float:
    """Bits that the source's past adds to the target's own past about its present."""
    now, past, other = (quantile_bin(x, bins) for x in (target[lag:], target[:-lag], source[:-lag]))
    return max(0.0, _bits(now, past) + _bits(past, other) - _bits(past) - _bits(now, past, other))


def discrete_mi(x: np.ndarray, y: np.ndarray, bins: int = 5) -> float:
    def cut(v: np.ndarray) -> np.ndarray:
        width = v.max() - v.min()
        return np.minimum(((v - v.min()) / width * bins).astype(int), bins - 1) if width else np.zeros(len(v), int)

    a, b = cut(x), cut(y)
    return max(0.0, _bits(a) + _bits(b) - _bits(a, b))


def rolling_pairs(returns: DataFrame, pairs: DataFrame, n: int = 252, stride: int = 20) -> DataFrame:
    """Mutual information, correlation and transfer entropy of given pairs of assets over rolling windows: a task per pair."""
    left = returns.select("ts", c("asset").alias("a"), c("ret").alias("x"))
    right = returns.select("ts", c("asset").alias("b"), c("ret").alias("y"))
    both = pairs.join(left, "a").join(right, ["b", "ts"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        x, y, out = pdf["x"].to_numpy(), pdf["y"].to_numpy(), []
        for end in range(n, len(x) + 1, stride):
            u, v = x[end - n : end], y[end - n : end]
            out.append((pdf["a"].iloc[0], pdf["b"].iloc[0], pdf["ts"].iloc[end - 1], discrete_mi(u, v), float(np.corrcoef(u, v)[0, 1]), transfer_entropy(u, v), transfer_entropy(v, u)))
        return pd.DataFrame(out, columns=["a", "b", "ts", "mi", "corr", "te_ab", "te_ba"])

    return both.groupBy("a", "b").applyInPandas(work, "a string, b string, ts timestamp, mi double, corr double, te_ab double, te_ba double")


def rank_share(x: str, *keys: str) -> Column:
    """Average rank over the number of rows, as ranks with ties have it."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return (F.rank().over(w.orderBy(x)) + (ties - 1) / 2) / F.count("*").over(w)


def rank_gaussian(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """Values replaced by the normal quantile of their rank."""
    d = NormalDist()
    share = df.withColumn("_p", F.greatest(F.least(rank_share(x, *keys), F.lit(1 - 1e-6)), F.lit(1e-6)))

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return p.map(d.inv_cdf)

    return share.withColumn("gauss", quantile("_p")).drop("_p")


def _digamma(n: np.ndarray) -> np.ndarray:
    """Digamma of positive whole numbers: harmonic numbers less Euler's constant."""
    table = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, int(n.max()) + 1))))
    return table[n.astype(int) - 1] - 0.5772156649015329


def knn_mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 7, rows: int = 2000) -> float:
    """Nearest-neighbour mutual information in nats (Kraskov and others), on at most ``rows`` rows drawn by the seed.

    Distances of all pairs are held, hence the bound; ties are broken by noise far below the data's scale.
    """
    rng = np.random.default_rng(seed)
    if len(x) > rows:
        pick = rng.choice(len(x), rows, replace=False)
        x, y = x[pick], y[pick]
    scale = lambda v: (v - v.mean()) / (v.std() or 1.0) + 1e-10 * rng.standard_normal(len(v))
    x, y = scale(x), scale(y)
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    reach = np.partition(joint, k - 1, axis=1)[:, k - 1]
    nx, ny = (dx < reach[:, None]).sum(axis=1), (dy < reach[:, None]).sum(axis=1)
    n = np.array([len(x)])
    return max(0.0, float(_digamma(np.array([k]))[0] + _digamma(n)[0] - (_digamma(nx) + _digamma(ny)).mean()))

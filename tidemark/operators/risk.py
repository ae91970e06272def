"""Risk models: covariance as distributed aggregates, dense matrix work on its small result.

The long table of returns is reduced to one row per pair of assets by aggregates; only that N x N
matrix, whose size depends on the number of assets and not of rows, meets numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def clean_returns(returns: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """Returns without gaps: infinite ones count as missing; only times that every asset has stay, if at least
    ``least`` and ``share`` of all do, else all times stay and gaps are 0."""
    finite = returns.select("ts", "asset", F.when(F.abs("ret") < float("inf"), c("ret")).alias("ret"))
    assets = finite.select("asset").distinct()
    grid = finite.select("ts").distinct().crossJoin(F.broadcast(assets)).join(finite, ["ts", "asset"], "left")
    whole = grid.groupBy("ts").agg((F.count("ret") == F.count("*")).alias("_whole"))
    kept = whole.agg(F.sum(c("_whole").cast("int")).alias("_k"), F.count("*").alias("_n"))
    enough = c("_k") >= F.greatest(F.lit(least), share * c("_n"))
    rows = grid.join(whole, "ts").crossJoin(F.broadcast(kept)).where(c("_whole") | ~enough)
    return rows.select("ts", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def pairs(returns: DataFrame, complete: bool) -> DataFrame:
    """(ts, asset_i, asset_j, x, y) of equal times; where not ``complete`` only times both have.

    The assets of a time are one row, and their pairs are made inside it: rows move once.
    """
    whole = returns.groupBy("ts").agg(F.collect_list(F.struct("asset", "ret")).alias("all"))
    both = whole.select("ts", "all", F.explode("all").alias("a")).select("ts", "a", F.explode("all").alias("b"))
    joined = both.select("ts", c("a.asset").alias("asset_i"), c("b.asset").alias("asset_j"), c("a.ret").alias("x"), c("b.ret").alias("y"))
    return joined if complete else joined.where("x is not null and y is not null")


def sample_covariance(returns: DataFrame) -> DataFrame:
    """Missing returns as 0: sums of products over all times of the table."""
    times = returns.select("ts").distinct().count()
    sums = returns.groupBy("asset").agg(F.sum("ret").alias("s"))
    cross = pairs(returns, True).groupBy("asset_i", "asset_j").agg(F.sum(F.coalesce(c("x") * c("y"), F.lit(0.0))).alias("xy"))
    # assets that never meet still have a row
    grid = sums.select(c("asset").alias("asset_i"), c("s").alias("si")).crossJoin(sums.select(c("asset").alias("asset_j"), c("s").alias("sj")))
    full = grid.join(cross, ["asset_i", "asset_j"], "left")
    return full.select("asset_i", "asset_j", ((F.coalesce("xy", F.lit(0.0)) - c("si") * c("sj") / times) / (times - 1)).alias("cov"))


def pairwise_covariance(returns: DataFrame) -> DataFrame:
    """Each pair over the times that both assets have."""
    return pairs(returns, False).groupBy("asset_i", "asset_j").agg(F.covar_samp("x", "y").alias("cov"))


def ewma_covariance(returns: DataFrame, decay: float = 0.94, start: str = "sample") -> DataFrame:
    """Exponentially weighted: (1 - d) d^(m - 1 - i) on demeaned rows but the last, and d^m of the sample matrix.

    With ``start`` ``diagonal``, only the sample's variances begin.
    """
    if start not in ("sample", "diagonal"):
        raise ValueError(f"unknown start {start}")
    times = returns.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    n = times.count()
    means = returns.groupBy("asset").agg((F.sum("ret") / n).alias("mu"))
    full = times.crossJoin(means.select("asset", "mu")).join(returns, ["ts", "asset"], "left")
    x = full.select(c("i").alias("ts"), "asset", (F.coalesce("ret", F.lit(0.0)) - c("mu")).alias("ret"))
    products = pairs(x, True).select(c("ts").alias("i"), "asset_i", "asset_j", c("x").alias("p"), c("y").alias("q"))
    m = n - 1
    weight = F.when(c("i") < m, (1 - decay) * F.pow(F.lit(decay), m - 1 - c("i"))).otherwise(0.0)
    g = products.groupBy("asset_i", "asset_j").agg(F.sum(weight * c("p") * c("q")).alias("w"), (F.sum(c("p") * c("q")) / n).alias("s"))
    begun = F.when((c("asset_i") == c("asset_j")) | F.lit(start == "sample"), c("s")).otherwise(0.0)
    cov = c("w") + decay**m * begun
    return g.select("asset_i", "asset_j", F.when(c("asset_i") == c("asset_j"), F.greatest(cov, F.lit(1e-12))).otherwise(cov).alias("cov"))


def matrix(cov: DataFrame, value: str = "cov") -> tuple[list[str], np.ndarray]:
    """The dense matrix of a long one: as many cells as pairs of assets."""
    rows = cov.collect()
    names = sorted({r.asset_i for r in rows})
    at = {n: k for k, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r.asset_i], at[r.asset_j]] = r[value]
    return names, out


def long(spark, names: list[str], m: np.ndarray, value: str = "cov") -> DataFrame:
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, f"asset_i string, asset_j string, {value} double")


def correlation(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    out = np.clip(cov / np.outer(d, d), -1, 1)
    np.fill_diagonal(out, 1.0)
    return out


def project_correlation(r: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """The correlation matrix with eigenvalues clipped from below and the diagonal set back to one."""
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    m = (vectors * np.maximum(values, floor)) @ vectors.T
    return np.clip(correlation(m), -1, 1)


def shift_to_psd(m: np.ndarray, tolerance: float = 1e-10, jitter: float = 1e-10) -> np.ndarray:
    least = float(np.linalg.eigvalsh((m + m.T) / 2)[0])
    return m if least >= -tolerance else m + (jitter - least) * np.eye(len(m))


def minimise(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 0.1, rounds: int = 400) -> np.ndarray:
    """Nelder and Mead's simplex search: reflect, expand, contract, shrink."""
    n = len(x)
    points = [x, *(x + step * np.eye(n)[k] * np.maximum(abs(x[k]), 1.0) for k in range(n))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] < 1e-10 * (abs(values[0]) + 1e-10):
            break
        centre = np.mean(points[:-1], axis=0)
        try_at = lambda k: (p := centre + k * (points[-1] - centre), f(p))
        p, v = try_at(-1.0)
        if v < values[0]:
            q, w = try_at(-2.0)
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            q, w = try_at(-0.5 if v < values[-1] else 0.5)
            if w >= min(v, values[-1]):
                points = [points[0], *((points[0] + q0) / 2 for q0 in points[1:])]
                values = [values[0], *(f(q0) for q0 in points[1:])]
                continue
            p, v = q, w
        points[-1], values[-1] = p, v
    return points[int(np.argmin(values))]


def garch_variance(x: np.ndarray, horizon: int = 1) -> float:
    """Forecast of the mean variance over ``horizon`` steps by GARCH(1,1); few rows: the sample variance."""
    x = x - x.mean()
    var = float(x.var(ddof=1)) if len(x) > 1 else 0.0
    if len(x) < 20 or var <= 0:
        return max(var, 1e-12)
    sq = x * x

    def unpack(p: np.ndarray) -> tuple[float, float, float]:
        total = 0.999 / (1 + math.exp(-p[0]))
        a = total / (1 + math.exp(-p[1]))
        return var * (1 - total) * math.exp(min(max(p[2], -3), 3)), a, total - a

    def path(w: float, a: float, b: float) -> np.ndarray:
        out = np.empty(len(sq) + 1)
        h = out[0] = var
        for i, s in enumerate(sq.tolist()):
            h = out[i + 1] = w + a * s + b * h
        return out

    def loss(p: np.ndarray) -> float:
        h = np.maximum(path(*unpack(p))[:-1], 1e-18)
        return float(0.5 * (np.log(h) + sq / h).mean())

    w, a, b = unpack(minimise(loss, np.array([3.0, -2.0, 0.0]), rounds=120))
    last, level = float(path(w, a, b)[-1]), w / max(1 - a - b, 1e-6)
    steps = np.arange(horizon)
    return float(np.mean(level + (a + b) ** steps * (last - level)))


def garch_covariance(returns: DataFrame, horizon: int = 21) -> DataFrame:
    """Forecast variances, one task per asset, around the sample correlation made positive definite."""

    def forecast(pdf):
        x = pdf.sort_values("ts")["ret"].fillna(0.0).to_numpy()
        return pdf.iloc[:1][["asset"]].assign(variance=garch_variance(x, horizon))

    variances = {r.asset: r.variance for r in returns.groupBy("asset").applyInPandas(forecast, "asset string, variance double").collect()}
    names, cov = matrix(sample_covariance(returns))
    d = np.sqrt([variances[n] for n in names])
    return long(returns.sparkSession, names, project_correlation(correlation(cov)) * np.outer(d, d))


def marchenko_pastur(cov: np.ndarray, rows: int) -> np.ndarray:
    """Noise eigenvalues of the correlation (below the Marchenko-Pastur edge) replaced by their mean."""
    d = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    values, vectors = np.linalg.eigh(correlation(cov))
    edge = (1 + math.sqrt(len(cov) / rows)) ** 2
    noise = values < edge
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    return correlation((vectors * values) @ vectors.T) * np.outer(d, d)


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear shrinkage towards a multiple of the identity, with the optimal intensity."""
    x = x - x.mean(axis=0)
    return shrunk(x.T @ x, (x**2).T @ (x**2), len(x))


def shrunk(products: np.ndarray, squares: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The same from the sums of products of centred rows, and of their squares."""
    p, s = len(products), products / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min((squares / n - s**2).sum() / (p * n), delta)
    k = beta / delta if delta > 0 else 0.0
    return (1 - k) * s + k * mu * np.eye(p), float(k)


def denoise(cov: np.ndarray, x: np.ndarray, method: str = "marchenko_pastur") -> np.ndarray:
    if method == "auto":
        method = "shrinkage" if len(cov) < 10 or len(x) / len(cov) < 2 else "marchenko_pastur"
    return ledoit_wolf(x)[0] if method == "shrinkage" else marchenko_pastur(cov, len(x))


def sample_matrix(x: np.ndarray) -> np.ndarray:
    return np.atleast_2d(np.cov(np.nan_to_num(x), rowvar=False))


def pairwise_matrix(x: np.ndarray) -> np.ndarray:
    """Each pair over the rows that both columns have; pairs without two such rows as 0."""
    known = ~np.isnan(x)
    z, k = np.where(known, x, 0.0), known.astype(np.float64)
    n = k.T @ k
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = (z.T @ z - (z.T @ k) * (k.T @ z) / n) / (n - 1)
    return np.where(n > 1, cov, 0.0)


def ewma_matrix(x: np.ndarray, decay: float = 0.94, start: str = "sample") -> np.ndarray:
    """``ewma_covariance`` on a matrix of rows in time."""
    z = np.nan_to_num(x)
    z = z - z.mean(axis=0)
    n = len(z)
    weight = np.append((1 - decay) * decay ** np.arange(n - 2, -1, -1.0), 0.0)
    begun = z.T @ z / n
    begun = np.diag(np.diag(begun)) if start == "diagonal" else begun
    cov = (z * weight[:, None]).T @ z + decay ** (n - 1) * begun
    np.fill_diagonal(cov, np.maximum(np.diag(cov), 1e-12))
    return cov


def garch_matrix(x: np.ndarray, horizon: int = 21) -> np.ndarray:
    """Variances of the horizon by a model per column, under the pairwise correlation."""
    sd = np.sqrt([garch_variance(col, horizon) for col in np.nan_to_num(x).T])
    return project_correlation(correlation(pairwise_matrix(x))) * np.outer(sd, sd)


#: Risk models on rows in time by assets, with gaps as nan.
MODELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"sample": sample_matrix, "pairwise": pairwise_matrix, "ewma": ewma_matrix, "garch": garch_matrix}


def estimate(x: np.ndarray, model: str = "sample", denoising: str | None = None, psd: bool = True) -> np.ndarray:
    """Covariance of the columns of ``x`` by a risk model, shifted to be positive and denoised where asked."""
    cov = MODELS[model](x)
    cov = shift_to_psd(cov) if psd else cov
    return denoise(cov, np.nan_to_num(x), denoising) if denoising else cov


@dataclass(frozen=True)
class Clusters:
    members: list[list[int]]
    score: float


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Agglomeration by mean distance: (a, b, height, size) per step, new clusters numbered on from n."""
    n = len(distance)
    live = {k: [k] for k in range(n)}
    out = []
    while len(live) > 1:
        keys = sorted(live)
        h, a, b = min((distance[np.ix_(live[i], live[j])].mean(), i, j) for x, i in enumerate(keys) for j in keys[x + 1 :])
        live[n + len(out)] = live.pop(a) + live.pop(b)
        out.append((a, b, float(h), len(live[n + len(out)])))
    return out


def cut_tree(link: list[tuple[int, int, float, int]], n: int, k: int) -> list[list[int]]:
    live = {i: [i] for i in range(n)}
    for step, (a, b, *_) in enumerate(link[: n - k]):
        live[n + step] = live.pop(a) + live.pop(b)
    return sorted(sorted(m) for m in live.values())


def silhouettes(distance: np.ndarray, members: list[list[int]]) -> np.ndarray:
    out = np.zeros(len(distance))
    for g in members:
        for i in g:
            own = [j for j in g if j != i]
            if own and len(members) > 1:
                a = distance[i, own].mean()
                b = min(distance[i, h].mean() for h in members if h is not g)
                out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def correlation_distance(r: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip((1 - np.nan_to_num(r)) / 2, 0, 1))


def onc(r: np.ndarray) -> Clusters:
    """Average linkage on the correlation distance, cut at the k (up to the root of n) of best silhouette."""
    d = correlation_distance(r)
    np.fill_diagonal(d, 0.0)
    link, n = average_linkage(d), len(d)
    best = Clusters([list(range(n))], -1.0)
    for k in range(2, max(2, int(math.sqrt(n))) + 1):
        if k <= n:
            members = cut_tree(link, n, k)
            score = float(silhouettes(d, members).mean())
            best = Clusters(members, score) if score > best.score else best
    return best


def feature_silhouettes(r: np.ndarray, clusters: Clusters | None = None) -> list[tuple[int, int, float]]:
    found = clusters or onc(r)
    s = silhouettes(correlation_distance(r), found.members)
    return [(i, k, float(s[i])) for k, g in enumerate(found.members) for i in g]


def pca(x: np.ndarray, standardise: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, vectors by column, shares of variance), largest first."""
    x = x - x.mean(axis=0)
    if standardise:
        x = x / np.where(x.std(axis=0, ddof=1) == 0, 1, x.std(axis=0, ddof=1))
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    order = np.argsort(-values)
    values = np.maximum(values[order], 0)
    return values, vectors[:, order], values / values.sum()


def pca_keep(x: np.ndarray, variance: float = 0.02, loading: float = 0.3) -> np.ndarray:
    """Features that load by at least ``loading`` on some component with at least that share of variance."""
    _, vectors, share = pca(x)
    return (np.abs(vectors[:, share >= variance]) >= loading).any(axis=1)


def retained(x: np.ndarray, kept: np.ndarray) -> float:
    """Mean share of the features' variance that the kept ones explain linearly."""
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    if not kept.any():
        return 0.0
    beta, *_ = np.linalg.lstsq(z[:, kept], z, rcond=None)
    return float(1 - ((z - z[:, kept] @ beta) ** 2).mean())


def pca_remove(x: np.ndarray, variance: float = 0.02, loading: float = 0.3) -> list[int]:
    """The features that ``pca_keep`` leaves out."""
    return np.flatnonzero(~pca_keep(x, variance, loading)).tolist()


def pca_thresholds(x: np.ndarray, variances: list[float], loadings: list[float], least: float = 0.9) -> list[dict[str, float]]:
    """Pairs of thresholds, the best first: those that retain ``least`` by what they retain per feature kept, then the others by what they retain."""
    rows = []
    for v in variances:
        for l in loadings:
            kept = pca_keep(x, v, l)
            part = retained(x, kept)
            rows.append({"variance": v, "loading": l, "kept": int(kept.sum()), "retained": part, "efficiency": part * len(kept) / max(int(kept.sum()), 1)})
    return sorted(rows, key=lambda r: (r["retained"] < least, -r["efficiency"] if r["retained"] >= least else -r["retained"], r["kept"]))


def correlation_long(features: DataFrame) -> DataFrame:
    """Correlations of all pairs of features of a long table (id, feature, value), as one aggregate."""
    a = features.select("id", c("feature").alias("i"), c("value").alias("x"))
    b = features.select("id", c("feature").alias("j"), c("value").alias("y"))
    return a.join(b, "id").groupBy("i", "j").agg(F.corr("x", "y").alias("corr"))


def component_loadings(corr: DataFrame, most: int = 10) -> DataFrame:
    """(component, rank, feature, loading, share): the features that load most on each component of a long correlation matrix (i, j, corr)."""
    names, m = matrix(corr.select(c("i").alias("asset_i"), c("j").alias("asset_j"), c("corr").alias("cov")))
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values, kind="stable")
    rows = []
    for k, col in enumerate(order.tolist()):
        v = vectors[:, col] * (1 if vectors[np.abs(vectors[:, col]).argmax(), col] >= 0 else -1)
        top = np.argsort(-np.abs(v), kind="stable")[:most]
        rows += [(k + 1, place + 1, int(names[j]), float(v[j]), float(values[col] / values.sum())) for place, j in enumerate(top.tolist())]
    return corr.sparkSession.createDataFrame(rows, "component int, rank int, feature int, loading double, share double")


def project(vectors: DataFrame, column: str, corr: np.ndarray, mean: np.ndarray, sd: np.ndarray, components: int) -> DataFrame:
    """``vectors`` with ``scores``: places on the first components of the correlation, batch by batch."""
    values, axes = np.linalg.eigh(corr)
    axes = axes[:, np.argsort(-values, kind="stable")[:components]]

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.vstack(x.to_numpy()) - mean) / sd @ axes)) if len(x) else pd.Series([], dtype=object)

    return vectors.withColumn("scores", scores(c(column).cast("array<double>")))


def cohesion(corr: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n, cohesion, weight): mean correlation of a cluster's pairs, and its share of squared sizes.

    ``corr`` is long (i, j, corr), ``clusters`` holds (feature, cluster); a cluster of one coheres fully.
    """
    a, b = clusters.select(c("feature").alias("i"), "cluster"), clusters.select(c("feature").alias("j"), c("cluster").alias("_other"))
    inside = corr.where("i < j").join(a, "i").join(b, "j").where("cluster = _other").groupBy("cluster").agg(F.avg("corr").alias("cohesion"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n")).join(inside, "cluster", "left")
    square = c("n") * c("n")
    return sizes.select("cluster", "n", F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"), (square / F.sum(square).over(Window.partitionBy())).alias("weight"))


def cohesion_loss(x: np.ndarray, members: list[list[int]], repeats: int = 20, seed: int = 7) -> list[tuple[int, int, float]]:
    """(feature, cluster, loss): how far a cluster's mean correlation falls when one of its features is shuffled."""
    rng, z = np.random.default_rng(seed), (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    out = []
    for k, own in enumerate(members):
        if len(own) < 2:
            out += [(j, k, 0.0) for j in own]
            continue
        pairs = len(own) * (len(own) - 1) / 2
        for j in own:
            others = [i for i in own if i != j]
            real = float((z[:, others].T @ z[:, j]).sum()) / len(z)
            shuffled = [float((z[:, others].T @ z[rng.permutation(len(z)), j]).sum()) / len(z) for _ in range(repeats)]
            out.append((j, k, (real - float(np.mean(shuffled))) / pairs))
    return out


def detone(r: np.ndarray, rows: int, market: int = 1) -> np.ndarray:
    """A correlation without its noise: eigenvalues within the edge of chance count as nothing, nor do the ``market`` first."""
    values, vectors = np.linalg.eigh(r)
    edge = (1 + math.sqrt(len(r) / rows)) ** 2
    kept = np.where(values > edge, values, 0.0)
    kept[len(r) - market :] = 0.0
    m = (vectors * kept) @ vectors.T + np.diag(1e-9 + np.zeros(len(r)))
    m += np.diag(np.maximum(1 - np.diag(m), 0.0))
    return correlation(m)


def redundant(silhouettes: DataFrame, threshold: float = 0.25, share: float = 0.2, least: int = 2) -> DataFrame:
    """Features (feature, cluster, silhouette) to remove: below the threshold or in a cluster's lowest share, while ``least`` stay."""
    best = Window.partitionBy("cluster").orderBy(F.desc("silhouette"), "feature")
    n = F.count("*").over(Window.partitionBy("cluster"))
    ranked = silhouettes.withColumns({"_best": F.row_number().over(best), "_n": n})
    poor = (c("silhouette") < threshold) | (c("_best") > F.ceil(c("_n") * (1 - share)))
    return ranked.where(poor & (c("_best") > least)).drop("_best", "_n")


def gram(vectors: DataFrame, column: str, prepare: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """(i, j, s): sums of products of all pairs of columns of the prepared vectors.

    Each task multiplies its own rows batch by batch and gives one matrix; only matrices, whose size is
    that of a vector squared, are shuffled and summed. Null vectors are left out; all others are of one length.
    """

    def work(batches):
        total = None
        for batch in batches:
            rows = batch.column(0)
            if len(rows):
                x = prepare(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    parts = vectors.where(c(column).isNotNull()).select(c(column).cast("array<double>").alias("x")).mapInArrow(work, "i int, j int, s double")
    return parts.groupBy("i", "j").agg(F.sum("s").alias("s"))


def vector_ends(vectors: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of vectors and, per place, mean, least and largest value: one row per task, summed here."""

    def work(batches):
        n, ends = 0, None
        for batch in batches:
            rows = batch.column(0)
            if len(rows):
                x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                here = np.array([x.sum(axis=0), x.min(axis=0), x.max(axis=0)])
                ends = here if ends is None else np.array([ends[0] + here[0], np.minimum(ends[1], here[1]), np.maximum(ends[2], here[2])])
                n += len(rows)
        if n:
            k = np.arange(ends.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(np.full(len(k), n), pa.int64()), *map(pa.array, ends)], ["i", "n", "s", "lo", "hi"])

    rows = vectors.where(c(column).isNotNull()).select(c(column).cast("array<double>").alias("x")).mapInArrow(work, "i int, n long, s double, lo double, hi double")
    found = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    n = found[0].n if found else 0
    return n, *(np.array([r[k] for r in found]) for k in ("s", "lo", "hi"))


def vector_correlation(vectors: DataFrame, column: str) -> DataFrame:
    """(i, j, corr) of all pairs of places of a vector column, from one matrix of products per task."""
    n, sums, _, _ = vector_ends(vectors, column)
    mean = sums / max(n, 1)
    s = gram(vectors, column, lambda x: x - mean)
    own = s.where("i = j").select(c("i").alias("k"), c("s").alias("own"))
    both = s.join(own.select(c("k").alias("i"), c("own").alias("si")), "i").join(own.select(c("k").alias("j"), c("own").alias("sj")), "j")
    return both.select("i", "j", (c("s") / F.sqrt(c("si") * c("sj"))).alias("corr"))


def rolling_top_eigenvalue(returns: DataFrame, n: int) -> DataFrame:
    """Largest eigenvalue, participation ratio and noise bound of the correlation over the last ``n`` days.

    One task per block of end days; a day goes to the blocks whose windows hold it.
    """
    days = returns.select(F.to_date("ts").alias("day")).distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    rows = returns.withColumn("day", F.to_date("ts")).join(days, "day").select("i", "day", "asset", "ret")
    span = F.sequence(F.floor(c("i") / n).cast("int"), F.floor((c("i") + n - 1) / n).cast("int"))
    dealt = rows.withColumn("block", F.explode(span))

    def work(pdf):
        block = int(pdf["block"].iloc[0])
        wide = pdf.pivot_table(index="i", columns="asset", values="ret", aggfunc="mean").fillna(0.0).sort_index()
        names = pdf.drop_duplicates("i").set_index("i")["day"]
        out = []
        for end in range(block * n, (block + 1) * n):
            x = wide.loc[end - n + 1 : end].to_numpy()
            if end in wide.index and len(x) == n:
                r = np.nan_to_num(np.corrcoef(x, rowvar=False))
                v = np.maximum(np.linalg.eigvalsh(r), 0)
                out.append((names[end], float(v[-1]), float(v.sum() ** 2 / (v**2).sum()), float((1 + math.sqrt(x.shape[1] / n)) ** 2)))
        import pandas as pd

        return pd.DataFrame(out, columns=["day", "top", "participation", "bound"])

    return dealt.groupBy("block").applyInPandas(work, "day date, top double, participation double, bound double")


def nonlinear_shrinkage(x: np.ndarray) -> np.ndarray:
    """Analytical nonlinear shrinkage of the sample eigenvalues (Ledoit and Wolf, 2020), for more rows than columns."""
    x = x - x.mean(axis=0)
    return nonlinear_of(x.T @ x, len(x))


def nonlinear_of(products: np.ndarray, rows: int) -> np.ndarray:
    """The same from the sums of products of centred rows."""
    n, p = rows - 1, len(products)
    values, vectors = np.linalg.eigh(products / n)
    values = np.maximum(values, 1e-18)
    width = n ** (-1 / 3)
    h = width * values[None, :]
    z = (values[:, None] - values[None, :]) / h
    # Epanechnikov density of the spectrum and its Hilbert transform
    density = (3 / (4 * math.sqrt(5)) * np.maximum(1 - z**2 / 5, 0) / h).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        edge = np.log(np.abs((math.sqrt(5) - z) / (math.sqrt(5) + z)))
        hilbert = -3 / (10 * math.pi) * z + 3 / (4 * math.sqrt(5) * math.pi) * (1 - z**2 / 5) * np.where(np.isclose(np.abs(z), math.sqrt(5)), 0, edge)
    hilbert = (np.where(np.isclose(np.abs(z), math.sqrt(5)), -3 / (10 * math.pi) * z, hilbert) / h).mean(axis=1)
    ratio = p / n
    shrunk = values / ((math.pi * ratio * values * density) ** 2 + (1 - ratio - math.pi * ratio * values * hilbert) ** 2)
    return (vectors * shrunk) @ vectors.T


def spectral_scores(x: np.ndarray, components: int | None = None, communality: bool = False) -> np.ndarray:
    """Per feature the sum over components of eigenvalue times squared loading (or of squared loadings alone)."""
    values, vectors, _ = pca(x)
    k = components or len(values)
    loading = vectors[:, :k] * np.sqrt(values[:k])
    return ((loading**2) if communality else values[:k] * loading**2).sum(axis=1)

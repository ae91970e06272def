"""Noise spectra of correlation matrices, and the spectrum over rolling windows.

A matrix of assets by assets is an aggregate; what is fitted here is the density of its eigenvalues. The Marchenko-Pastur law of
ratio q (columns by rows) and variance v is matched to a kernel density of the lower eigenvalues by bounded least squares over
(q, v): the law is cut to the same range and blurred by the same kernel, so that neither biases the fit. Eigenvalues above the edge
v (1 + sqrt q)^2 are signal, the others become their mean.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import risk

c = F.col
#: Fewer assets than this, or a greater ratio of assets to rows, are shrunk instead: ratios for a fit asked for, and for the automatic choice.
LEAST_ASSETS, FIT_RATIO, AUTO_RATIO = 10, 0.8, 0.5


def law(at: np.ndarray, q: float, variance: float) -> np.ndarray:
    """The Marchenko-Pastur density for q below 1 or above (without the mass at zero, then)."""
    low, high = variance * (1 - math.sqrt(q)) ** 2, variance * (1 + math.sqrt(q)) ** 2
    inside = np.maximum((high - at) * (at - low), 0)
    return np.sqrt(inside) / (2 * math.pi * q * variance * np.maximum(at, 1e-12))


def _kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-0.5 * ((a[:, None] - b[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi))


def fit_noise(values: np.ndarray, q: float, trim: float = 0.1, points: int = 150) -> tuple[float, float]:
    """(q, variance) of the noise by the density of the eigenvalues without the largest ``trim`` share; (q, mean) where they are too few.

    Signal lies at the upper end only, and the lower edge tells most about the ratio.
    The search begins at ``q`` and stays on its side of 1: the laws of q and 1 / q have the same shape.
    """
    values = np.sort(np.asarray(values, dtype=np.float64))
    n = len(values)
    x = values[: max(1, n - int(trim * n))]
    x = x[x > 1e-10]
    if len(x) < 5 or x.std() == 0:
        return float(q), float(values.mean()) if n else 1.0
    width = len(x) ** -0.2 * x.std(ddof=1)
    at = np.linspace(x[0], x[-1], points)
    seen = _kernel(at, x, width).mean(axis=1)
    # the law between the same ends, at the middles of fine cells, and blurred
    edges = np.linspace(x[0], x[-1], 4 * points + 1)
    fine, cell = (edges[1:] + edges[:-1]) / 2, edges[1] - edges[0]
    blur = _kernel(at, fine, width) * cell

    def error(p: np.ndarray) -> float:
        ratio, variance = math.exp(p[0]), math.exp(p[1])
        if not (0.01 <= ratio <= 10 and (ratio <= 1) == (q <= 1) and 0.01 <= variance <= values[-1] + 1e-6):
            return math.inf
        density = law(fine, ratio, variance)
        mass = density.sum() * cell
        return float(((seen - blur @ (density / mass)) ** 2).mean()) if mass > 1e-9 else math.inf

    # a coarse grid around the start, then a simplex search in the logarithms
    start = math.log(min(max(q, 0.01), 10))
    first = [np.array([start + a, math.log(max(float(x.mean()), 0.01)) + b]) for a in np.linspace(-1.5, 1.5, 13) for b in np.linspace(-0.9, 0.9, 13)]
    best = min(first, key=error)
    found = simplex(error, best, 0.1)
    return math.exp(found[0]), math.exp(found[1])


def simplex(error, start: np.ndarray, step: float, rounds: int = 300, tolerance: float = 1e-10) -> np.ndarray:
    """The least of a function by the simplex of Nelder and Mead."""
    points = [start, *(start + step * e for e in np.eye(len(start)))]
    told = [error(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(told, kind="stable")
        points, told = [points[i] for i in order], [told[i] for i in order]
        if max(np.abs(p - points[0]).max() for p in points) < tolerance:
            break
        middle, worst = np.mean(points[:-1], axis=0), points[-1]
        tried = {k: middle + k * (middle - worst) for k in (1.0, 2.0, -0.5)}
        mirrored = error(tried[1.0])
        if mirrored < told[0]:
            far = error(tried[2.0])
            points[-1], told[-1] = (tried[2.0], far) if far < mirrored else (tried[1.0], mirrored)
        elif mirrored < told[-2]:
            points[-1], told[-1] = tried[1.0], mirrored
        elif (near := error(tried[-0.5])) < told[-1]:
            points[-1], told[-1] = tried[-0.5], near
        else:
            points = [points[0], *((p + points[0]) / 2 for p in points[1:])]
            told = [told[0], *map(error, points[1:])]
    return points[int(np.argmin(told))]


def noise_edge(values: np.ndarray, q: float) -> tuple[float, float, float]:
    """(q, variance, edge) of the fitted noise."""
    ratio, variance = fit_noise(values, q)
    return ratio, variance, variance * (1 + math.sqrt(ratio)) ** 2


def cleaned_values(values: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues with noise as its mean, which of them are signal); without any signal, the largest tenth is."""
    signal = values > noise_edge(values, q)[2]
    if not signal.any():
        signal = np.argsort(np.argsort(values, kind="stable"), kind="stable") >= len(values) - max(1, len(values) // 10)
    level = max(float(values[~signal].mean()), 1e-6) if (~signal).any() else 1.0
    return np.where(signal, values, level), signal


def fitted_denoising(cov: np.ndarray, rows: int) -> np.ndarray:
    """The covariance with its correlation's noise levelled, the noise fitted; variances stay."""
    d = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    values, vectors = np.linalg.eigh(risk.correlation(cov))
    values, _ = cleaned_values(np.maximum(values, 0), len(cov) / rows)
    r = (vectors * values) @ vectors.T
    np.fill_diagonal(r, 1.0)
    r = np.clip(risk.shift_to_psd(r), -1, 1)
    np.fill_diagonal(r, 1.0)
    return r * np.outer(d, d)


def choose(method: str, assets: int, rows: int) -> str:
    """The method that is used: small or wide samples are shrunk linearly in place of a fit."""
    if method not in ("auto", "fitted", "shrinkage", "nonlinear"):
        raise ValueError(f"unknown denoising {method}")
    if method in ("auto", "fitted"):
        ratio = assets / rows if rows else math.inf
        return "shrinkage" if assets < LEAST_ASSETS or ratio > (AUTO_RATIO if method == "auto" else FIT_RATIO) else "fitted"
    return method


def denoise(cov: np.ndarray, x: np.ndarray, method: str = "auto") -> np.ndarray:
    """The covariance of the rows ``x`` without noise, by the method that ``choose`` names."""
    used = choose(method, len(cov), len(x))
    if used == "shrinkage":
        return risk.ledoit_wolf(x)[0]
    return fitted_denoising(cov, len(x)) if used == "fitted" else risk.nonlinear_shrinkage(x)


def denoised_vectors(vectors: DataFrame, column: str, method: str = "auto") -> tuple[str, np.ndarray]:
    """(the method used, the covariance of the places of a vector column without noise).

    Only matrices of sums meet the driver: one of products, and where it shrinks linearly one of products of squares.
    """
    n, sums, _, _ = risk.vector_ends(vectors, column)
    mean = sums / max(n, 1)
    products = dense(risk.gram(vectors, column, lambda x: x - mean), len(mean))
    used = choose(method, len(mean), n)
    if used == "shrinkage":
        return used, risk.shrunk(products, dense(risk.gram(vectors, column, lambda x: (x - mean) ** 2), len(mean)), n)[0]
    if used == "nonlinear":
        return used, risk.nonlinear_of(products, n)
    return used, fitted_denoising(products / (n - 1), n)


def dense(cells: DataFrame, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for r in cells.collect():
        out[r.i, r.j] = r.s
    return out


def noise_spectrum(correlation: np.ndarray, rows: int) -> list[tuple[int, float, bool, float, float, float, float]]:
    """(place, value, signal, cleaned, q, variance, edge) of the eigenvalues, the largest first."""
    values = np.maximum(np.linalg.eigvalsh(correlation), 0)[::-1]
    q = len(values) / rows
    found, (clean, signal) = noise_edge(values, q), cleaned_values(values, q)
    return [(k, float(v), bool(s), float(w), *found) for k, (v, s, w) in enumerate(zip(values, signal, clean, strict=True))]


def top_components(matrix: np.ndarray, k: int, start: np.ndarray | None = None, rounds: int = 60, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """(the ``k`` largest eigenvalues, a basis to begin the next window with) by subspace iteration; by decomposition where it does not settle."""
    p = len(matrix)
    width = min(p, k + 4)
    basis = np.eye(p, width) if start is None else start
    before = None
    for _ in range(rounds):
        basis, _ = np.linalg.qr(matrix @ basis)
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        values, basis = values[::-1], basis @ turn[:, ::-1]
        gap = matrix @ basis[:, :k] - basis[:, :k] * values[:k]
        if before is not None and np.abs(gap).max() < 1e-7 and np.abs(values[:k] - before).max() < tolerance * max(values[0], 1):
            return values[:k], basis
        before = values[:k]
    values, vectors = np.linalg.eigh(matrix)
    return values[::-1][:k], vectors[:, ::-1][:, :width]


def window_spectra(x: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of the correlation of every ``n`` consecutive rows.

    Sums and products slide: a window is the one before, one row more and one less, begun anew every ``n`` rows so that
    roundings do not add up; its components begin with those of the window before. Columns without spread count as uncorrelated.
    """
    out, basis = np.empty((max(len(x) - n + 1, 0), min(k, x.shape[1]))), None
    # about the mean of all, sums of squares keep their digits
    x = x - x.mean(axis=0)
    for i in range(len(out)):
        if i % n == 0:
            total, products = x[i : i + n].sum(axis=0), x[i : i + n].T @ x[i : i + n]
        else:
            new, old = x[i + n - 1], x[i - 1]
            total, products = total + new - old, products + np.outer(new, new) - np.outer(old, old)
        cov = products - np.outer(total, total) / n
        # what roundings leave of a column without spread is far below its squares
        flat = np.diag(cov) <= 1e-12 * np.diag(products)
        spread = np.sqrt(np.maximum(np.diag(cov), 0))
        r = cov / np.outer(np.where(flat, 1, spread), np.where(flat, 1, spread))
        r[flat, :] = r[:, flat] = 0
        out[i], basis = top_components(r, out.shape[1], basis)
    return out


def rolling_spectrum(returns: DataFrame, n: int, k: int = 3, chunk: int = 500) -> DataFrame:
    """(day, component, value, share): the ``k`` largest eigenvalues of the assets' correlation over the last ``n`` days, and their shares of the trace.

    A task has ``chunk`` end days and the ``n`` - 1 days before them. Days are one row each; assets without a value on a day count as 0 there.
    """
    days = returns.select(F.to_date("ts").alias("day")).distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    assets = sorted(r.asset for r in returns.select("asset").distinct().collect())
    rows = returns.select(F.to_date("ts").alias("day"), "asset", "ret").join(days, "day")
    wide = rows.groupBy("i", "day").agg(*(F.coalesce(F.avg(F.when(c("asset") == a, c("ret"))), F.lit(0.0)).alias(f"a{j}") for j, a in enumerate(assets)))
    dealt = wide.withColumn("block", F.explode(F.sequence(F.floor(c("i") / chunk).cast("int"), F.floor((c("i") + n - 1) / chunk).cast("int"))))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first = pdf.sort_values("i"), int(pdf["block"].iloc[0]) * chunk
        lead = int((pdf["i"] < first).sum())
        own = pdf[pdf["i"] < first + chunk]
        skip = max(lead - (n - 1), 0)
        x = own[[f"a{j}" for j in range(len(assets))]].to_numpy()[skip:]
        found = window_spectra(x, n, k)
        ends = own["day"].to_numpy()[skip + n - 1 :]
        live = np.lib.stride_tricks.sliding_window_view(x, n, axis=0).std(axis=2) > 0 if len(found) else np.zeros((0, 1))
        rows_ = [(d, j, float(v), float(v / max(s, 1))) for d, values, s in zip(ends, found, live.sum(axis=1), strict=True) for j, v in enumerate(values)]
        return pd.DataFrame(rows_, columns=["day", "component", "value", "share"])

    return dealt.groupBy("block").applyInPandas(work, "day date, component int, value double, share double")

"""Timing and comparison of functions: repeats with their median, and recursive equality of results."""

from __future__ import annotations

import copy
import time
import tracemalloc
from collections.abc import Callable
from statistics import median, pstdev
from typing import Any

import numpy as np
import pandas as pd


def benchmark(work: Callable[..., Any], *args: Any, repeats: int = 100, warmup: int = 0, fresh: bool = False, memory: bool = True, **kwargs: Any) -> dict[str, float]:
    """Median, deviation and minimum seconds of ``work``, and its peak megabytes in a run of its own."""
    call = lambda: work(*(copy.deepcopy(args) if fresh else args), **(copy.deepcopy(kwargs) if fresh else kwargs))
    for _ in range(warmup):
        call()
    seconds = []
    for _ in range(repeats):
        began = time.perf_counter()
        call()
        seconds.append(time.perf_counter() - began)
    out = {"median": median(seconds), "sd": pstdev(seconds), "min": min(seconds)}
    if memory:
        tracemalloc.start()
        call()
        out["peak_mb"] = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
    return out


def difference(a: Any, b: Any) -> float:
    """Largest absolute difference of two nested results; infinite where they differ in shape or kind."""
    if isinstance(a, dict) and isinstance(b, dict):
        return max((difference(a[k], b[k]) for k in a), default=0.0) if a.keys() == b.keys() else float("inf")
    if isinstance(a, (pd.DataFrame, pd.Series)) and isinstance(b, type(a)):
        return difference(a.to_numpy(), b.to_numpy()) if a.index.equals(b.index) else float("inf")
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return max((difference(x, y) for x, y in zip(a, b, strict=True)), default=0.0) if len(a) == len(b) else float("inf")
    x, y = np.asarray(a), np.asarray(b)
    if x.shape != y.shape:
        return float("inf")
    if x.dtype.kind in "biufc" and y.dtype.kind in "biufc":
        both = np.isnan(x.astype(float)) & np.isnan(y.astype(float))
        d = np.where(both, 0.0, np.abs(x.astype(float) - y.astype(float)))
        return float(np.nan_to_num(d, nan=float("inf")).max()) if d.size else 0.0
    return 0.0 if bool(np.all(x == y)) else float("inf")


def compare(old: Callable[..., Any], new: Callable[..., Any], *args: Any, repeats: int = 50, warmup: int = 3, **kwargs: Any) -> dict[str, Any]:
    """Timings of both functions on the same arguments, how much faster the new one is, and how results differ."""
    a, b = (benchmark(f, *args, repeats=repeats, warmup=warmup, fresh=True, **kwargs) for f in (old, new))
    return {"old": a, "new": b, "speedup": a["median"] / b["median"], "difference": difference(old(*copy.deepcopy(args), **kwargs), new(*copy.deepcopy(args), **kwargs))}

"""Mutual information by nearest neighbours (Kraskov and others) over whole tables.

Of a pair of features, a row's reach is its distance to the k-th nearest other row (the greater of both differences);
the information is psi(k) + psi(n) less the mean of psi over the numbers of rows that lie nearer than the reach in
either feature, the row itself included. Nothing is sampled:

* Up to ``cell_rows`` rows, a pair is one cell and one group. Map tasks pack the values of every pair, so that what is shuffled
  is a few long rows for each pair and not a row for each point.
* Beyond, every feature is cut into slabs of about equal numbers of rows, and the plane of a pair into the cells of its slabs.
  A cell is one group.
* Inside a cell points lie in strips, and a window of each strip bounds the reach; the square of that size is then searched
  whole where it goes beyond the window.
* The reach inside the own cell bounds the true one. Rows whose square of that size touches other cells visit them, and
  the least distances of all visits are the true ones. A row whose cell has too few others takes its bound from the least
  block of 2, 4, 8 ... cells a side that has enough.
* The nearer rows of one feature are counted by binary search in the slabs that the interval touches, mostly the own one.

Ties are parted by noise of one part in ten billion, made from id and feature. Rows with a null or no number in either
feature are left out of a pair, features without spread and pairs of ``k`` rows or fewer out of the result. Repeated rows are
neighbours of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import information
from tidemark.sources.tables import written

c = F.col
Number = TypeVar("Number", Column, np.ndarray)

#: Rows of a cell that a pair of independent features has, the points of a tile, and the most slabs of a feature.
CELL_ROWS = 1 << 20
TILE = 64
MOST_SLABS = 4096
NOISE = 1e-10
#: Points on either side that a window has in a strip, points looked at together, and candidates held at once.
WINDOW = 8
CHUNK = 1 << 14
CANDIDATES = 1 << 16
#: Values of a packed row, and bytes of a batch of them.
PACKED_ROWS = 1 << 17
PACKED_BYTES = 8 << 20


def digamma(n: Number, log: Callable[[Number], Number]) -> Number:
    """Psi of numbers of 1 or more, of columns or arrays alike: the asymptotic series six steps further on."""
    m = n + 6.0
    inverse = 1.0 / (m * m)
    series = log(m) - 0.5 / m - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse / 132))))
    return series - 1.0 / n - 1.0 / (n + 1.0) - 1.0 / (n + 2.0) - 1.0 / (n + 3.0) - 1.0 / (n + 4.0) - 1.0 / (n + 5.0)


def _tiles(points: np.ndarray) -> list[np.ndarray]:
    """The points' numbers in tiles of about ``TILE``: strips of the first coordinate, cut along the second."""
    n = len(points)
    strips = max(1, math.isqrt(max(n // TILE, 1)))
    by_x = np.argsort(points[:, 0], kind="stable")
    out = []
    for strip in np.array_split(by_x, strips):
        strip = strip[np.argsort(points[strip, 1], kind="stable")]
        out += np.array_split(strip, max(1, round(len(strip) / TILE)))
    return [t for t in out if len(t)]


def nearest_distances(points: np.ndarray, queries: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The ``k`` least distances from every query to the points, ascending, infinite where there are too few.

    With ``own`` the queries are the points, and none is its own neighbour.
    """
    out = np.full((len(queries), k), np.inf)
    if not len(points) or not len(queries):
        return out
    tiles = _tiles(points)
    low, high = (np.array([f(points[t], axis=0) for t in tiles]) for f in (np.min, np.max))
    for t in tiles if own else _tiles(queries):
        q = queries[t]
        gap = np.maximum(np.maximum(low - q.max(axis=0), q.min(axis=0) - high), 0).max(axis=1)
        best, order, at = out[t], np.argsort(gap, kind="stable"), 0
        while at < len(order) and gap[order[at]] < best[:, -1].max():
            some = np.concatenate([tiles[i] for i in order[at : at + 4]])
            d = np.abs(q[:, None, :] - points[some][None, :, :]).max(axis=2)
            if own:
                d[t[:, None] == some[None, :]] = np.inf
            best = np.partition(np.concatenate([best, d], axis=1), k - 1, axis=1)[:, :k]
            best.sort(axis=1)
            at += 4
        out[t] = best
    return out


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these lengths, one after the other: the run of each place, and the place in its run."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def nearest_inside(points: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least distances from every point to the others, ascending, infinite where there are too few.

    Points lie in strips of the first coordinate, sorted by the second. The windows around a point's place in its own and both
    adjoining strips bound its reach; points whose square goes beyond them are compared with all that lies in it.
    """
    n = len(points)
    if n < 2:
        return np.full((n, k), np.inf)
    m, gap = max(1, round(0.7 * math.sqrt(n))), max(WINDOW, k) + 1
    order = np.argsort(points[:, 0], kind="stable")
    strip = np.arange(n) * m // n
    order = order[np.lexsort((points[order, 1], strip))]
    x, y = np.ascontiguousarray(points[order, 0]), np.ascontiguousarray(points[order, 1])
    start = np.searchsorted(strip, np.arange(m + 1))
    low, high = np.minimum.reduceat(x, start[:-1]), np.maximum.reduceat(x, start[:-1])
    by_y = np.argsort(y, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[by_y] = np.arange(n)
    sorted_y, keys = y[by_y], strip * n + rank
    # between strips, and for one more strip at both ends, places that lie infinitely far away
    padded = np.full((2, n + (m + 3) * gap), np.inf)
    own = np.arange(n) + (strip + 2) * gap
    padded[0, own], padded[1, own] = x, y
    far_x, far_y = padded
    before, after = np.concatenate(([-np.inf, -np.inf], high)), np.concatenate((low, [np.inf, np.inf]))
    out = np.empty((n, k))
    for begin in range(0, n, CHUNK):
        part = slice(begin, min(begin + CHUNK, n))
        px, py, s, best = x[part], y[part], strip[part], [np.full(part.stop - begin, np.inf) for _ in range(k)]
        ends = []
        for side in (0, -1, 1):
            at = own[part] if not side else np.searchsorted(keys, (s + side) * n + rank[part]) + (s + side + 2) * gap
            last = gap if not side else gap - 1
            for step in range(1 - gap, last):
                if side or step:
                    d = np.maximum(np.abs(far_x[at + step] - px), np.abs(far_y[at + step] - py))
                    for level in range(k):
                        best[level], d = np.minimum(best[level], d), np.maximum(best[level], d)
            ends += [at - gap, at + last]
        reach = best[-1]
        settled = (px - before[s] >= reach) & (after[s + 2] - px >= reach)
        for at in ends:
            settled &= np.abs(far_y[at] - py) >= reach
        out[part] = np.column_stack(best)
        rest = np.flatnonzero(~settled)
        if len(rest):
            _search(out, rest + begin, k, x, y, low, high, sorted_y, keys)
    result = np.empty((n, k))
    result[order] = out
    return result


def _search(out: np.ndarray, rest: np.ndarray, k: int, x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, sorted_y: np.ndarray, keys: np.ndarray) -> None:
    """Puts the ``k`` least distances of the points ``rest`` into ``out``, from all points in the squares of the bounds there."""
    n, reach = len(x), out[rest, -1]
    # sums may round to the wrong side, so squares are a little wider
    wide = reach + 1e-12 * (np.abs(x[rest]) + np.abs(y[rest]) + reach)
    first, end = np.searchsorted(high, x[rest] - wide), np.searchsorted(low, x[rest] + wide, side="right")
    bottom, top = np.searchsorted(sorted_y, y[rest] - wide), np.searchsorted(sorted_y, y[rest] + wide, side="right")
    counts = np.maximum(end - first, 0)
    runs = np.cumsum(counts)
    done = 0
    while done < len(rest):
        upto = max(done + 1, int(np.searchsorted(runs, (runs[done - 1] if done else 0) + CANDIDATES, side="right")))
        point, place = _ranges(counts[done:upto])
        point += done
        key = (first[point] + place) * n
        begin, stop = np.searchsorted(keys, key + bottom[point]), np.searchsorted(keys, key + top[point])
        some, held = 0, np.cumsum(stop - begin)
        # whole points at a time
        last = np.searchsorted(point, np.arange(done, upto), side="right")
        at = done
        while at < upto:
            base = held[some - 1] if some else 0
            at_end = max(at + 1, done + int(np.searchsorted(held[np.maximum(last - 1, 0)], base + CANDIDATES, side="right")))
            piece = slice(some, int(last[at_end - done - 1]))
            run, step = _ranges((stop - begin)[piece])
            who, other = point[piece][run], begin[piece][run] + step
            me = rest[who]
            d = np.maximum(np.abs(x[other] - x[me]), np.abs(y[other] - y[me]))
            near = (d <= reach[who]) & (other != me)
            who, d = who[near], d[near]
            d = d[np.lexsort((d, who))]
            number = np.bincount(who - at, minlength=at_end - at)
            where = (np.cumsum(number) - number)[:, None] + np.arange(k)
            there = np.arange(k) < number[:, None]
            out[rest[at:at_end]] = np.where(there, d[np.minimum(where, max(len(d) - 1, 0))] if len(d) else np.inf, np.inf)
            at, some = at_end, piece.stop
        done = upto


def nearer(values: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How many of ``values`` lie nearer than ``reach`` to each of ``at``, by the rounded differences.

    The neighbour that makes the reach lies on its edge, where a sum may round to the wrong side: the place found by search
    moves on until the differences themselves agree.
    """
    distinct, times = np.unique(values, return_counts=True)
    before = np.concatenate(([0], np.cumsum(times)))
    padded = np.concatenate(([-np.inf], distinct, [np.inf]))

    def first(place: np.ndarray, lies_before: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        while True:
            step = lies_before(padded[place + 1]).astype(np.int64) - (~lies_before(padded[place])).astype(np.int64)
            if not step.any():
                return place
            place = place + step

    start = first(np.searchsorted(distinct, at - reach), lambda v: at - v >= reach)
    end = first(np.searchsorted(distinct, at + reach), lambda v: v - at < reach)
    return before[end] - before[start]


def _slab(bounds: Column, v: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= v))


def _scaled(features: DataFrame) -> DataFrame:
    """(id, feature, v): values over their feature's deviation, with noise; features without spread are left out."""
    rows = features.select("id", "feature", c("value").cast("double").alias("v")).where(c("v").isNotNull() & ~F.isnan("v"))
    ends = rows.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).where("sd > 0")
    noise = F.pmod(F.xxhash64("id", "feature"), F.lit(1 << 40)).cast("double") * (NOISE / (1 << 40))
    return rows.join(ends, "feature").select("id", "feature", ((c("v") - c("mean")) / c("sd") + noise).alias("v"))


def _pairs(slabs: DataFrame) -> DataFrame:
    """(i, j, id, x, y, sx, sy) of all pairs of features, from (id, feature, v, slab); a row's features meet in its own row."""
    whole = slabs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", "v", "slab"))).alias("all"))
    first = whole.select("id", "all", F.posexplode("all").alias("p", "a"))
    both = first.select("id", "a", F.explode(F.slice("all", c("p") + 2, F.size("all"))).alias("b")).where("a.feature < b.feature")
    return both.select(c("a.feature").alias("i"), c("b.feature").alias("j"), "id", c("a.v").alias("x"), c("b.v").alias("y"), c("a.slab").alias("sx"), c("b.slab").alias("sy"))


def _array(table: pa.Table, *names: str) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in names])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def _reaches(points: DataFrame, slabs: DataFrame, bounds: DataFrame, k: int, kinds: str) -> DataFrame:
    """(i, j, id, x, y, sx, sy, reach) of all points of pairs with more than ``k`` rows."""
    key = ["i", "j", "sx", "sy"]

    def inside(table: pa.Table) -> pa.Table:
        p = _array(table, "x", "y")
        return table.append_column("best", _lists(nearest_inside(p, k)))

    own = written(points.groupBy(*key).applyInArrow(inside, f"{kinds}, x double, y double, sx int, sy int, best array<double>"))
    reach = F.element_at("best", k)
    # bounds of points whose cell has too few others, from blocks of cells
    cells = own.groupBy(*key).agg(F.count("*").alias("n"), *(f(v).alias(f"{name}_{v}") for v in "xy" for name, f in (("low", F.min), ("high", F.max))))
    levels = F.sequence(F.lit(1), F.lit(MOST_SLABS.bit_length()))
    wide = cells.withColumn("level", F.explode(levels)).withColumns({"bx": F.expr("shiftright(sx, level)"), "by": F.expr("shiftright(sy, level)")})
    ends = [f(f"{name}_{v}").alias(f"{name}_{v}") for v in "xy" for name, f in (("low", F.min), ("high", F.max))]
    blocks = wide.groupBy("i", "j", "level", "bx", "by").agg(F.sum("n").alias("n"), *ends).where(c("n") > k)
    lone = own.where(reach == math.inf).withColumn("level", F.explode(levels)).withColumns({"bx": F.expr("shiftright(sx, level)"), "by": F.expr("shiftright(sy, level)")})
    far = F.greatest(c("x") - c("low_x"), c("high_x") - c("x"), c("y") - c("low_y"), c("high_y") - c("y"))
    bounded = lone.join(blocks, ["i", "j", "level", "bx", "by"]).groupBy("i", "j", "id", "x", "y", "sx", "sy", "best").agg(F.min(far).alias("bound"))
    known = own.where(reach < math.inf).select("i", "j", "id", "x", "y", "sx", "sy", "best", reach.alias("bound"))
    # squares that touch other cells
    known = known.unionByName(bounded)
    known = known.join(bounds.select(c("feature").alias("i"), c("bounds").alias("cut_x")), "i").join(bounds.select(c("feature").alias("j"), c("bounds").alias("cut_y")), "j")
    for v in "xy":
        known = known.withColumns({f"from_{v}": _slab(c(f"cut_{v}"), c(v) - c("bound")), f"to_{v}": _slab(c(f"cut_{v}"), c(v) + c("bound"))})
    touching = (c("from_x") < c("sx")) | (c("to_x") > c("sx")) | (c("from_y") < c("sy")) | (c("to_y") > c("sy"))
    known = written(known.withColumn("visits", touching).drop("cut_x", "cut_y"))
    names = ["i", "j", "id", "x", "y", "sx", "sy"]
    settled = known.where("not visits").select(*names, c("bound").alias("reach"))
    guests = known.where("visits").withColumn("cx", F.explode(F.sequence("from_x", "to_x"))).withColumn("cy", F.explode(F.sequence("from_y", "to_y")))
    guests = guests.where((c("cx") != c("sx")) | (c("cy") != c("sy")))
    hosts = own.join(guests.select("i", "j", c("cx").alias("sx"), c("cy").alias("sy")).distinct(), key, "left_semi")

    def visit(table: pa.Table) -> pa.Table:
        is_guest = table.column("guest").to_numpy()
        p = _array(table, "x", "y")
        found = nearest_distances(p[~is_guest], p[is_guest], k, own=False)
        out = table.filter(table.column("guest")).drop_columns(["guest", "cx", "cy"])
        return out.append_column("best", _lists(found))

    met = guests.select(*names, "cx", "cy", F.lit(True).alias("guest")).unionByName(hosts.select(*names, c("sx").alias("cx"), c("sy").alias("cy"), F.lit(False).alias("guest")))
    found = met.groupBy("i", "j", "cx", "cy").applyInArrow(visit, f"{kinds}, x double, y double, sx int, sy int, best array<double>")
    merged = known.where("visits").select(*names, "best").unionByName(found.select(*names, "best"))
    merged = merged.groupBy(*names).agg(F.element_at(F.sort_array(F.flatten(F.collect_list("best"))), k).alias("reach"))
    return settled.unionByName(merged)


def _nearer_rows(reaches: DataFrame, bounds: DataFrame, kinds: str) -> DataFrame:
    """(i, j, axis, points, psi): parts of the sum of psi over the numbers of nearer rows of both features."""
    sides = [reaches.select("i", "j", "id", F.lit(a).alias("axis"), c(f).alias("feature"), c(v).alias("v"), c(s).alias("slab"), "reach") for a, (f, v, s) in enumerate((("i", "x", "sx"), ("j", "y", "sy")))]
    rows = sides[0].unionByName(sides[1]).join(bounds, "feature")
    rows = rows.withColumn("touched", F.sequence(_slab(c("bounds"), c("v") - c("reach")), _slab(c("bounds"), c("v") + c("reach")))).drop("bounds", "feature")
    rows = rows.withColumn("touched", F.array_union("touched", F.array("slab"))).withColumn("whole", F.size("touched") == 1)
    rows = rows.withColumn("at", F.explode("touched")).withColumn("guest", c("at") != c("slab")).drop("touched", "slab")

    def count(table: pa.Table) -> pa.Table:
        v, reach = (table.column(n).to_numpy() for n in ("v", "reach"))
        guest, whole = (table.column(n).to_numpy() for n in ("guest", "whole"))
        n = nearer(v[~guest], v, reach)
        part = table.filter(pa.array(~whole)).select(["i", "j", "axis", "id"])
        part = part.append_column("n", pa.array(n[~whole].astype(np.float64)))
        part = part.append_column("points", pa.array(np.zeros(part.num_rows))).append_column("psi", pa.array(np.zeros(part.num_rows)))
        # points that touch no other slab are added up here
        settled = n[whole].astype(np.float64)
        first = table.slice(0, 1).select(["i", "j", "axis"])
        total = first.append_column("id", pa.nulls(1, table.schema.field("id").type)).append_column("n", pa.array([0.0]))
        total = total.append_column("points", pa.array([float(len(settled))])).append_column("psi", pa.array([float(digamma(np.maximum(settled, 1.0), np.log).sum())]))
        return pa.concat_tables([part, total])

    found = rows.groupBy("i", "j", "axis", "at").applyInArrow(count, f"{kinds.replace(', id', ', axis int, id')}, n double, points double, psi double")
    # a point that touches several slabs has a row from each
    joined = found.groupBy("i", "j", "axis", "id").agg(F.sum("n").alias("n"), F.sum("points").alias("points"), F.sum("psi").alias("psi"))
    split = c("id").isNotNull()
    return joined.select(
        "i", "j", "axis", F.when(split, 1.0).otherwise(c("points")).alias("points"), F.when(split, digamma(F.greatest("n", F.lit(1.0)), F.log)).otherwise(c("psi")).alias("psi")
    )


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, x, y): the values of all pairs of features as bytes, from rows of lists (feature, v); a row's features meet in it."""
    for batch in batches:
        lists = batch.column("feature")
        encoded = pc.dictionary_encode(lists.flatten())
        names = encoded.dictionary
        ranked = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(names), dtype=np.int64)
        rank[ranked] = np.arange(len(names))
        feature, row = rank[encoded.indices.to_numpy()], np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        order = np.lexsort((row, feature))
        ends = np.searchsorted(feature[order], np.arange(len(names) + 1))
        v, row = batch.column("v").flatten().to_numpy()[order], row[order]
        parts = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        times = [np.bincount(row[p], minlength=len(lists)) for p in parts]
        once = [bool((t == 1).all()) for t in times]
        out: list[tuple] = []
        held = 0
        for a, one in enumerate(parts):
            for b in range(a + 1, len(parts)):
                x, y = v[one], v[parts[b]]
                if not (once[a] and once[b]):
                    # every value of a row meets every one of the other feature
                    number = times[b][row[one]]
                    owner, place = _ranges(number)
                    x, y = x[owner], y[(np.cumsum(times[b]) - times[b])[row[one]][owner] + place]
                for at in range(0, len(x), PACKED_ROWS):
                    out.append((ranked[a], ranked[b], x[at : at + PACKED_ROWS].tobytes(), y[at : at + PACKED_ROWS].tobytes()))
                    held += 2 * len(out[-1][2])
                if held > PACKED_BYTES:
                    yield _pair_batch(names, out)
                    out, held = [], 0
        if out:
            yield _pair_batch(names, out)


def _pair_batch(names: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    i, j, x, y = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["i", "j", "x", "y"])


def _whole_pairs(scaled: DataFrame, k: int, kind: str) -> DataFrame:
    """(i, j, points, psi) of pairs that are one cell each: sums over both features, for pairs with more than ``k`` rows."""
    rows = scaled.groupBy("id").agg(F.collect_list(F.struct("feature", "v")).alias("all")).select("all.feature", "all.v")

    def inside(table: pa.Table) -> pa.Table:
        x, y = (np.concatenate([np.frombuffer(b, dtype=np.float64) for b in table.column(n).to_pylist()]) for n in ("x", "y"))
        pair = table.slice(0, 1 if len(x) > k else 0).select(["i", "j"])
        psi = 0.0
        if len(x) > k:
            reach = nearest_inside(np.column_stack((x, y)), k)[:, -1]
            psi = sum(float(digamma(np.maximum(nearer(v, v, reach), 1).astype(np.float64), np.log).sum()) for v in (x, y))
        return pair.append_column("points", pa.array([2.0 * len(x)][: len(pair)], pa.float64())).append_column("psi", pa.array([psi][: len(pair)], pa.float64()))

    pairs = rows.mapInArrow(_packed, f"i {kind}, j {kind}, x binary, y binary")
    return pairs.groupBy("i", "j").applyInArrow(inside, f"i {kind}, j {kind}, points double, psi double")


def neighbour_information(features: DataFrame, k: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(i, j, n, mi): nearest-neighbour mutual information in nats of all pairs of features of (id, feature, value), ids not null."""
    scaled = written(_scaled(features.where("id is not null")))
    most = scaled.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    slabs = min(MOST_SLABS, max(1, math.ceil(math.sqrt(most / cell_rows))))
    kind = features.schema["feature"].dataType.simpleString()
    if slabs == 1:
        parts = _whole_pairs(scaled, k, kind)
    else:
        shares = [s / slabs for s in range(1, slabs)]
        bounds = scaled.groupBy("feature").agg(F.array_distinct(F.percentile_approx("v", shares, 10 * slabs)).alias("bounds"))
        placed = scaled.join(bounds, "feature").select("id", "feature", "v", _slab(c("bounds"), c("v")).alias("slab"))
        # an id that repeats has several points in a pair, which are told apart by a number of their own
        points = _pairs(placed).withColumn("id", F.monotonically_increasing_id())
        kinds = f"i {kind}, j {kind}, id long"
        parts = _nearer_rows(_reaches(points, placed, bounds, k, kinds), bounds, kinds)
    total = parts.groupBy("i", "j").agg((F.sum("points") / 2).cast("long").alias("n"), (F.sum("psi") / F.sum("points") * 2).alias("mean"))
    psi_k = float(digamma(np.array([float(k)]), np.log)[0])
    return total.select("i", "j", "n", F.greatest(F.lit(psi_k) + digamma(c("n").cast("double"), F.log) - c("mean"), F.lit(0.0)).alias("mi"))


def neighbour_matrix(features: DataFrame, k: int = 3, rank_gaussian: bool = True, least: int = 24, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(i, j, n, mi, nmi): the information, and twice it over both features' entropies, between 0 and 1.

    Values become normal quantiles of their ranks first, unless told otherwise; features with fewer than ``least`` values
    are left out. Entropies are in bits, over as many equal bins as the root of the number of rows.
    """
    enough = features.groupBy("feature").agg(F.count("value").alias("_n"), F.stddev("value").alias("_sd")).where((c("_n") >= least) & (c("_sd") > 0))
    rows = features.where(c("value").isNotNull()).join(enough.select("feature"), "feature").select("id", "feature", "value")
    if rank_gaussian:
        rows = information.rank_gaussian(rows, "value", "feature").select("id", "feature", c("gauss").alias("value"))
    n = rows.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    h = information.entropy(information.ranged_bin(rows, "value", max(1, math.isqrt(n)), "feature"), "feature")
    mi = neighbour_information(rows, k, cell_rows)
    both = mi.join(h.select(c("feature").alias("i"), c("entropy").alias("hx")), "i").join(h.select(c("feature").alias("j"), c("entropy").alias("hy")), "j")
    nmi = F.least(F.coalesce(F.try_divide(2 * c("mi"), c("hx") + c("hy")), F.lit(0.0)), F.lit(1.0))
    return both.select("i", "j", "n", "mi", nmi.alias("nmi"))

"""Gradient boosting on histograms over partitioned rows, and importance by permutation inside the plan.

Rows stay where they are: every feature becomes a bin of one byte, and for each level of a tree every task adds up the
gradients of its rows by (node, feature, bin). Those sums, whole numbers of 2^-24, are merged by an aggregate and reach the
driver as one histogram of fixed size, from which it picks the splits; of two sisters one is counted, the other is the parent less
that one. Whole numbers make the sums, and so the trees, the same however the rows are dealt. The log-loss of every part of the rows (train,
dev, ...) comes with the first level of the next tree; when that of the part to watch has not improved for ``patience``
rounds, boosting stops and the best round's trees are kept. Scores are written down every ``keep`` trees, so that a task evaluates
few trees per row.

Rows are (id, label, x, part): labels 0 or 1, ``x`` an array of as many numbers for all. Rows with a null label are left out, missing
or null numbers count as 0. Tables without training rows raise ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import risk
from tidemark.operators.learning import Forest, leaf_values
from tidemark.sources.tables import written

c = F.col
UNIT = float(1 << 24)
SUMS = "node int, feature int, bin int, g long, h long, n long"


@dataclass
class Boosted:
    """The trees kept, the loss by (round, part), and the share of the splits' gain per feature. Round 0 has no tree yet."""

    forest: Forest
    losses: list[tuple[int, str, float]]
    gain: np.ndarray
    best_round: int


def feature_edges(rows: DataFrame, width: int, bins: int = 32, accuracy: int = 10_000) -> list[np.ndarray]:
    """Bounds of about equally filled bins of every feature: one aggregate of ``bins`` numbers a feature."""
    shares = [k / bins for k in range(1, bins)]
    values = rows.select(F.posexplode("x").alias("feature", "v")).where(c("feature") < width)
    filled = values.select("feature", F.coalesce(F.nanvl(c("v").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    found = {r.feature: r.q for r in filled.groupBy("feature").agg(F.percentile_approx("v", shares, accuracy).alias("q")).collect()}
    return [np.unique(np.array(found.get(j, [0.0]), dtype=np.float64)) for j in range(width)]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, width))
    for i, row in enumerate(batch.column("x").to_pylist()):
        got = np.array([0.0 if v is None else v for v in (row or [])[:width]])
        out[i, : len(got)] = np.nan_to_num(got)
    return out


def binned_rows(rows: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
    """(id, label, part, bins, score): one byte per feature, the score of no tree; a written table."""
    width = len(edges)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            b = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]).astype(np.uint8)
            columns = [batch.column("id"), batch.column("label"), batch.column("part"), pa.array([r.tobytes() for r in b], pa.binary()), pa.array(np.full(len(b), base))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "part", "bins", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    plain = rows.where("label is not null").select("id", c("label").cast("double").alias("label"), c("part").cast("string").alias("part"), "x")
    return written(plain.mapInArrow(work, f"id {kind}, label double, part string, bins binary, score double"))


def _bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)


def _scores(batch: pa.RecordBatch, b: np.ndarray, trees: list) -> np.ndarray:
    return batch.column("score").to_numpy() + sum((leaf_values(t, b) for t in trees), np.zeros(len(b)))


def _nodes(splits: dict[int, tuple[int, int]], b: np.ndarray) -> np.ndarray:
    """The node of the growing tree that each row lies in; node k's children are 2k + 1 and 2k + 2."""
    at = np.zeros(len(b), dtype=np.int64)
    for k in sorted(splits):
        j, cut = splits[k]
        inside = at == k
        at[inside] = 2 * k + 1 + (b[inside, j] > cut)
    return at


def log_loss(label: np.ndarray, p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -(label * np.log(p) + (1 - label) * np.log(1 - p))


def _histograms(table: DataFrame, width: int, bins: int, new_trees: list, splits: dict[int, tuple[int, int]], wanted: list[int], parts: list[str]) -> tuple[dict[int, np.ndarray], dict[str, float]]:
    """Sums by (node, feature, bin) of the training rows in ``wanted`` nodes; with node 0, the mean loss of every part as well."""
    place = {k: i for i, k in enumerate(wanted)}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(wanted), width, bins, 3), dtype=np.int64)
        losses = np.zeros((len(parts), 2), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            b, label, part = _bins(batch, width), batch.column("label").to_numpy(), np.array(batch.column("part").to_pylist(), dtype=object)
            p = 1 / (1 + np.exp(-_scores(batch, b, new_trees)))
            if 0 in place:
                loss = np.floor(log_loss(label, p) * UNIT + 0.5).astype(np.int64)
                for i, name in enumerate(parts):
                    losses[i] += [loss[part == name].sum(), (part == name).sum()]
            g, h = np.floor((p - label) * UNIT + 0.5).astype(np.int64), np.floor(p * (1 - p) * UNIT + 0.5).astype(np.int64)
            at = np.where(part == parts[0], _nodes(splits, b), -1)
            for k, i in place.items():
                rows = np.flatnonzero(at == k)
                offset = (np.arange(width) * bins + b[rows]).ravel()
                for s, value in enumerate((g, h, np.ones(len(b), dtype=np.int64))):
                    # whole numbers below 2^53 are exact in doubles
                    total[i, :, :, s] += np.bincount(offset, np.repeat(value[rows], width), width * bins).astype(np.int64).reshape(width, bins)
        i, j, k = np.nonzero(total[:, :, :, 2])
        rows = [np.concatenate([np.array(wanted, dtype=np.int64)[i], np.full(len(parts), -1)]), np.concatenate([j, np.arange(len(parts))]), np.concatenate([k, np.zeros(len(parts), dtype=np.int64)])]
        sums = np.concatenate([total[i, j, k], np.column_stack([losses[:, 0], np.zeros(len(parts), dtype=np.int64), losses[:, 1]])])
        columns = [pa.array(r, pa.int32()) for r in rows] + [pa.array(sums[:, s], pa.int64()) for s in range(3)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SUMS.split(", ")])

    found = table.select("label", "part", "bins", "score").mapInArrow(work, SUMS).groupBy("node", "feature", "bin").agg(*(F.sum(s).alias(s) for s in "ghn")).collect()
    out = {k: np.zeros((width, bins, 3), dtype=np.int64) for k in wanted}
    losses = {}
    for r in found:
        if r.node >= 0:
            out[r.node][r.feature, r.bin] = (r.g, r.h, r.n)
        elif r.n:
            losses[parts[r.feature]] = r.g / UNIT / r.n
    return out, losses


def best_split(histogram: np.ndarray, ridge: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a node; feature -1 where none gains."""
    g, h = histogram[:, :, 0] / UNIT, histogram[:, :, 1] / UNIT
    gs, hs = g[0].sum(), h[0].sum()
    a, b = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gain = a * a / (b + ridge) + (gs - a) ** 2 / (hs - b + ridge) - gs * gs / (hs + ridge)
    best = (1e-6, -1, 0)
    for j in range(len(gain)):
        k = int(np.argmax(gain[j]))
        best = max(best, (float(gain[j, k]), j, k))
    return best


def boost(
    rows: DataFrame, width: int, train: str = "train", watch: str | None = "dev", trees: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 32, ridge: float = 1.0,
    least: int = 20, patience: int = 10, keep: int = 10, edges: list[np.ndarray] | None = None,
) -> Boosted:
    """Boosted trees on the rows of part ``train``, stopped by the loss of part ``watch``; see the module for what moves."""
    own = rows.where((c("part") == train) & c("label").isNotNull())
    n, positive = own.agg(F.count("*"), F.sum(c("label").cast("double"))).first()
    if not n:
        raise ValueError("there are no training rows")
    edges = feature_edges(own, width, bins) if edges is None else edges
    base = math.log((positive / n + 1e-9) / (1 - positive / n + 1e-9))
    table = binned_rows(rows, edges, base)
    parts = [train, *sorted(r.part for r in table.where(c("part") != train).select("part").distinct().collect())]
    forest, unwritten, losses, gain_of, best = [], [], [], np.zeros(width), (math.inf, 0)
    for done in range(trees + 1):
        # the pass for the root also tells the loss of all trees so far
        found, loss = _histograms(table, width, bins, unwritten, {}, [0], parts)
        losses += [(done, p, loss[p]) for p in parts if p in loss]
        if watch in loss:
            best = min(best, (loss[watch], done))
            if done - best[1] >= patience:
                break
        if done == trees:
            break
        splits: dict[int, tuple[int, int]] = {}
        histograms, frontier = found, [0]
        for level in range(depth):
            grown = []
            for k in frontier:
                if histograms[k][0, :, 2].sum() >= least:
                    gain, j, cut = best_split(histograms[k], ridge)
                    if j >= 0:
                        splits[k] = (j, cut)
                        gain_of[j] += gain
                        grown.append(k)
            frontier = [child for k in grown for child in (2 * k + 1, 2 * k + 2)]
            if not grown:
                break
            for k in grown:
                # sums of both children from the parent's histogram: enough for leaves
                j, cut = splits[k]
                left = histograms[k][j, : cut + 1].sum(axis=0)
                for child, s in ((2 * k + 1, left), (2 * k + 2, histograms[k][j].sum(axis=0) - left)):
                    histograms[child] = np.zeros_like(histograms[k])
                    histograms[child][0, 0] = s
            if level + 1 < depth:
                counted, _ = _histograms(table, width, bins, unwritten, splits, [2 * k + 1 for k in grown], parts)
                for k in grown:
                    histograms[2 * k + 1], histograms[2 * k + 2] = counted[2 * k + 1], histograms[k] - counted[2 * k + 1]

        def tree(k: int, splits=splits, histograms=histograms):
            if k in splits:
                return (*splits[k], tree(2 * k + 1), tree(2 * k + 2))
            g, h = histograms[k][0, :, 0].sum() / UNIT, histograms[k][0, :, 1].sum() / UNIT
            return -rate * g / (h + ridge)

        forest.append(tree(0))
        unwritten.append(forest[-1])
        if len(unwritten) >= keep and done + 1 < trees:
            table, unwritten = written(with_scores(table, width, unwritten)), []
    kept = best[1] if watch in parts else len(forest)
    return Boosted(Forest(edges, base, forest[:kept]), losses, gain_of / max(gain_of.sum(), 1e-12), kept)


def with_scores(table: DataFrame, width: int, trees: list) -> DataFrame:
    """``table`` with the trees' values added to its scores."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(_scores(batch, _bins(batch, width), trees)) if batch.num_rows else batch.column("score")
            yield batch.set_column(batch.schema.get_field_index("score"), "score", score)

    return table.mapInArrow(work, table.schema)


def predict(rows: DataFrame, forest: Forest) -> DataFrame:
    """(id, label, part, p): the probability of label 1 of every row."""
    width = len(forest.edges)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = forest(_matrix(batch, width)) if batch.num_rows and forest.trees else np.full(batch.num_rows, 1 / (1 + math.exp(-forest.base)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("part"), pa.array(p)], ["id", "label", "part", "p"])

    kind = rows.schema["id"].dataType.simpleString()
    plain = rows.select("id", c("label").cast("double").alias("label"), c("part").cast("string").alias("part"), "x")
    return plain.mapInArrow(work, f"id {kind}, label double, part string, p double")


def split_metrics(predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(part, accuracy, precision, recall, f1, log_loss, n, positive, negative) of predictions; one aggregate."""
    rows = predicted.where("label is not null").withColumn("said", (c("p") >= threshold).cast("double"))
    p = F.greatest(F.least(c("p"), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = -(c("label") * F.log(p) + (1 - c("label")) * F.log(1 - p))
    g = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("positive"), F.sum(c("said") * c("label")).alias("hit"), F.sum("said").alias("called"), F.avg((c("said") == c("label")).cast("double")).alias("accuracy"), F.avg(loss).alias("log_loss"))
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide("hit", "called"), zero), F.coalesce(F.try_divide("hit", "positive"), zero)
    g = g.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), zero)
    return g.select("part", "accuracy", "precision", "recall", f1.alias("f1"), "log_loss", "n", c("positive").cast("long").alias("positive"), (c("n") - c("positive")).cast("long").alias("negative"))


def permutation_losses(rows: DataFrame, forest: Forest, groups: list[list[int]], repeats: int = 10, block_rows: int = 50_000, seed: int = 7) -> DataFrame:
    """(repeat, group, n, base, loss): mean log-loss as it is, and with a group's features moved to other rows together.

    In every repeat, rows are dealt into random blocks of about ``block_rows`` rows and the group's features change places inside
    a block, which is a permutation of all rows; a block evaluates all groups, so that rows move once per repeat.
    """
    width, n = len(forest.edges), rows.where("label is not null").count()
    blocks = max(1, math.ceil(n / block_rows))
    block = F.pmod(F.xxhash64(F.lit(seed), "repeat", "id"), F.lit(blocks)).cast("int")
    dealt = rows.where("label is not null").select("id", c("label").cast("double").alias("label"), "x", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    dealt = dealt.withColumn("block", block).withColumn("place", F.xxhash64(F.lit(seed + 1), "repeat", "id"))

    def work(table: pa.Table) -> pa.Table:
        batch = table.sort_by([("place", "ascending")]).combine_chunks().to_batches()[0]
        x, label, repeat = _matrix(batch, width), batch.column("label").to_numpy(), batch.column("repeat")[0].as_py()
        rng = np.random.default_rng([seed, repeat, batch.column("block")[0].as_py()])
        base = np.floor(log_loss(label, forest(x)) * UNIT + 0.5).sum()
        sums = []
        for members in groups:
            held = x[:, members].copy()
            x[:, members] = held[rng.permutation(len(x))]
            sums.append(np.floor(log_loss(label, forest(x)) * UNIT + 0.5).sum())
            x[:, members] = held
        k = len(groups)
        return pa.table({"repeat": pa.array([repeat] * k, pa.int32()), "group": pa.array(range(k), pa.int32()), "n": pa.array([len(x)] * k, pa.int64()), "base": pa.array([int(base)] * k, pa.int64()), "loss": pa.array([int(s) for s in sums], pa.int64())})

    found = dealt.groupBy("repeat", "block").applyInArrow(work, "repeat int, group int, n long, base long, loss long")
    g = found.groupBy("repeat", "group").agg(F.sum("n").alias("n"), *((F.sum(s) / F.sum("n") / UNIT).alias(s) for s in ("base", "loss")))
    return g.select("repeat", "group", "n", "base", "loss")


def permutation_importance(rows: DataFrame, forest: Forest, groups: list[list[int]] | None = None, repeats: int = 10, block_rows: int = 50_000, seed: int = 7) -> DataFrame:
    """(group, mean, se): loss added by moving each feature, or each group of features together, as a share of the loss."""
    groups = [[j] for j in range(len(forest.edges))] if groups is None else groups
    added = permutation_losses(rows, forest, groups, repeats, block_rows, seed).select("group", ((c("loss") - c("base")) / F.greatest(F.abs("base"), F.lit(1e-12))).alias("added"))
    return added.groupBy("group").agg(F.avg("added").alias("mean"), (F.stddev_pop("added") / math.sqrt(repeats)).alias("se"))


def clustered_importance(rows: DataFrame, forest: Forest, clusters: list[list[int]], repeats: int = 10, top: int | None = None, block_rows: int = 50_000, seed: int = 7) -> DataFrame:
    """(cluster, feature, mean, se): clusters moved as wholes (feature null), and the features of those above zero, the ``top`` of them."""
    whole = permutation_importance(rows, forest, clusters, repeats, block_rows, seed).select(c("group").alias("cluster"), F.lit(None).cast("int").alias("feature"), "mean", "se")
    whole = written(whole)
    chosen = [r.cluster for r in whole.where("mean > 0").orderBy(F.desc("mean"), "cluster").limit(top or len(clusters)).collect()]
    members = [(k, j) for k in chosen for j in clusters[k]]
    if not members:
        return whole
    inside = permutation_importance(rows, forest, [[j] for _, j in members], repeats, block_rows, seed)
    of = F.element_at(F.lit([k for k, _ in members]), c("group") + 1), F.element_at(F.lit([j for _, j in members]), c("group") + 1)
    return whole.unionByName(inside.select(of[0].cast("int").alias("cluster"), of[1].cast("int").alias("feature"), "mean", "se"))


def selection_report(rows: DataFrame, width: int, repeats: int = 10, top: int | None = None, critical: float = 1.96, block_rows: int = 50_000, seed: int = 7, **options) -> tuple[Boosted, DataFrame]:
    """The whole of a selection in one call: clusters by correlation, a model on ``train``, importance of clusters and of the features inside, and what stays.

    (the model, (cluster, feature, mean, se, silhouette, gain, kept)): features of chosen clusters stay where their importance on the other
    parts lies above zero beyond its error. The correlation is one matrix of products per task.
    """
    filled = rows.where((c("part") == "train") & c("x").isNotNull()).select(F.transform(F.slice("x", 1, width), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))).alias("x")).where(F.size("x") == width)
    r = np.eye(width)
    for cell in risk.vector_correlation(filled, "x").collect():
        r[cell.i, cell.j] = 0.0 if cell.corr is None else cell.corr
    clusters = risk.onc(r)
    model = boost(rows, width, **options)
    table = clustered_importance(rows.where(c("part") != "train"), model.forest, clusters.members, repeats, top, block_rows, seed)
    told = [(int(i), float(s), float(model.gain[i])) for i, _, s in risk.feature_silhouettes(r, clusters)]
    facts = rows.sparkSession.createDataFrame(told, "feature int, silhouette double, gain double")
    kept = c("feature").isNotNull() & (c("mean") - critical * c("se") > 0)
    return model, table.join(F.broadcast(facts), "feature", "left").select("cluster", "feature", "mean", "se", "silhouette", "gain", kept.alias("kept"))


def importance_shift(train: DataFrame, dev: DataFrame, drop: float = 0.3) -> DataFrame:
    """(group, train_mean, dev_mean, train_rank, dev_rank, dropped, rank_correlation) of two tables of importances.

    Dropped is a feature whose importance falls by more than ``drop`` of its value. A row per feature: the windows see no more.
    """
    both = train.select("group", c("mean").alias("train_mean")).join(dev.select("group", c("mean").alias("dev_mean")), "group")
    ranked = both.selectExpr("*", "rank() over (order by train_mean desc) as train_rank", "rank() over (order by dev_mean desc) as dev_rank")
    fell = F.coalesce(F.try_divide(c("train_mean") - c("dev_mean"), c("train_mean")) > drop, F.lit(False)) & (c("train_mean") > 0)
    rho = ranked.agg(F.corr("train_rank", "dev_rank").alias("rank_correlation"))
    return ranked.withColumn("dropped", fell).crossJoin(rho)

"""N-gram Jaccard join of a table with itself, by a MinHash LSH forest and exact verification.

A document is the set of its shingles: runs of five lower-cased words (one run of all words where there
are fewer). Documents with equal sets form a class of copies; each has one representative.

Every representative has a signature of ``trees`` labels of ``FULL_DEPTH`` MinHash values. The labels of a
tree, sorted, are its prefix trie; labels that share not even the shortest prefix with another are no part
of the forest. Matching starts at the full depth: two representatives are candidates where their labels in
some tree agree so far. They are verified exactly, by their whole shingle sets, and the similarities of what
was found, weighted by the chance with which the matched depth finds such a pair, tell the recall reached.
Below the target, prefixes are shortened to the longest depth that promises it, and what meets there for
the first time is verified. At the shortest depth a pair at the threshold itself is found with the target
recall, whatever the others are like.

A pair is verified in the first tree where it meets, and buckets with equal members count once. A bucket
that is too large for one task is dealt into blocks, and each pair of blocks is one task's work, so that
links are counted and components joined without a row per pair.

Result: one row per document with its class (the least id of all documents that verified links connect)
and its number of links (documents with similarity of at least the threshold, equal ones included).

Null, empty and wordless texts have no shingles and no links; each is its own class. Texts of any length
are read whole. Repeated rows and ids are distinct documents; with ids alike, the least id stands for
all. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_piece, pieces, texts_of
from tidemark.llm.components import connected_components
from tidemark.llm.hashing import forget_words, seeds, unique_per_text, windows, word_hashes, words_of
from tidemark.llm.storage import cut

WIDTH = 5
THRESHOLD = 0.8
TREES = 16
FULL_DEPTH = 8
RECALL = 0.9995
#: Representatives, and bytes of their sets, in a block of a bucket that is too large for one task.
BLOCK = 1024
BLOCK_BYTES = 2 << 20
#: Bytes of text whose shingles a worker makes at once.
TEXT_BYTES = 1 << 19
#: Bins of the similarities from the threshold to one.
BINS = 20


def meeting(similarity, depth: int, trees: int):
    """The chance that a pair agrees on ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_depth(threshold: float, trees: int, full: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets with the target recall."""
    depth = full
    while depth > 1 and meeting(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def next_depth(found: np.ndarray, threshold: float, trees: int, depth: int, shortest: int, recall: float) -> int | None:
    """The depth to shorten prefixes to, None where ``depth`` has reached the target recall.

    ``found`` counts the links per bin of similarity. Each stands for as many as the chance to find it
    says; one more pair at the threshold itself is taken to exist, so that few links prove little.
    """
    similar = threshold + (np.arange(BINS) + 0.5) * (1 - threshold) / BINS
    there = np.append(found / meeting(similar, depth, trees), 1.0)
    similar = np.append(similar, threshold)
    expected = lambda d: float((there * meeting(similar, d, trees)).sum() / there.sum())
    if depth <= shortest or expected(depth) >= recall:
        return None
    return max((d for d in range(shortest, depth) if expected(d) >= recall), default=shortest)


def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their number per text."""
    words, counts = words_of(texts)
    values, per_text = windows(word_hashes(words), counts, width)
    return unique_per_text(values, per_text)


def signatures(sets: np.ndarray, counts: np.ndarray, values: int) -> np.ndarray:
    """``values`` MinHash values of 32 bits for each text; rows of empty sets are zero."""
    out = np.zeros((len(counts), values), dtype=np.uint32)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    first = (np.cumsum(counts) - counts)[filled]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    factors, offsets = ((seeds(values, salt) >> np.uint64(32)).astype(np.uint32) for salt in (7, 77))
    hashed = np.empty_like(x)
    for k in range(values):
        np.multiply(x, factors[k] | np.uint32(1), out=hashed)
        np.add(hashed, offsets[k], out=hashed)
        out[filled, k] = np.minimum.reduceat(hashed, first)
    return out


def _content() -> F.Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content")


def _signed(docs: DataFrame, width: int, values: int) -> DataFrame:
    """(doc_id, content, set_key, sig, size): content addresses the text, set_key the shingle set of ``size`` bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, counts = shingle_sets(texts_of(batch), width)
        sig = signatures(sets, counts, values).astype(">u4")
        ends = np.cumsum(counts)
        keys = [xxhash.xxh128_digest(sets[e - n : e].tobytes()) if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("content"), pa.array(keys, pa.binary()),
                pa.array([row.tobytes() if n else None for row, n in zip(sig, counts.tolist(), strict=True)], pa.binary()), pa.array(8 * counts, pa.int64()),
            ],
            ["doc_id", "content", "set_key", "sig", "size"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _content(), "text")
    return rows.mapInArrow(by_piece(work, "text", limit=TEXT_BYTES, done=forget_words), "doc_id long, content binary, set_key binary, sig binary, size long")


def similarities(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Jaccard similarities of all pairs of sets; within ``left`` where ``right`` is None."""
    both = left if right is None else [*left, *right]
    sizes = np.array([len(x) for x in both])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    term = np.cumsum(np.concatenate(([0], (flat[1:] != flat[:-1]).astype(np.int64))))
    shared = np.bincount(term)[term] > 1
    term, owner = np.unique(term[shared], return_inverse=True)[1], owner[shared]
    n, m = len(left), 0 if right is None else len(right)
    common = np.zeros((n, m or n), dtype=np.float32)
    step = max(1, (2 << 20) // len(both))
    bounds = np.searchsorted(term, np.arange(0, (term[-1] + 1 if len(term) else 0) + step, step))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if a == b:
            continue
        x = np.zeros((len(both), int(term[b - 1]) - k * step + 1), dtype=np.float32)
        x[owner[a:b], term[a:b] - k * step] = 1
        common += x[:n] @ (x if right is None else x[n:]).T
    return common / (sizes[:n, None] + (sizes[None, :] if right is None else sizes[None, n:]) - common)


def _spanning(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """For each id with a link the least id it is connected to within ``linked`` (symmetric)."""
    left = np.ones(len(ids), dtype=bool)
    out = []
    for start in np.argsort(ids, kind="stable").tolist():
        if not left[start]:
            continue
        reached = np.zeros(len(ids), dtype=bool)
        front = np.zeros(len(ids), dtype=bool)
        reached[start] = front[start] = True
        while front.any():
            front = linked[front].any(axis=0) & ~reached
            reached |= front
        left &= ~reached
        out += [(int(ids[i]), int(ids[start])) for i in np.flatnonzero(reached).tolist() if i != start]
    return out


def _met_before(sig: np.ndarray, tree: int, depth: int, before: int | None) -> list[np.ndarray]:
    """For each earlier place to meet, a number per row that is equal for the rows that meet there."""
    places = [(t, depth) for t in range(tree)] + [(t, before) for t in range(sig.shape[1]) if before]
    return [np.unique(np.ascontiguousarray(sig[:, t, :d]).view(f"V{4 * d}").ravel(), return_inverse=True)[1] for t, d in places]


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal ``keys`` in a partition sorted by them; one run is held at a time."""
    current: tuple | None = None
    rows: list[dict] = []
    for piece in (p for batch in batches for p in pieces(batch, "set", "sig")):
        for row in piece.to_pylist():
            if (key := tuple(row[k] for k in keys)) != current:
                if rows:
                    yield rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _verified(threshold: float, trees: int, depth: int, before: int | None):
    """Work on rows sorted by bucket and pair of blocks.

    Gives link counts (u, null, links), spanning edges (u, v, 0) and, per bin of similarity, numbers of
    links (null, bin, links).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS, dtype=np.int64)
        out: list[tuple] = []
        for rows in _grouped(batches, ["tree", "prefix", "one", "two"]):
            tree, one, two = (rows[0][k] for k in ("tree", "one", "two"))
            side = np.array([r["block"] for r in rows])
            if one != two and (side == side[0]).all():
                continue
            rows = [rows[i] for i in np.argsort(side != one, kind="stable").tolist()]
            n = len(rows) if one == two else int((side == one).sum())
            sets = [np.frombuffer(r["set"], dtype=np.uint64) for r in rows]
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), dtype=np.uint32).reshape(len(rows), trees, -1)
            ids = np.array([r["rep"] for r in rows], dtype=np.int64)
            weight = np.array([r["copies"] for r in rows], dtype=np.int64)
            a, b = slice(0, n), slice(0, n) if one == two else slice(n, None)
            new = np.ones((n, n if one == two else len(rows) - n), dtype=bool)
            for place in _met_before(sig, tree, depth, before):
                new &= place[a, None] != place[None, b]
            if one == two:
                np.fill_diagonal(new, False)
            if not new.any():
                continue
            similar = similarities(sets[a], None if one == two else sets[b])
            linked = new & (similar >= threshold - 1e-6)
            if not linked.any():
                continue
            at = np.minimum(((similar[linked] - threshold) / (1 - threshold) * BINS).astype(np.int64).clip(0), BINS - 1) if threshold < 1 else np.full(int(linked.sum()), BINS - 1)
            bins += np.bincount(at, minlength=BINS) // (2 if one == two else 1)
            if one == two:
                whole, links = linked, linked @ weight
            else:
                links = np.concatenate((linked @ weight[b], linked.T @ weight[a]))
                whole = np.zeros((len(rows), len(rows)), dtype=bool)
                whole[a, b], whole[b, a] = linked, linked.T
            out += [(u, None, w) for u, w in zip(ids.tolist(), links.tolist(), strict=True) if w]
            out += [(u, v, 0) for u, v in _spanning(whole, ids)]
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch([*out, *((None, k, w) for k, w in enumerate(bins.tolist()) if w)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["u", "v", "links"])


def _forest(reps: DataFrame, trees: int, full: int, shortest: int) -> DataFrame:
    """(tree, label, rep, size), sorted: the labels of those that share at least one shortest prefix with another."""
    label = F.substring("sig", F.col("tree") * (4 * full) + 1, F.lit(4 * full)).alias("label")
    number = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    labels = lambda some: some.select("rep", "size", "sig", number).select("tree", label, "rep", "size")
    nodes = labels(reps).select(F.xxhash64("tree", F.substring("label", 1, 4 * shortest)).alias("node"), "rep")
    shared = cut(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), narrow=True)
    inside = cut(nodes.join(shared.hint("merge"), "node", "left_semi").select("rep").distinct(), narrow=True)
    forest = labels(reps.join(inside.hint("merge"), "rep", "left_semi"))
    return cut(forest.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label"))


def _sets(docs: DataFrame, reps: DataFrame, forest: DataFrame, width: int) -> DataFrame:
    """(rep, copies, sig, set) of the representatives in the forest; a text moves once, copies are dropped before."""
    wanted = cut(reps.join(forest.select("rep").distinct().hint("merge"), "rep", "left_semi").select("rep", "content", "copies", "sig"))
    texts = docs.select(_content(), F.coalesce("text", F.lit("")).alias("text")).groupBy("content").agg(F.first("text").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, counts = shingle_sets(texts_of(batch), width)
        each = [x.tobytes() for x in np.split(sets, np.cumsum(counts)[:-1])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "sig")), pa.array(each, pa.binary())], ["rep", "copies", "sig", "set"])

    joined = texts.join(wanted.hint("merge"), "content").select("rep", "copies", "sig", "text")
    return cut(joined.mapInArrow(by_piece(work, "text", limit=TEXT_BYTES, done=forget_words), "rep long, copies long, sig binary, set binary"))


def _round(forest: DataFrame, sets: DataFrame, seen: DataFrame | None, threshold: float, trees: int, depth: int, before: int | None, block: int) -> tuple[DataFrame, DataFrame]:
    """What pairs that meet at ``depth`` for the first time give, and the member sets of the buckets so far."""
    at = forest.select("tree", F.substring("label", 1, 4 * depth).alias("prefix"), "rep", "size")
    buckets = at.groupBy("tree", "prefix").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("mark")
    )
    members = ["n", "low", "mark"]
    first = buckets.where("n > 1").groupBy(*members).agg(F.min(F.struct("tree", "prefix", "size")).alias("first"))
    if seen is not None:
        first = first.join(seen.hint("merge"), members, "left_anti")
    first = cut(first.select(*members, "first.*"), narrow=True)
    blocks = F.ceil(F.least(F.greatest(F.col("n") / block, F.col("size") / BLOCK_BYTES), F.col("n"))).cast("int")
    placed = at.drop("size").join(first.select("tree", "prefix", blocks.alias("blocks")).hint("merge"), ["tree", "prefix"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    keys = ["tree", "prefix", "one", "two"]
    dealt = placed.select("tree", "prefix", "rep", "block", other).select(
        "tree", "prefix", "rep", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(sets.hint("merge"), "rep").repartition(parts, *keys).sortWithinPartitions(*keys)
    checked = cut(dealt.mapInArrow(_verified(threshold, trees, depth, before), "u long, v long, links long"))
    now = first.select(*members)
    return checked, now if seen is None else seen.unionByName(now)


def _links(docs: DataFrame, reps: DataFrame, threshold: float, width: int, trees: int, recall: float, block: int) -> DataFrame:
    """(u, v, links) of all rounds: prefixes are shortened until the target recall."""
    shortest = shortest_depth(threshold, trees, FULL_DEPTH, recall)
    forest = _forest(reps, trees, FULL_DEPTH, shortest)
    sets = _sets(docs, reps, forest, width)
    rounds: list[DataFrame] = []
    found = np.zeros(BINS)
    seen, before, depth = None, None, FULL_DEPTH
    while depth is not None:
        checked, seen = _round(forest, sets, seen, threshold, trees, depth, before, block)
        rounds.append(checked)
        for r in checked.where("u is null").groupBy("v").agg(F.sum("links").alias("n")).collect():
            found[r.v] += r.n
        before, depth = depth, next_depth(found, threshold, trees, depth, shortest, recall)
    return reduce(DataFrame.unionByName, rounds)


def near_classes(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id, content, class_key (of the class), class_id and n_links.

    ``class_key`` is equal for exactly the documents of a class, also where ids are not unique.
    """
    rows = cut(_signed(docs, width, trees * FULL_DEPTH).withColumn("row", F.monotonically_increasing_id()))
    filled = rows.where(F.col("set_key").isNotNull())
    # the representative of copies is their first row; its text is found again by content
    one = F.min(F.struct("row", "content", "sig", "size")).alias("one")
    reps = filled.groupBy("set_key").agg(one, F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    reps = cut(reps.select("set_key", "one.*", "copies", "least").withColumnRenamed("row", "rep"))
    checked = _links(docs, reps, threshold, width, trees, recall, block)

    links = checked.where("u is not null and v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    joined = connected_components(checked.where("u is not null and v is not null").select("u", "v"))
    classes = reps.select("set_key", "rep", "copies", "least").join(joined.hint("merge"), F.col("rep") == F.col("node"), "left").join(links.hint("merge"), "rep", "left")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    classes = cut(classes.select("set_key", F.coalesce("root", "rep").alias("class_key"), "least", n_links), narrow=True)
    least = cut(classes.groupBy("class_key").agg(F.min("least").alias("class_id")), narrow=True)
    classes = cut(classes.join(least.hint("merge"), "class_key").select("set_key", "class_key", "class_id", "links"), narrow=True)
    return rows.select("doc_id", "content", "row", "set_key").join(classes.hint("merge"), "set_key", "left").select(
        "doc_id", "content", F.coalesce("class_key", F.col("row")).alias("class_key"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one document of each class: the least id, then the least content.

    Rows alike in id and text are one document, so one of them stays.
    """
    found = near_classes(docs, **options)
    first = found.groupBy("class_key").agg(F.min(F.struct("doc_id", "content")).alias("first")).select("first.*")
    kept = cut(first.distinct(), narrow=True)
    # a row travels as one value, so that its columns may have any names
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _content().alias("own"), F.struct(*docs.columns).alias("whole"))
    joined = rows.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("content")), "left_semi")
    return joined.dropDuplicates(["id", "own"]).select("whole.*")

"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import cut


_SALTS = 16


def _handed(edges: DataFrame, least: DataFrame, end: str) -> DataFrame:
    """``edges`` with the row of ``least`` (c, ...) whose c is the node at their ``end``."""
    other = "u" if end == "v" else "v"
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(_SALTS)).cast("int"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(spread.hint("merge"), (F.col(end) == F.col("c")) & (salted.salt == spread.salt)).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges`` (u, v longs).

    Alternating large and small stars: every round hangs nodes under smaller neighbours until each
    hangs under its root. The table keeps at most as many edges as it began with; rounds grow with the
    logarithm of the longest path. Nulls and loops are ignored; repeated edges count once. The joins that
    hand a node's least neighbour to its edges are salted, so that the edges of one node spread over tasks.
    """
    edges = cut(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), narrow=True
    )
    before = None
    while True:
        # large star: all larger neighbours of a node hang under the least of its neighbours and itself
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # an edge (u, v), u > v, seen from v: u is the larger neighbour of v
        large = _handed(edges, least, "v").select("u", F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: smaller neighbours of a node, and itself, hang under the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = _handed(large, low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct(), narrow=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Bounded samples for fitting models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, rows: int, salt: str, key: str = "doc_id", also: tuple[str, ...] = ()) -> list[Row]:
    """About ``rows`` rows of ``df`` (all, where it has fewer), chosen by a hash of ``key``; never over twice as many.

    ``also`` names columns that the hash takes in, for tables where many rows share one key.

    The table is counted first and rows whose hash lies under the wanted share are kept, so that the
    driver gets the sample itself and not a part of it from every partition. The same rows are chosen
    however the table is partitioned, unless so many share one key that the bound has to cut them.
    """
    n = df.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64(F.lit(salt), key, *also), F.lit(1 << 40))
    return df.where(draw < int(min(1.0, rows / n) * (1 << 40))).limit(2 * rows).collect()


def bounded_sample_of_each(df: DataFrame, group: str, rows: int, in_all: int, salt: str, key: str = "doc_id", also: tuple[str, ...] = ()) -> list[Row]:
    """As ``bounded_sample``, but of each value of ``group`` about ``rows`` rows, or its part of ``in_all`` where that is more.

    Groups are counted first, and each has its own share of the hashes. Never over twice as many rows in all.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group).count().collect()
    if not counts:
        return []
    part = in_all / sum(r["count"] for r in counts)
    wanted = {r[group]: min(1.0, max(rows / r["count"], part)) for r in counts}
    bounds = [(value, int(share * (1 << 40))) for value, share in wanted.items()]
    limit = math.ceil(2 * sum(wanted[r[group]] * r["count"] for r in counts))
    shares = df.sparkSession.createDataFrame(bounds, f"`_group` {df.schema[group].dataType.simpleString()}, `_bound` long")
    draw = F.pmod(F.xxhash64(F.lit(salt), key, *also), F.lit(1 << 40))
    drawn = df.withColumn("_draw", draw).join(F.broadcast(shares), F.col(group) == F.col("_group")).where("_draw < _bound")
    return drawn.select(*df.columns).limit(limit).collect()

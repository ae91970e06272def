"""Reliable cuts of lineage: every cut is a table in the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it names none, its warehouse, which is shared as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read from there.

    Narrow tables, of keys and numbers, take an eighth of the files that a shuffle would give: their rows are
    so small that the files would be too.

    A lost executor loses nothing of it, readers take the columns they need, and its size is known. (A
    checkpointed frame keeps the estimate of its plan instead; loops of joins multiply such estimates until
    planning itself takes longer than the work.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if narrow:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

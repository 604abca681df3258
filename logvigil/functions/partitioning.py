"""Partitioning helpers for CPU-bound Python stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def groups_partitions(df: DataFrame) -> int:
    """Partition count for a keyed CPU-heavy stage: the session's shuffle
    partitions, but never fewer than the cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)

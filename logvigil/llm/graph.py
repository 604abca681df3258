"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import durable


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node that each linked node can reach.

    Every round takes the smallest label around each node, then jumps to that
    label's own label, so paths halve; rounds are checkpointed.  A node's
    links meet in partial minima only, so hubs are not gathered."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    both = durable(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = durable(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                     .select("node", F.least("node", "m").alias("comp")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v") \
            .groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp",
                                                F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = durable(step.join(up, "low", "left").select(
            "node", F.least("low", F.coalesce("up", "low")).alias("comp"),
            (F.col("comp") != F.least("low", F.coalesce("up", "low"))).alias("moved")))
        labels = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlake.llm._shared import checkpointed


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over ``links``, for every node that has a link.

    Each round takes the smallest label among a node's neighbours and then follows the label once
    (pointer jumping), so rounds grow with the logarithm of a component's width. Every round is
    checkpointed in the shared folder. Null ends and links of a node to itself are ignored. An empty
    link table gives an empty result. Labels are joined by sort-merge joins, which Spark splits when a
    component's label is hot; neighbour minima are summed up before the shuffle.
    """
    down = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct())
    # every node keeps the link to its smallest neighbour, which takes over the others
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    pairs = down.join(least, "u").select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))
    both = checkpointed(pairs.union(pairs.select(F.col("v"), F.col("u"))).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = checkpointed(lower.join(roots, "label").select("node", "old", F.least("label", "root").alias("label")))
        labels = step.select("node", "label")
        if step.where("label < old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))

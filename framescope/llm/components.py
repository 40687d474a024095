"""Connected components by spreading the smallest label, with every round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.storage import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (smallest node that links reach) for every node of a link.

    Each round takes the least label among a node and its neighbours, then the label of that label, so stars need two
    rounds and long chains about the logarithm of their length.  Minima are taken before the shuffle, so a node with very many
    links costs no task more than its share; nothing but the number of changes reaches the driver."""
    edges = stored(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    labels = stored(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stored(lower.join(root, "label").select("node", "old", F.least("label", "root").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label != old").limit(1).count() == 0:
            return labels

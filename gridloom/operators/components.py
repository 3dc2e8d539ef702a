"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import checkpoint


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every node.

    Every round a node takes the smallest label among its neighbours and then
    the label of that label, so chains shrink geometrically. Minima combine
    before the shuffle, and each round is checkpointed.
    """
    both = edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    both = checkpoint(both.distinct())
    labels = checkpoint(nodes.select("id", F.col("id").alias("component")))
    while True:
        heard = (
            both.join(labels, F.col("src") == F.col("id"))
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min("component").alias("heard"))
        )
        nearer = labels.join(heard, "id", "left").select(
            "id", "component", F.least("component", F.coalesce("heard", "component")).alias("low")
        )
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        after = checkpoint(
            nearer.join(jump, "low", "left").select(
                "id", "component", F.least("low", F.coalesce("far", "low")).alias("after")
            )
        )
        changed = after.filter(F.col("after") < F.col("component")).limit(1).count()
        labels = after.select("id", F.col("after").alias("component"))
        if not changed:
            return labels

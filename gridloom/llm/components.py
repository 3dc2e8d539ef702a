"""Connected components over a table of links, for near-duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Ids are not null. Each round every id takes the smallest label among itself,
    its neighbours and the label of its label, so long chains shrink fast. Minima
    combine before the shuffle, an id with very many links is only ever the
    larger side of a join on a shuffled key (split by adaptive execution), and
    each round is written to the shared folder, so lost executors cost one round.
    """
    links = links.filter("a <> b").select("a", "b")
    both = checkpoint(links.unionByName(links.selectExpr("b AS a", "a AS b")).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "id").select("id", "label", F.least("label", "heard").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        after = checkpoint(near.join(jump, "low", "left").select("id", "label", F.least("low", F.coalesce("far", "low")).alias("next")))
        changed = not after.filter("next < label").isEmpty()
        labels = after.select("id", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")

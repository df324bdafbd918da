"""Connected components of a graph of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch, written


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node in links(a, b), as a written table.

    Each round gives a node the smallest label around it and then follows labels
    of labels, so that the rounds needed grow with the logarithm of a
    component's length. Every round is a written table. The many links of a hub are
    one key of a join whose skewed partitions Spark splits. Joins are merged at every
    size, so that no table that grows with the links is broadcast.
    """
    with Scratch(links.sparkSession) as scratch:
        both = scratch.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
        labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
        for _ in range(rounds):
            around = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
            nearer = labels.join(around.hint("merge"), labels.node == around.a).select("node", "root", F.least("root", "near").alias("next"))
            over = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
            follow = F.least("next", F.coalesce("far", "next"))
            followed = nearer.join(over.hint("merge"), nearer.next == over.via, "left")
            after = scratch.written(followed.select("node", follow.alias("root"), (follow != F.col("root")).alias("moved")), "labels")
            labels = after.select("node", "root")
            if after.where("moved").isEmpty():
                return written(labels, "roots")
    raise RuntimeError(f"components still change after {rounds} rounds")

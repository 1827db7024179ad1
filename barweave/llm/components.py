"""Connected components of a link table, by contraction, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by
    doubling, and contracts the links; links between the ends are few, and none are left after about
    log(nodes) rounds.  Every step is a written table joined by key, so a node with many links is an
    ordinary skewed join.
    """
    labels = None
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.keep(ordered.filter("a < b").distinct(), "edges")
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        parent = scratch.keep(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            jumped = scratch.keep(parent.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")), "jumped")
            scratch.drop(parent)
            parent, moved = jumped, not jumped.filter("moved").isEmpty()
            if not moved:
                break
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), "parent")
            labels = scratch.keep(labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        ends = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = edges.join(ends[0], "a").join(ends[1], "b").filter("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = scratch.keep(left.distinct(), "edges")
        if edges.isEmpty():
            return labels

"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


class Union:
    """Components that pairs have joined so far, inside a task."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def joins(self, x: int, y: int) -> bool:
        """Joins two components; false if they were one."""
        x, y = self.top(x), self.top(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, component) of all nodes (rep, ...), linked or not."""
    found = connected_components(links)
    return nodes.select("rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so
    distances shrink by more than half where chains are long. Labels are written after each round; the driver
    sees one count. Aggregates combine before they shuffle, and joins are plain equi-joins whose hot sides
    Spark splits. Links of a node with itself and repeated links do no harm; null ends are left out.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stash(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = stash(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        far = hooked.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = stash(hooked.join(far, "label").select("node", "old", F.least("label", "far").alias("label")))
        changed = jumped.where(F.col("label") != F.col("old")).limit(1).count()
        discard(labels, hooked)
        labels = jumped
        if not changed:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))

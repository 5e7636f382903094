"""Connected components of a link table, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.session import cut


def _to_roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by its root, doubling the jumps until nothing moves."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = cut(parents.join(above, "parent").select("node", F.col("next").alias("parent"),
                                                           (F.col("next") != F.col("parent")).alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that can be reached.

    Each round every node hooks to its smallest neighbour, trees collapse to their roots, and links between roots go
    on. At least half of the nodes that still have links vanish per round. Rounds are written to the shared folder;
    only yes-or-no answers come to the driver. Links that are null on a side or link a node with itself do nothing.
    """
    open_ = links.select("a", "b").filter("a <> b")
    labels = None
    while True:
        both = cut(open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        if both.isEmpty():
            break
        parents = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent")).withColumnRenamed("a", "node")
        roots = _to_roots(cut(parents))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("component"))
        else:
            step = roots.select(F.col("node").alias("component"), "parent")
            labels = cut(labels.join(step, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")))
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        open_ = both.filter("a < b").join(left, "a").join(right, "b").filter("ra <> rb").select(
            F.col("ra").alias("a"), F.col("rb").alias("b"))
    if labels is None:
        kind = links.schema["a"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return labels

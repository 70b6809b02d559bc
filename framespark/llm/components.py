"""Connected components of an edge table, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _roots(hook: DataFrame) -> DataFrame:
    """Pointer jumping: ``hook(node, parent)`` with parent < node or a root; every node gets its root."""
    while True:
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hook = materialize(
            hook.join(up, "parent", "left").select(
                "node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")
            ),
            "roots",
        )
        if hook.filter("moved").isEmpty():
            return hook.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids to ``(node, component)``: the smallest id that each node can reach.

    Every round hooks each component to its smallest neighbour, follows those pointers to their roots and contracts
    the edges, so rounds are logarithmic in the longest path. Loops and repeated edges do no harm; null ends are
    left out. Hubs are met only in partial aggregates and in joins that adaptive execution can split.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = materialize(edges, "edges")
    labels = None
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        hook = _roots(materialize(hook, "hook"))
        if labels is None:
            labels = hook.select("node", F.col("parent").alias("component"))
        else:
            moved = hook.select(F.col("node").alias("component"), "parent")
            old = labels.join(moved, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
            labels = old.unionByName(hook.select("node", F.col("parent").alias("component")))
            labels = labels.groupBy("node").agg(F.min("component").alias("component"))
        labels = materialize(labels, "labels")
        up = hook.select("node", "parent")
        edges = (
            edges.join(up.withColumnsRenamed({"node": "a", "parent": "pa"}), "a", "left")
            .join(up.withColumnsRenamed({"node": "b", "parent": "pb"}), "b", "left")
            .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter("a < b")
            .distinct()
        )
        edges = materialize(edges, "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    top = labels.select(F.col("component").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(top.select("node", F.col("node").alias("component")))

"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadframe.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for edges ``(a, b)``; a component is named by its smallest node.

    Labels move along edges and then jump to their label's label, so the number of rounds grows with the
    logarithm of a component's diameter.  Each round ends in a reliable checkpoint.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("via"))
        step = cut(moved.join(jump, "to", "left").select("node", "was", F.least("to", "via").alias("component")))
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels


def merged(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``found`` with more edges: these join components, so only their names are nodes of the search.

    Nodes that ``found`` doesn't have are components of their own.
    """
    name = lambda s: found.select(F.col("node").alias(s), F.col("component").alias(f"{s}_component"))
    ends = [F.coalesce(f"{s}_component", s).alias(s) for s in ("a", "b")]
    renamed = connected_components(edges.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left").select(*ends))
    moved = renamed.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(known.unionByName(renamed.join(found, "node", "left_anti")))

"""Connected components by least labels with pointer jumping, all in DataFrames.

Defined results: repeated edges and edges of a node to itself change nothing (a node with
no other edge has no row); rows with a null end are no edges; no edges give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; a component is named by its least node.

    In a step every node takes the least label around it and then that label's own label, so
    chains halve. Steps are linear in the edges; a hub's neighbours are aggregated before they
    are shuffled, and adaptive execution splits the join at a hub.
    """
    both = edges.where(F.col("u") != F.col("v"))
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")))
    total = None
    while True:
        # Labels only sink, so an equal sum means that none has changed.
        reached = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).collect()[0][0]
        if reached == total:
            return labels
        total = reached
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("to"))
        above = labels.select(F.col("node").alias("to"), F.col("component").alias("up"))
        labels = cut(lower.join(above, "to").select("node", F.least("to", "up").alias("component")))

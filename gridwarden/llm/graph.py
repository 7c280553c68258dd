"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    Each round every node points to the smallest of itself and its neighbours, pointers are followed to
    their ends by doubling, and edges are rewritten between the ends. Any node that still has a neighbour joins another
    one, so the nodes with edges at least halve each round. A hot node costs one partial minimum per task.
    """
    live = cut_lineage(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        to = cut_lineage(to, "pointers")
        while True:
            further = to.select(F.col("node").alias("_at"), F.col("to").alias("_to"))
            jumped = to.join(further, F.col("to") == F.col("_at")).select("node", F.col("_to").alias("new"), (F.col("_to") != F.col("to")).alias("_moved"))
            jumped = cut_lineage(jumped, "pointers")
            moved = not jumped.filter("_moved").isEmpty()
            to = jumped.select("node", F.col("new").alias("to"))
            if not moved:
                break
        rounds.append(to)
        at_a = to.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        at_b = to.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        live = cut_lineage(live.join(at_a, "a").join(at_b, "b").filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[0].select("node", F.col("to").alias("component"))
    for to in rounds[1:]:
        later = to.select(F.col("node").alias("component"), "to")
        out = out.join(later, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut_lineage(out, "components")


def joined_components(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components after more edges: only edges between known components are worked on."""
    if labels is None:
        return components(edges)
    at_a = labels.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    at_b = labels.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    between = edges.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    between = cut_lineage(between.filter("a != b").distinct(), "edges")
    if between.isEmpty():
        return labels
    to = components(between)
    every = labels.union(to.select("node", F.col("node").alias("component"))).distinct()
    later = to.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return cut_lineage(every.join(later, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "components")

"""Connected components of a graph given as edges, by repeated contraction.

Every vertex hooks to its smallest neighbour, parents are followed once more, and the edges are
rewritten to the parents; the vertices that still have an edge at least halve in each round. Nothing
is collected: one row per vertex and per edge, minima are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Loops, repeated edges and either direction are allowed; edges with a null end are left out. No
    edges give an empty table.
    """
    links = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = settle(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "hooks")
        above = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        labels = settle(hooks.join(above, "parent").select("node", "root"), "labels")
        rounds.append(labels)
        left = labels.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
        right = labels.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
        moved = links.join(left, "a").join(right, "b").where("a_root <> b_root")
        links = settle(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = rounds[0]
    for labels in rounds[1:]:
        step = labels.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        result = result.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return result

"""Connected components of a large sparse graph by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b): the smallest node reachable from each node that has a link.

    Every round each node takes its smallest neighbour as its parent if that is smaller, parents are followed once more, and the links go on
    between different parents only, each once: the graph shrinks fast and a settled group costs nothing. Each round is written to the shared folder, which also
    bounds the plan. Parents are combined by ``min``, which has a map-side stage: a node with many links costs one row per task.
    In the end the rounds' parents are followed from the last round to the first. A graph without links gives no rows.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    edges, rounds = stage(ordered.distinct(), "edges"), []
    while not edges.isEmpty():
        # Ends are a < b: only b can hook to a, and a is there with itself.
        offers = edges.select(F.col("b").alias("node"), F.col("a").alias("parent")).union(edges.select("a", "a"))
        parents = stage(offers.groupBy("node").agg(F.min("parent").alias("parent")), "parents")
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        parents = stage(parents.join(above, "parent").select("node", F.col("next").alias("parent")), "parents")
        rounds.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return ordered.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("parent"), "label" if "label" in labels.columns else F.col("parent").alias("label"))
        labels = stage(rounds.pop().join(later, "parent", "left").select("node", F.coalesce("label", "parent").alias("label")), "labels")
    return labels.select("node", F.col(labels.columns[1]).alias("label"))

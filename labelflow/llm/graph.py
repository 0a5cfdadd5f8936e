"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Every round maps each node to the smallest among itself and its neighbours, follows that map twice more,
    and replaces the ends of all edges by what they map to. Edges inside a contracted node vanish, so a few
    rounds suffice even for long chains. All tables stay distributed and are written to the shared folder
    between rounds.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = materialize(nodes.select("node", F.col("node").alias("root")), "roots")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        to = materialize(
            both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")),
            "parents",
        )
        for _ in range(2):
            above = to.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            to = materialize(
                to.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "parents"
            )
        moved = roots.join(to.select(F.col("node").alias("root"), "up"), "root", "left")
        roots = materialize(moved.select("node", F.coalesce("up", "root").alias("root")), "roots")
        half = materialize(
            edges.join(to.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("x", "b"), "edges"
        )
        whole = half.join(to.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        edges = materialize(
            whole.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    return roots

"""Connected components of an edge table of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from serospark.operators.graph import stars


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node of the component.

    Tasks join their own edges first and hand on stars; rounds of large and small stars join these until every edge leads
    to a root. Every round is a written table; the one before it is deleted. Loops and
    repeated edges do no harm; a node with loops only is not listed. No edges give no rows.
    """
    state = stars(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

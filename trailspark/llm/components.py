"""Connected components of a graph that may be too large for one machine.

Edges are contracted by alternating large and small stars (every node hangs its larger, then
its smaller neighbours below the smallest one) until nothing moves; the number of rounds grows
with the logarithm of the longest path. Each round is two aggregations that combine before the
shuffle and two joins that adaptive execution may split, so a node with very many neighbours
needs no task of its own. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailspark.llm.tables import saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of the component.

    Edges may repeat and point either way; loops and edges with a null end say nothing. No
    edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = saved(edges.filter(F.col("a") > F.col("b")).distinct(), "edges")
    before, now = None, _state(edges)
    while now != before:
        stars = _large_star(edges).filter(F.col("a") > F.col("b")).distinct()
        edges = saved(_small_star(stars).distinct(), "edges")
        before, now = now, _state(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

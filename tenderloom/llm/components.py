"""Connected components of undirected edges by alternating large and small stars.

Every round is two joins on a node, each aggregated before it is shuffled; the edges of a round
are written, so a lost executor costs one round at most.  A star of any size is joined row by
row, never gathered, and Spark splits skewed partitions of the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.tables import written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Edges run from the greater to the smaller node; each node's far or near neighbours move to its least one."""
    near = edges
    if not small:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = near.join(least, near["a"] == least["n"])
    if small:
        moved = joined.select("b", "m").unionByName(joined.select(F.col("a").alias("b"), "m"))
    else:
        moved = joined.filter("b > a").select("b", "m")
    moved = moved.filter("b != m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge, from edges (a, b); a component is its least node.

    Loops and nulls are ignored; repeated edges do not matter."""
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = written(edges.distinct(), "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        edges = written(_stars(edges, small=False), "large-stars")
        edges = written(_stars(edges, small=True), "small-stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

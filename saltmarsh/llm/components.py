"""Connected components of a link table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saltmarsh.operators.rows import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) in both directions, each with the least node among u and its neighbours.

    The least nodes are written first, so that the join may split a node that
    holds a large part of all edges.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(materialise(least, "least"), "u")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label) of every node that has a link; the label is the least node of its component.

    Alternates two steps until nothing changes. The first ties every larger
    neighbour of a node to the least node around it, the second ties a node and
    its smaller neighbours to their least. The number of rounds grows with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    pairs = links.select(F.least(left, right).alias("v"), F.greatest(left, right).alias("u")).filter("u <> v")
    edges = materialise(pairs.distinct(), "edges")
    before = None
    while True:
        around = _with_least(edges)
        large = materialise(around.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(materialise(down, "least"), "u")
        small = stars.select("u", F.col("m").alias("v")).union(
            stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = materialise(small.filter("u <> v").distinct(), "edges")
        # Two edge sets with equal counts and sums of hashes are taken to be equal.
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)

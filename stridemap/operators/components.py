"""Connected components of an edge table by large-star and small-star steps.

Every step is a grouped minimum with map-side aggregation and an equi-join, so that a node with very many edges is
summed before it moves and its join is split; each round is written to the shared folder. The number of rounds grows
with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap.runtime import materialize, shuffled


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of comparable ids -> (node, component): the least node of each component, for every node with an edge."""
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges", few=True)
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars", few=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # Stars at the end: b is the component of a.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of a node is tied to the node's least neighbour (or the node)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(shuffled(least), "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(shuffled(least), "a")
    pairs = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", "m"))
    return pairs.where("a <> b").distinct()

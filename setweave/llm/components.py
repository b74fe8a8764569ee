"""Connected components by alternating large-star and small-star steps, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import shared

#: Far beyond the logarithmic number of rounds that any graph takes.
MOST_ROUNDS = 100


def _least(edges: DataFrame) -> DataFrame:
    """(n, m): for each node u, the least of u and the v it has; written, so that joins with it can split a hot u."""
    return shared.materialize(edges.groupBy(F.col("u").alias("n")).agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")


def _open(edges: DataFrame) -> DataFrame:
    """Nodes that keep the edges from being stars: with several edges, or one and neighbours that point to them."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("own"), F.lit(0).alias("other")), F.struct(F.col("v").alias("n"), F.lit(0).alias("own"), F.lit(1).alias("other")))).alias("e"))
    d = ends.select("e.*").groupBy("n").agg(F.sum("own").alias("own"), F.max("other").alias("other"))
    return d.filter("own > 1 or (own = 1 and other = 1)")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (columns a, b), the least id that it reaches.

    No node's neighbours are ever gathered: each step takes a minimum by node and joins it back.
    Ends when the edges are stars: every node has one edge, to a node that has none of its own.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = shared.materialize(edges, "edges")
    for _ in range(MOST_ROUNDS):
        if _open(edges).isEmpty():
            break
        # large star: every larger neighbour of u is tied to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.filter("v > u").join(shared.few(least, 2), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared.materialize(large, "large")
        # small star: u and its smaller neighbours are tied to the least of them
        low = _least(large)
        tied = large.join(shared.few(low, 2), F.col("u") == F.col("n"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = shared.materialize(tied.select(F.explode(ends).alias("e")).select("e.*").filter("u <> v").distinct(), "small")
        shared.discard(edges, least, large, low)
        edges = small
    else:
        raise RuntimeError(f"components are still growing after {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type): the least node it is linked to.

    Loops and repeated edges are fine; an edge with a null end is left out.  Each round is written to the shared folder.  The
    number of edges never grows, so a node with very many neighbours costs one sum, not pairs.
    """
    links = saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour of u is linked to the least of u's neighbours.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = saved(small.where("u <> v").distinct(), "links")
        forget(links)
        links = after
        now = links.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v"), F.col("v"))).distinct()

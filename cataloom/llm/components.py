"""Connected components of a graph of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _stars(edges: DataFrame) -> DataFrame:
    """No side is broadcast: it would pass whole through the driver, and a table's bytes on disk say little of its rows.

    Large stars: each node's larger neighbours are tied to its smallest; then small stars: its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with a link: root is the smallest node reachable. Links (a, b) of longs, in any order.

    Links stay distributed; each round is a table in the shared folder, and the driver sees a count and a checksum alone.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == seen or not now[0]:
            break
        before, seen, edges = edges, now, cut(_stars(edges), "links")
        release(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

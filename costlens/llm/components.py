"""Connected components of a link table, as Spark joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected
components in MapReduce and beyond", 2014).  Each round is written to the
shared folder, so lineage stays short and a lost executor costs one round.  The
smallest neighbours are written too: the joins then deal out both sides
themselves, and Spark can split a node with very many links.  Only two numbers
per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
    return both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the smallest node reachable.

    Null ends and links of a node to itself are ignored; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "links")
    seen = _signature(edges)
    while True:
        edges = written(_small_star(written(_large_star(edges), "stars")), "stars")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(edges.select("v", "v").distinct()))

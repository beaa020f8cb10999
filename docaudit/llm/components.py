"""Connected components of a link table, by rounds of star operations on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One round. Large star: larger neighbours of a node move to its smallest; small star: smaller ones and itself do.

    The lowest neighbours are written before they are joined, so that adaptive execution can split the links of a hub.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "components-lowest")
    large = both.filter("b > a").join(lowest, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    large = written(large, "components-large")  # a > b
    lowest = written(large.groupBy("a").agg(F.min("b").alias("low")), "components-lowest")
    # Two links from each: to the smallest, and from each other smaller neighbour to the smallest.
    moved = large.join(lowest, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    small = lowest.select("a", F.col("low").alias("b")).unionByName(moved)
    return small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` -> ``root`` (smallest node reachable) for all nodes but the roots, from links ``a``, ``b``.

    Nulls and links of a node to itself count for nothing. The number of rounds grows with the logarithm of the
    longest path; links and labels stay in tables, and the driver sees two numbers a round.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "components-links")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        if (now["n"], now["h"]) == state or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now["n"], now["h"]
        edges = written(_stars(edges), "components-links")

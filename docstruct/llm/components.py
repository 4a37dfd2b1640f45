"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.scratch import discard, stage

MAX_ROUNDS = 60


def _minima(pairs: DataFrame) -> DataFrame:
    """Least of each node and its partners. Partial sums keep hubs cheap; the table gives the join an exchange that Spark can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return stage(least.select("u", F.least("u", "m").alias("m")), "minima")


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an undirected graph with the least node of their component.

    edges: (a, b) of one orderable type; loops, repeats and either direction may occur; rows with a null are ignored.
    Returns (node, root) for each node of an edge between two different nodes. Each round writes its edges to the shared
    folder and deletes those of the round before; only a count and a checksum reach the driver. Rounds grow with the logarithm of the longest path.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stage(links, "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = _minima(both)
        large = both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large")
        least = _minima(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = (links, first, large, least)
        links = stage(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        discard(*done)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        seen = now
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")

"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch_dir, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour of a node to the least around it; small star: the smaller ones and itself."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        made = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        made = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for each node that a link has.

    Each round is written to the shared scratch folder, so a lost executor costs one round at
    most. Rounds grow with the logarithm of the longest path; stars need two.
    """
    top = scratch_dir(links.sparkSession)
    pair = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(links.select(*pair).where("u <> v").distinct(), f"{top}/0")
    seen, k = None, 0
    while True:
        k += 1
        edges = stored(_star(_star(edges, True), False), f"{top}/{k}")
        discard(links.sparkSession, f"{top}/{k - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

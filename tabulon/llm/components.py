"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import freeze


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): the smallest node that can be reached.

    Each round connects larger neighbours, then smaller ones, to the smallest neighbour; the edges become stars in a few
    rounds. A round is two aggregates and joins on nodes, so a node with very many edges is pre-aggregated and its join
    can be split. Loops and repeated edges are harmless; no edges give no rows.
    """
    stars = freeze(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "stars")
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        # a node with several smaller neighbours keeps its own edge: its smallest neighbour gives the second case
        stars = freeze(moved.distinct(), "stars")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

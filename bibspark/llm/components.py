"""Connected components of a large graph, by large-star and small-star rounds.

Every round is a map-side combined minimum per node and a join; no node's neighbours are gathered in one place, and
edges are never sent to the driver. A node with very many edges makes a skewed join side, which adaptive execution
splits. Rounds end when no edge changes; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffled

MAX_ROUNDS = 200


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """edges (a, b) with a > b. both: large star, else small star."""
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = sides.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("m", "n"))
    met = sides.join(shuffled(least), F.col("a") == F.col("n"))
    if both:  # the larger neighbours of a node go to its least one
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the smaller neighbours and the node itself go to the least one
        out = met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached, for each node of ``edges`` (a, b: any comparable type)."""
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_stars(_stars(edges, True), False), "edges")
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == (n, total):
            break
        mark = (n, total)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())

"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, stored


def _large(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Tie every greater neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size")), spark, "least")
    return joined(both, least, ["u"], "size", 2 * edges.count()).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Tie a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), spark, "least")
    out = joined(down, least, ["u"], "size", edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(u, v) for every node but the least of its component: v is that least node.

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each
    step's edges are written to the shared folder, so no lineage grows. A node of many
    neighbours is joined by broadcast, so none meets all of them in one task. Each round of
    steps shortens all paths to the least nodes, so rounds grow with the logarithm of the edges."""
    edges, seen = edges.select("u", "v").filter("u <> v"), None
    while True:
        step = _small(stored(_large(edges, spark).filter("u <> v").distinct(), spark, "large"), spark)
        edges = stored(step.filter("u <> v").distinct(), spark, "small")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == seen or not mark[0]:
            return edges
        seen = mark

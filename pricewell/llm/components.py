"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Each step is a grouped minimum and a join, so a hub is summed before it is shuffled and its links can be split. Steps are
    written to the shared folder; their number grows with the logarithm of the diameter.
    """
    edges = keep(_directed(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(_directed(both.where("v > u").join(low, "u").select("v", "m").toDF("u", "v")), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = keep(_directed(small), "small")
        sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for x in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return keep(nodes.union(edges.select(F.col("v"), F.col("v"))).distinct(), "components")


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

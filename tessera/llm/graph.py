"""Connected components of links, as tables: nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import drop, materialize


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each u."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each end of links (a, b); a component is named by its least node.

    Alternating large and small stars: each node links its larger, then its smaller, neighbours to the least one, until only stars are left.
    A few rounds do for stars and cliques, about log(n) for chains.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "least").alias("least"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct(), "large")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        gone, edges = (edges, large), materialize(small, "small")
        drop(*gone)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, stash


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """A stashed table (node, root): each node that has a link, with the smallest node of its component.

    Alternates large stars (a node's greater neighbours move to its smallest neighbour) and small stars (its smaller
    neighbours and itself do) until nothing changes. Each step is one aggregation and one join on the node; the number
    of links never grows. Each step's aggregate and result are tables in the shared folder: so both sides of the join are
    plain scans, and adaptive execution can split the links of a hub.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    stars = stash(links.where(F.col(a) != F.col(b)).select(u, v).distinct(), "links")
    state = _state(stars)
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "nearest")
        large = both.where(F.col("v") > F.col("u")).join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "large-star")
        discard(nearest)
        nearest = stash(large.groupBy("u").agg(F.min("v").alias("m")), "nearest")
        moved = large.join(nearest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stash(moved.unionAll(nearest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(nearest)
        discard(stars)
        discard(large)
        stars, before, state = small, state, _state(small)
        if state == before:
            break
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stash(nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct()), "roots")
    discard(stars)
    return out

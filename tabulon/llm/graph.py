"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import settle

HUBS = 1000
HUB_EDGES = 200
"""A node with more edges than this, and more than one in ``HUBS`` of all, is a hub; there are fewer than 2 * HUBS."""


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    Every round is written to the shared folder, so lost executors cost one round at
    most.  Only two numbers a round come to the driver.  A node with a large part of all
    edges is met where its edges lie, so no task gathers them.
    """
    e = settle(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(e)
    while True:
        e = settle(_small_star(_large_star(e, mark[0])))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > max(HUB_EDGES, edges // HUBS)).select("u", "m"))
    larger = both.where("v > u")
    of_hubs = larger.join(hubs, "u")  # at most 2 * HUBS rows are broadcast
    others = larger.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u")
    moved = of_hubs.unionByName(others)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

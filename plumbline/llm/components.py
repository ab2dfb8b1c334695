"""Connected components of a link table, without bringing links or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    return near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    moved = links.join(least, "a").where(F.col("b") != F.col("root")).select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that it reaches, for every node of ``links`` (``a``, ``b``).

    Large and small stars alternate until nothing changes; each round is written to shared scratch, so
    a lost executor costs a task, not the rounds before. A node with very many links is only ever
    aggregated map-side or joined, which splits. An empty table gives an empty one; a link of a node
    to itself keeps the node.
    """
    loops = links.where(F.col("a") == F.col("b")).select("a", "b")
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(now, "links"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = materialize(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).unionByName(loops.select(F.col("a").alias("node"), F.col("a").alias("root")))
    return (
        now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
    )

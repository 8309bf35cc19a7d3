"""Connected components of a link table, by alternating large-star and small-star steps over written tables.

Each step is a distributed aggregation; nothing about links or components comes to the driver but whether a step changed any.
A node that very many links touch is only ever aggregated (min) or streamed past, never gathered into one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thicket.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get the smallest node among it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each node of ``links`` (columns a, b; long) but the smallest of its component, with that smallest node."""
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        # the same edges again: their number and the sum of their hashes
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        now = (row["n"], row["s"])
        if now == before or not row["n"]:
            return edges
        before = now

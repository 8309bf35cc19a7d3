"""Sets of the hierarchy: children, strict descendants, kinds (a concept and all its descendants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thicket.plans.model import Coordinate
from thicket.session import cut
from thicket.sources.store import TermStore


def nids(df: DataFrame, column: str = "nid") -> DataFrame:
    return df.select(F.col(column).alias("nid")).distinct()


def children(store: TermStore, parent: int, view: Coordinate | None) -> DataFrame:
    return nids(store.edges(view).where(F.col("destination") == parent), "source")


def held_edges(store: TermStore, view: Coordinate | None) -> DataFrame:
    """The hierarchy under the view, computed once a store and read from its checkpoint in every round."""
    if ("edges", view) not in store._closures:
        store._closures["edges", view] = cut(store.edges(view))
    return store._closures["edges", view]


def descendants(store: TermStore, root: int, view: Coordinate | None) -> DataFrame:
    """All concepts under ``root``, without itself.

    Semi-naive: each round joins only the last round's new concepts to the edges and removes those met before, so a concept is
    expanded once whatever the number of paths to it, and cycles end. Rounds are checkpointed; the edges are read once.
    """
    key = (root, view)
    if key not in store._closures:
        edges = held_edges(store, view)
        frontier = cut(nids(edges.where(F.col("destination") == root), "source").where(F.col("nid") != root))
        met = frontier
        while not frontier.isEmpty():
            reached = edges.join(frontier.withColumnRenamed("nid", "destination"), "destination", "left_semi").select(F.col("source").alias("nid")).where(F.col("nid") != root).distinct()
            frontier = cut(reached.join(met, "nid", "left_anti"))
            met = met.union(frontier)
        store._closures[key] = met
    return store._closures[key]


def kinds(store: TermStore, root: int, view: Coordinate | None) -> DataFrame:
    """``root`` and everything under it."""
    own = store.spark.range(1).select(F.lit(root).cast("long").alias("nid"))
    return own.union(descendants(store, root, view))

"""A store of components: version tables as DataFrames, and snapshots of them under a coordinate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.plans.model import KEYS, Coordinate


def latest(versions: DataFrame, keys: list[str], view: Coordinate) -> DataFrame:
    """The last version of each component at the view's time, if it is in one of the view's states.

    One aggregation, combined on the map side: no window sorts a component's versions. Of versions of the same time the largest wins.
    """
    if view.as_of is not None:
        versions = versions.where(F.col("time") <= F.lit(view.as_of).cast("timestamp_ntz"))
    rest = [c for c in versions.columns if c not in keys]
    ordered = ["time", *(c for c in rest if c != "time")]
    last = versions.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("v")).select(*keys, *(F.col("v")[c].alias(c) for c in ordered))
    return last.where(F.col("state").isin([s.value for s in view.states])).select(*versions.columns)


@dataclass
class TermStore:
    """The five version tables (schemas: ``plans.model.SCHEMAS``). is_a: the relationship type that makes the hierarchy."""

    spark: SparkSession
    concept: DataFrame
    description: DataFrame
    relationship: DataFrame
    sememe: DataFrame
    dynamic: DataFrame
    is_a: int
    _closures: dict = field(default_factory=dict, repr=False)

    def snapshot(self, table: str, view: Coordinate) -> DataFrame:
        """The table as the view sees it."""
        seen = latest(getattr(self, table), KEYS[table], view)
        return seen.where(F.col("premise") == view.premise.value) if table == "relationship" and view.premise else seen

    def edges(self, view: Coordinate | None) -> DataFrame:
        """(source, destination) of the hierarchy; without a view, of any version."""
        if view is None:
            rows = self.relationship.where(F.col("rtype") == self.is_a)
        else:
            seen = latest(self.relationship.where(F.col("rtype") == self.is_a), KEYS["relationship"], view)  # filtered first: the type is a key
            rows = seen.where(F.col("premise") == view.premise.value) if view.premise else seen
        return rows.select("source", "destination").distinct()

    @classmethod
    def read(cls, spark: SparkSession, folder: str, is_a: int) -> TermStore:
        """From Parquet tables of these names."""
        return cls(spark, *(spark.read.parquet(f"{folder}/{t}") for t in ("concept", "description", "relationship", "sememe", "dynamic")), is_a=is_a)

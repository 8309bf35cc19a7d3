"""Result shapes: what RETURN makes of the ids of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thicket.operators.clauses import Context, best_description
from thicket.plans.model import ReturnType


def shape(ctx: Context, found: DataFrame, kind: ReturnType) -> DataFrame:
    """``found`` (nid) in the given shape, under the query's view; components that the view does not see are left out."""
    view, store = ctx.view(), ctx.store
    if kind is ReturnType.NIDS:
        return found.select("nid")
    if kind is ReturnType.UUIDS:
        return store.snapshot("concept", view).join(found, "nid", "left_semi").select("nid", "uuid")
    if kind is ReturnType.COMPONENT:
        concepts = store.snapshot("concept", view).select("nid", F.lit("CONCEPT").alias("kind"), "time", "state")
        descriptions = store.snapshot("description", view).select("nid", F.lit("DESCRIPTION").alias("kind"), "time", "state")
        sememes = store.snapshot("sememe", view).select("nid", F.lit("SEMEME").alias("kind"), "time", "state")
        return concepts.unionByName(descriptions).unionByName(sememes).join(found, "nid", "left_semi")
    if kind is ReturnType.CONCEPT_VERSION:
        # each nested list is aggregated before it joins, so lists don't multiply one another
        rows = store.snapshot("concept", view).join(found, "nid", "left_semi")
        members = store.snapshot("sememe", view).join(found.withColumnRenamed("nid", "referenced"), "referenced", "left_semi")
        members = members.groupBy(F.col("referenced").alias("nid")).agg(F.array_sort(F.collect_list(F.struct("assemblage", F.col("nid").alias("member")))).alias("members"))
        edges = store.snapshot("relationship", view).select(F.col("source").alias("nid"), "rtype", "destination").distinct().join(found, "nid", "left_semi")
        edges = edges.groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("rtype", "destination"))).alias("relationships"))
        none = "array<struct<assemblage:bigint,member:bigint>>", "array<struct<rtype:bigint,destination:bigint>>"
        joined = rows.join(members, "nid", "left").join(edges, "nid", "left")
        return joined.select("nid", "uuid", "time", "state", F.coalesce("members", F.array().cast(none[0])).alias("members"), F.coalesce("relationships", F.array().cast(none[1])).alias("relationships"))
    if kind in (ReturnType.DESCRIPTION_VERSION_FSN, ReturnType.DESCRIPTION_FOR_COMPONENT, ReturnType.DESCRIPTION_VERSION_PREFERRED):
        dtype = "SYNONYM" if kind is ReturnType.DESCRIPTION_VERSION_PREFERRED else "FSN"
        return best_description(ctx, dtype, view).join(found.withColumnRenamed("nid", "concept_nid"), "concept_nid", "left_semi")
    raise ValueError(f"no such result shape: {kind}")

"""Clauses of WHERE: each compiles to a DataFrame of distinct ids. Only closures run anything then: their rounds are checkpointed.

``compile(ctx, incoming)`` returns ids within ``incoming``; clauses that map to other components (names, reference sets) restrict
what they map from instead. Values and views are given as keys of LET, or as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from thicket.functions import text as text_index
from thicket.operators.taxonomy import children, descendants, held_edges, kinds, nids
from thicket.plans.model import CURRENT_VIEW, Coordinate
from thicket.session import cut
from thicket.sources.store import TermStore

#: Most hits that a text or value clause takes from the index.
INDEX_HITS = 1000


@dataclass
class Context:
    store: TermStore
    let: dict[str, Any]

    def value(self, key: Any) -> Any:
        return self.let[key] if isinstance(key, str) and key in self.let else key

    def view(self, key: Any = None) -> Coordinate:
        found = self.value(CURRENT_VIEW if key is None else key)
        if not isinstance(found, Coordinate):
            raise ValueError(f"{key!r} is not bound to a view")
        return found


def within(df: DataFrame, incoming: DataFrame) -> DataFrame:
    return df.join(incoming, "nid", "left_semi")


class Clause:
    """Subclass it and define ``compile`` for clauses of your own; register the class to have it serialized."""

    registry: ClassVar[dict[str, type[Clause]]] = {}
    #: Names of the parts that are clauses, and that are LET keys.
    children: list[Clause] = []

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        Clause.registry[cls.__name__] = cls

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        raise NotImplementedError

    def parameters(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if k != "children"}

    def where_tree(self) -> dict:
        """Semantic, LET keys and children, for explanations."""
        return {"semantic": type(self).__name__, "keys": self.parameters(), "children": [c.where_tree() for c in self.children]}

    def explain(self, depth: int = 0) -> str:
        own = "  " * depth + type(self).__name__ + "".join(f" {k}={v!r}" for k, v in self.parameters().items() if v is not None)
        return "\n".join([own, *(c.explain(depth + 1) for c in self.children)])


# set algebra ------------------------------------------------------------------------------------------------------------


class Parent(Clause):
    def __init__(self, *clauses: Clause):
        self.children = list(clauses)


class And(Parent):
    """All of incoming that every child has; without children, incoming."""

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return reduce(lambda left, c: within(left, c.compile(ctx, left)), self.children, incoming)


class Intersection(And):
    pass


class Or(Parent):
    """What any child has; without children, nothing."""

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        if not self.children:
            return incoming.limit(0)
        return reduce(DataFrame.union, (c.compile(ctx, incoming) for c in self.children)).distinct()


class Union(Or):
    pass


class Xor(Parent):
    """What an odd number of children have."""

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        if not self.children:
            return incoming.limit(0)
        parts = reduce(DataFrame.union, (c.compile(ctx, incoming).distinct() for c in self.children))
        return parts.groupBy("nid").count().where("count % 2 = 1").select("nid")


class Not(Parent):
    """Concepts of incoming that the view sees and the child does not have."""

    def __init__(self, clause: Clause):
        super().__init__(clause)

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        seen = within(incoming, nids(ctx.store.snapshot("concept", ctx.view())))
        return seen.join(self.children[0].compile(ctx, incoming), "nid", "left_anti")


class AndNot(Parent):
    """Incoming without what any child has."""

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return reduce(lambda left, c: left.join(c.compile(ctx, incoming), "nid", "left_anti"), self.children, incoming)


# concepts and the hierarchy ---------------------------------------------------------------------------------------------


@dataclass
class ConceptIs(Clause):
    concept: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return incoming.where(F.col("nid") == ctx.value(self.concept))


@dataclass
class ConceptIsChildOf(Clause):
    concept: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return within(incoming, children(ctx.store, ctx.value(self.concept), ctx.view(self.view)))


@dataclass
class ConceptIsDescendentOf(Clause):
    concept: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return within(incoming, descendants(ctx.store, ctx.value(self.concept), ctx.view(self.view)))


@dataclass
class ConceptIsKindOf(Clause):
    concept: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return within(incoming, kinds(ctx.store, ctx.value(self.concept), ctx.view(self.view)))


# relationships ----------------------------------------------------------------------------------------------------------


@dataclass
class RelRestriction(Clause):
    """Sources of relationships of a type to a destination, or to kinds of either.

    flag: bound to a Boolean it sets destination_subsumption, otherwise it is the view's key.
    """

    rel_type: Any
    destination: Any
    flag: Any = None
    type_subsumption: Any = True
    destination_subsumption: Any = True
    view: Any = None

    def _settings(self, ctx: Context) -> tuple[Coordinate, bool, bool]:
        flag = ctx.value(self.flag)
        target = flag if isinstance(flag, bool) else ctx.value(self.destination_subsumption)
        view = self.flag if self.flag is not None and not isinstance(flag, bool) else self.view
        return ctx.view(view), bool(ctx.value(self.type_subsumption)), bool(target)

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        view, by_type, by_target = self._settings(ctx)
        rows = ctx.store.snapshot("relationship", view)
        for column, value, wide in (("rtype", ctx.value(self.rel_type), by_type), ("destination", ctx.value(self.destination), by_target)):
            rows = rows.join(kinds(ctx.store, value, view).withColumnRenamed("nid", column), column, "left_semi") if wide else rows.where(F.col(column) == value)
        return within(incoming, nids(rows, "source"))


@dataclass
class RelType(Clause):
    """Sources of relationships of a type, or of kinds of it."""

    rel_type: Any
    type_subsumption: Any = True
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        view, value = ctx.view(self.view), ctx.value(self.rel_type)
        rows = ctx.store.snapshot("relationship", view)
        rows = rows.join(kinds(ctx.store, value, view).withColumnRenamed("nid", "rtype"), "rtype", "left_semi") if ctx.value(self.type_subsumption) else rows.where(F.col("rtype") == value)
        return within(incoming, nids(rows, "source"))


@dataclass
class RelationshipIsCircular(Clause):
    """Concepts with a relationship to a concept that they are a kind of.

    Only the sources that the type leaves are walked upwards: (source, ancestor) pairs grow from them round by round.
    """

    rel_type: Any
    type_subsumption: Any = True
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        view, value = ctx.view(self.view), ctx.value(self.rel_type)
        rows = ctx.store.snapshot("relationship", view)
        rows = rows.join(kinds(ctx.store, value, view).withColumnRenamed("nid", "rtype"), "rtype", "left_semi") if ctx.value(self.type_subsumption) else rows.where(F.col("rtype") == value)
        rows = cut(within(rows.select(F.col("source").alias("nid"), "destination").distinct(), incoming))
        edges = held_edges(ctx.store, view).select(F.col("source").alias("at"), F.col("destination").alias("up"))
        met = frontier = cut(rows.select("nid", F.col("nid").alias("at")).distinct())
        while not frontier.isEmpty():
            above = frontier.join(edges, "at").select("nid", F.col("up").alias("at")).distinct()
            frontier = cut(above.join(met, ["nid", "at"], "left_anti"))
            met = met.union(frontier)
        return nids(rows.join(met.withColumnRenamed("at", "destination"), ["nid", "destination"], "left_semi"))


# reference sets ---------------------------------------------------------------------------------------------------------


def _refset(ctx: Context, refset: Any, view: Any) -> DataFrame:
    return ctx.store.snapshot("sememe", ctx.view(view)).where(F.col("assemblage") == ctx.value(refset))


@dataclass
class RefsetContainsConcept(Clause):
    """The reference set, if the concept is a member."""

    refset: Any
    concept: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return nids(_refset(ctx, self.refset, self.view).where(F.col("referenced") == ctx.value(self.concept)), "assemblage")


@dataclass
class RefsetContainsKindOfConcept(Clause):
    """The reference set, if a kind of the concept is a member."""

    refset: Any
    concept: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        under = kinds(ctx.store, ctx.value(self.concept), ctx.view(self.view)).withColumnRenamed("nid", "referenced")
        return nids(_refset(ctx, self.refset, self.view).join(under, "referenced", "left_semi"), "assemblage")


@dataclass
class RefsetContainsString(Clause):
    """The reference set, if a member's string contains the text, in any case. The text is taken as it is."""

    refset: Any
    text: str
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return nids(_refset(ctx, self.refset, self.view).where(F.lower("string1").contains(self.text.lower())), "assemblage")


@dataclass
class RefsetLuceneMatch(Clause):
    """Members whose long value is the key's; of those within incoming, the first ``INDEX_HITS``."""

    key: Any

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        hits = ctx.store.sememe.where(F.col("long1") == int(ctx.value(self.key)))
        return within(nids(hits), incoming).orderBy("nid").limit(INDEX_HITS)


@dataclass
class ComponentIsMemberOfRefset(Clause):
    refset: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return within(incoming, nids(_refset(ctx, self.refset, self.view), "referenced"))


@dataclass
class ComponentsFromExternalIds(Clause):
    """Components by their external ids: a list, or a key of one."""

    ids: Any

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return within(incoming, by_uuid(ctx.store, ctx.value(self.ids)))


def by_uuid(store: TermStore, ids: list[str]) -> DataFrame:
    """Ids of the concepts with these external ids. The list comes from the query, so its size is the query's."""
    wanted = store.spark.createDataFrame([(i,) for i in ids], "uuid string")
    return nids(store.concept.select("nid", "uuid").join(wanted, "uuid", "left_semi"))


# descriptions -----------------------------------------------------------------------------------------------------------


def full_match(column: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole text: ``$`` alone would let a last line break pass."""
    return column.rlike(rf"\A(?:{pattern})\z")


@dataclass
class DescriptionRegexMatch(Clause):
    """Descriptions of which any version's whole text matches."""

    key: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        return within(nids(ctx.store.description.where(full_match(F.col("text"), ctx.value(self.key)))), incoming)


@dataclass
class DescriptionActiveRegexMatch(Clause):
    """Descriptions whose version in the view is active and matches; any_version: of which any active version does."""

    key: Any
    view: Any = None
    any_version: bool = False

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        rows = ctx.store.description if self.any_version else ctx.store.snapshot("description", ctx.view(self.view))
        return within(nids(rows.where((F.col("state") == "ACTIVE") & full_match(F.col("text"), ctx.value(self.key)))), incoming)


@dataclass
class DescriptionLuceneMatch(Clause):
    """The best ``INDEX_HITS`` descriptions for a query string, active or not."""

    key: Any

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        hits = text_index.search(ctx.store.description.select("nid", "text"), ctx.value(self.key), limit=INDEX_HITS)
        return within(hits.select("nid"), incoming)


@dataclass
class DescriptionActiveLuceneMatch(Clause):
    """Those of DescriptionLuceneMatch whose latest version in the view is active."""

    key: Any
    view: Any = None

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        active = ctx.store.snapshot("description", ctx.view(self.view)).where("state = 'ACTIVE'").select("nid")
        return DescriptionLuceneMatch(self.key).compile(ctx, incoming).join(active, "nid", "left_semi")


@dataclass
class ChangedFromPreviousVersion(Clause):
    """Concepts with an active description that the earlier view sees too, but with another text, type or language."""

    previous: Any

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        now = ctx.store.snapshot("description", ctx.view()).where("state = 'ACTIVE'").select("nid", "concept_nid", F.struct("text", "dtype", "lang").alias("now"))
        before = ctx.store.snapshot("description", ctx.view(self.previous)).select("nid", F.struct("text", "dtype", "lang").alias("before"))
        return within(incoming, nids(now.join(before, "nid").where(~F.col("now").eqNullSafe(F.col("before"))), "concept_nid"))


# mappings ---------------------------------------------------------------------------------------------------------------


class ConceptForComponent(Parent):
    """The concepts, of incoming, that the child's components belong to."""

    def __init__(self, clause: Clause):
        super().__init__(clause)

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        owners = ctx.store.description.select("nid", F.col("concept_nid").alias("owner")).union(ctx.store.sememe.select("nid", "referenced")).distinct()
        owned = owners.join(incoming.withColumnRenamed("nid", "owner"), "owner", "left_semi")
        parts = owned.select("nid").union(incoming).distinct()
        hits = self.children[0].compile(ctx, parts)
        return within(nids(owned.join(hits, "nid", "left_semi"), "owner").union(hits).distinct(), incoming)


def best_description(ctx: Context, dtype: str, view: Coordinate) -> DataFrame:
    """(concept_nid, nid, text, lang): of each concept's active descriptions of the type, that in the language preferred most; then
    the smallest id. One aggregation, combined on the map side."""
    rank = F.coalesce(F.array_position(F.lit(list(view.languages)), F.col("lang")), F.lit(0)).cast("int")
    rows = ctx.store.snapshot("description", view).where(F.col("dtype") == dtype)
    ranked = rows.select("concept_nid", F.struct(F.when(rank == 0, len(view.languages) + 1).otherwise(rank).alias("rank"), "nid", "text", "lang").alias("d"))
    return ranked.groupBy("concept_nid").agg(F.min("d").alias("d")).select("concept_nid", "d.nid", "d.text", "d.lang")


class FullySpecifiedNameForConcept(Parent):
    """The full names' ids of the child's concepts; concepts without one are left out."""

    dtype = "FSN"

    def __init__(self, clause: Clause):
        super().__init__(clause)

    def compile(self, ctx: Context, incoming: DataFrame) -> DataFrame:
        concepts = self.children[0].compile(ctx, incoming).withColumnRenamed("nid", "concept_nid")
        return best_description(ctx, self.dtype, ctx.view()).join(concepts, "concept_nid", "left_semi").select("nid")


class PreferredNameForConcept(FullySpecifiedNameForConcept):
    """The preferred names' ids of the child's concepts."""

    dtype = "SYNONYM"

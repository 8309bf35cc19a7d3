"""Queries: a universe (FOR), bound values (LET), a tree of clauses (WHERE), and a result shape (RETURN)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from thicket.operators.clauses import And, Clause, ConceptIsKindOf, ConceptIs, ConceptIsChildOf, Context, Not, Or, by_uuid
from thicket.operators.returns import shape
from thicket.operators.taxonomy import nids
from thicket.plans.model import CURRENT_VIEW, LATEST, Coordinate, ForType, ReturnType
from thicket.session import cut
from thicket.sources.store import TermStore


@dataclass
class ForSet:
    """types: one or more universes, united; custom: external ids for CUSTOM_SET."""

    types: list[ForType] = field(default_factory=lambda: [ForType.ALL_CONCEPTS])
    custom: list[str] = field(default_factory=list)

    def collection(self, store: TermStore) -> DataFrame:
        return reduce(DataFrame.union, (self._one(store, t) for t in self.types)).distinct()

    def _one(self, store: TermStore, kind: ForType) -> DataFrame:
        if kind == ForType.ALL_CONCEPTS:
            return nids(store.concept)
        if kind == ForType.ALL_DESCRIPTIONS:
            return nids(store.description)
        if kind == ForType.ALL_SEMEMES:
            return nids(store.sememe)
        if kind == ForType.ALL_RELATIONSHIPS:
            return nids(store.relationship.where(F.col("nid").isNotNull()))
        if kind == ForType.ALL_COMPONENTS:
            return nids(store.concept).union(nids(store.description)).union(nids(store.sememe))
        if kind == ForType.CUSTOM_SET:
            return by_uuid(store, self.custom)
        raise ValueError(f"no such universe: {kind}")


@dataclass
class Query:
    """``where`` is a clause, or a callable from (Context, incoming) to a DataFrame of ids."""

    where: Clause | Callable[[Context, DataFrame], DataFrame]
    for_: ForSet = field(default_factory=ForSet)
    let: dict[str, Any] = field(default_factory=dict)
    returns: ReturnType = ReturnType.NIDS
    view: Coordinate = LATEST

    def context(self, store: TermStore) -> Context:
        return Context(store, {CURRENT_VIEW: self.view} | self.let)

    def compute(self, store: TermStore) -> DataFrame:
        """The distinct ids that the query finds.

        A clause without children refers to the universe once, so that its filter reaches the scan. Other clauses refer to it many times, and a
        plan that repeats it takes the optimizer a time that grows exponentially with nesting: for them it is checkpointed (ids only).
        """
        ctx, incoming = self.context(store), self.for_.collection(store)
        if not isinstance(self.where, Clause) or self.where.children:
            incoming = cut(incoming)
        found = self.where.compile(ctx, incoming) if isinstance(self.where, Clause) else self.where(ctx, incoming)
        return found.select("nid").distinct()

    def results(self, store: TermStore, returns: ReturnType | None = None, limit: int | None = None) -> DataFrame:
        out = shape(self.context(store), self.compute(store), returns or self.returns)
        return out if limit is None else out.limit(limit)

    def simplified(self) -> Query:
        """The same query with nested Ands and Ors made flat and double Nots taken out of concepts' universes."""
        return Query(simplify(self.where), self.for_, self.let, self.returns, self.view) if isinstance(self.where, Clause) else self

    def explain(self) -> str:
        lines = [f"FOR {', '.join(t.value for t in self.for_.types)}", *(f"LET {k} = {v}" for k, v in self.let.items())]
        return "\n".join([*lines, "WHERE", self.where.explain(1) if isinstance(self.where, Clause) else f"  {self.where}", f"RETURN {self.returns.value}"])


def simplify(clause: Clause) -> Clause:
    """And of Ands and Or of Ors as one; an And or Or of one child is the child. Names (M2, M3) map ids and are left as they are."""
    if not clause.children:
        return clause
    parts = [simplify(c) for c in clause.children]
    for kind in (And, Or):
        if isinstance(clause, kind):
            flat = [x for c in parts for x in (c.children if isinstance(c, kind) and c.children else [c])]
            return flat[0] if len(flat) == 1 else type(clause)(*flat)
    return type(clause)(*parts)


def example_query(kind: int, child: int, concept: int) -> Query:
    """What is a kind of one concept, no child of another, and a third itself."""
    return Query(And(ConceptIsKindOf("kind"), Not(ConceptIsChildOf("parent")), ConceptIs("one")), let={"kind": kind, "parent": child, "one": concept})

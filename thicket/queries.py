"""The registered queries over the star schema, and the same in SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.functions import dynamic, text
from thicket.operators.clauses import (
    And, AndNot, ChangedFromPreviousVersion, Clause, ComponentIsMemberOfRefset, ComponentsFromExternalIds, ConceptForComponent, ConceptIs, ConceptIsChildOf, ConceptIsDescendentOf,
    ConceptIsKindOf, DescriptionActiveLuceneMatch, DescriptionActiveRegexMatch, DescriptionLuceneMatch, DescriptionRegexMatch, FullySpecifiedNameForConcept, Intersection, Not, Or,
    PreferredNameForConcept, RefsetContainsConcept, RefsetContainsKindOfConcept, RefsetContainsString, RefsetLuceneMatch, RelationshipIsCircular, RelRestriction, RelType, Union, Xor,
)
from thicket.plans import serde
from thicket.plans.model import LATEST, Coordinate, ForType, Premise, ReturnType, State
from thicket.plans.query import ForSet, Query, example_query
from thicket.session import ensure_checkpoint_dir
from thicket.sources.tables import BRAND, CUSTOMER, DOCUMENT, EVENTS, IS_A, LABELS, LINE, NATION, ORDER, PART, PART_TYPE, REFSET, REGION, ROOT, STEP, SUPPLIER, USER, VECTORS, named_nid, pair_nid, star_store
from thicket.streaming.index import TokenIndex, as_of_texts, changed_versions

# SQL --------------------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_T0, _T1 = "TIMESTAMP '1990-01-01'", "TIMESTAMP '2010-01-01'"


def _named(kind: int, column: str) -> str:
    return f"({kind * STEP} + CAST('0x' || substr(md5({column}), 1, 8) AS BIGINT))"


_TYPES = ", ".join(str(n) for n in (LINE, IS_A, *(LINE + f for f in (1, 2, 3)), *(pair_nid(f, s) for f in (1, 2, 3) for s in (1, 2))))
_PRELUDE = f"""WITH RECURSIVE
concept_v AS (
  SELECT {ROOT}::BIGINT AS nid, {_T0} AS time, 'ACTIVE' AS state
  UNION ALL SELECT unnest([{_TYPES}]), {_T0}, 'ACTIVE'
  UNION ALL SELECT {REGION * STEP} + r_regionkey, {_T0}, 'ACTIVE' FROM region
  UNION ALL SELECT {NATION * STEP} + n_nationkey, {_T0}, 'ACTIVE' FROM nation
  UNION ALL SELECT {CUSTOMER * STEP} + c_custkey, {_T0}, 'ACTIVE' FROM customer
  UNION ALL SELECT {SUPPLIER * STEP} + s_suppkey, {_T0}, 'ACTIVE' FROM supplier
  UNION ALL SELECT {ORDER * STEP} + o_orderkey, o_orderdate, 'ACTIVE' FROM orders
  UNION ALL SELECT {PART * STEP} + p_partkey, {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT DISTINCT {_named(PART_TYPE, "p_type")}, {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT DISTINCT {BRAND * STEP} + CAST(substr(p_brand, 7) AS BIGINT), {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT {USER * STEP} + user_id, ts, CASE WHEN event_type = 'error' THEN 'INACTIVE' ELSE 'ACTIVE' END FROM events),
concept_s AS (SELECT nid, time, state, md5(CAST(nid AS VARCHAR)) AS uuid FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY time DESC, state DESC) AS rn FROM concept_v) WHERE rn = 1 AND state = 'ACTIVE'),
line AS (SELECT {ORDER * STEP} + l_orderkey AS o, {LINE} + 10 * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END + CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS t,
  {PART * STEP} + l_partkey AS p, {SUPPLIER * STEP} + l_suppkey AS s, l_shipdate, {10 * STEP} + l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS row_id FROM lineitem),
rel_v AS (
  SELECT NULL::BIGINT AS nid, {REGION * STEP} + r_regionkey AS source, {IS_A}::BIGINT AS rtype, {ROOT}::BIGINT AS destination, {_T0} AS time, 'ACTIVE' AS state FROM region
  UNION ALL SELECT NULL, {NATION * STEP} + n_nationkey, {IS_A}, {REGION * STEP} + n_regionkey, {_T0}, 'ACTIVE' FROM nation
  UNION ALL SELECT NULL, {CUSTOMER * STEP} + c_custkey, {IS_A}, {NATION * STEP} + c_nationkey, {_T0}, 'ACTIVE' FROM customer
  UNION ALL SELECT NULL, {SUPPLIER * STEP} + s_suppkey, {IS_A}, {NATION * STEP} + s_nationkey, {_T0}, 'ACTIVE' FROM supplier
  UNION ALL SELECT NULL, {ORDER * STEP} + o_orderkey, {IS_A}, {CUSTOMER * STEP} + o_custkey, o_orderdate, 'ACTIVE' FROM orders
  UNION ALL SELECT NULL, {ORDER * STEP} + o_orderkey, {IS_A}, {CUSTOMER * STEP} + o_custkey, o_orderdate + INTERVAL 365 DAY, 'INACTIVE' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT DISTINCT NULL::BIGINT, {_named(PART_TYPE, "p_type")}, {IS_A}, {ROOT}, {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT DISTINCT NULL::BIGINT, {BRAND * STEP} + CAST(substr(p_brand, 7) AS BIGINT), {IS_A}, {ROOT}, {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT NULL, {PART * STEP} + p_partkey, {IS_A}, {_named(PART_TYPE, "p_type")}, {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT NULL, {PART * STEP} + p_partkey, {IS_A}, {BRAND * STEP} + CAST(substr(p_brand, 7) AS BIGINT), {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT NULL, n, {IS_A}, CASE WHEN n < {LINE + 10} THEN {LINE} ELSE {LINE} + (n - {LINE}) // 10 END, {_T0}, 'ACTIVE' FROM (SELECT unnest([{_TYPES}]) AS n) WHERE n > {LINE} AND n < {IS_A}
  UNION ALL SELECT row_id, o, t, p, l_shipdate, 'ACTIVE' FROM line
  UNION ALL SELECT row_id, o, t, s, l_shipdate, 'ACTIVE' FROM line),
rel_s AS (SELECT DISTINCT source, rtype, destination FROM (SELECT *, row_number() OVER (PARTITION BY source, rtype, destination ORDER BY time DESC, state DESC) AS rn FROM rel_v) WHERE rn = 1 AND state = 'ACTIVE'),
isa_s AS (SELECT source, destination FROM rel_s WHERE rtype = {IS_A}),
descr_v AS (
  SELECT 20000000000000 + doc_id AS nid, {PART * STEP} + (SELECT min(p_partkey) FROM part) + doc_id % (SELECT count(*) FROM part) AS concept_nid,
    CASE doc_id % 3 WHEN 0 THEN 'DEFINITION' WHEN 1 THEN 'SYNONYM' ELSE 'FSN' END AS dtype, lang, text, md5(source) AS ext_type, time, state
    FROM documents, (SELECT {_T0} AS time, 'ACTIVE' AS state, false AS gone UNION ALL SELECT {_T1}, 'INACTIVE', true)
    WHERE NOT gone OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT 21000000000000 + p_partkey, {PART * STEP} + p_partkey, 'FSN', 'en', p_name || ' (part)', NULL, {_T0}, 'ACTIVE' FROM part
  UNION ALL SELECT 22000000000000 + p_partkey, {PART * STEP} + p_partkey, 'SYNONYM', 'en', p_name, NULL, {_T0}, 'ACTIVE' FROM part),
descr_s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY time DESC, state DESC) AS rn FROM descr_v) WHERE rn = 1 AND state = 'ACTIVE'),
sememe_v AS (
  SELECT 30000000000000 + c_custkey AS nid, {_named(REFSET, "c_mktsegment")} AS assemblage, {CUSTOMER * STEP} + c_custkey AS referenced, c_name AS string1, NULL::BIGINT AS long1 FROM customer
  UNION ALL SELECT 31000000000000 + doc_id, {LABELS}, 20000000000000 + doc_id, NULL, 10 * quality + toxic FROM labels
  UNION ALL SELECT 32000000000000 + event_id, {EVENTS}, {USER * STEP} + user_id, NULL, NULL FROM events
  UNION ALL SELECT 33000000000000 + vec_id, {VECTORS}, {ROOT}, NULL, NULL FROM embeddings),
texts AS (SELECT DISTINCT nid, text FROM descr_v),
std AS (SELECT nid, generate_subscripts(t, 1) AS pos, unnest(t) AS term, len(t) AS n FROM (SELECT nid, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP})) AS t FROM texts)),
wsa AS (SELECT nid, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM (SELECT nid, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM texts))"""


def _sql(body: str, kinds: dict[str, int] | None = None, at: str | None = None, **more: str) -> str:
    """kinds: closures by name; at: a second snapshot, rel_t and isa_t, and closures over it where the name ends in _t."""
    out = _PRELUDE
    if at:
        out += f""",
rel_t AS (SELECT DISTINCT source, rtype, destination FROM (SELECT *, row_number() OVER (PARTITION BY source, rtype, destination ORDER BY time DESC, state DESC) AS rn FROM rel_v WHERE time <= TIMESTAMP '{at}') WHERE rn = 1 AND state = 'ACTIVE'),
isa_t AS (SELECT source, destination FROM rel_t WHERE rtype = {IS_A})"""
    for name, root in (kinds or {}).items():
        out += f",\n{name}(nid) AS (SELECT {root}::BIGINT UNION SELECT source FROM {'isa_t' if name.endswith('_t') else 'isa_s'} JOIN {name} ON destination = {name}.nid)"
    for name, sql in more.items():
        out += f",\n{name} AS ({sql})"
    return f"{out}\n{body}"


# registry ---------------------------------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None) -> None:
    def started(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return run(spark, sf_dir)

    QUERIES[name] = started
    if oracle:
        ORACLES[name] = oracle


def _query(name: str, where: Clause, oracle: str | None, **rest) -> None:
    q = Query(where, **rest)
    _register(name, lambda spark, sf_dir: q.results(star_store(spark, sf_dir)), oracle)


def _store(name: str, run: Callable, oracle: str | None) -> None:
    _register(name, lambda spark, sf_dir: run(star_store(spark, sf_dir)), oracle)


ASIA, NATION_7, BRAND_3, PROMO = REGION * STEP + 2, NATION * STEP + 7, BRAND * STEP + 3, named_nid(PART_TYPE, "PROMO")
BUILDING, HOUSEHOLD = named_nid(REFSET, "BUILDING"), named_nid(REFSET, "HOUSEHOLD")
EARLY = LATEST.at(1997, 6, 30)
_EARLY = "1997-06-30"
EVERYTHING = ForSet([ForType.ALL_COMPONENTS])
DESCRIPTIONS = ForSet([ForType.ALL_DESCRIPTIONS])
_CONCEPTS = "(SELECT DISTINCT nid FROM concept_v)"

# FOR and LET
_universes = {
    "for_all_concepts": ([ForType.ALL_CONCEPTS], "SELECT DISTINCT nid FROM concept_v"),
    "for_all_descriptions": ([ForType.ALL_DESCRIPTIONS], "SELECT DISTINCT nid FROM descr_v"),
    "for_all_sememes": ([ForType.ALL_SEMEMES], "SELECT DISTINCT nid FROM sememe_v"),
    "for_all_relationships": ([ForType.ALL_RELATIONSHIPS], "SELECT DISTINCT nid FROM rel_v WHERE nid IS NOT NULL"),
    "for_all_components": ([ForType.ALL_COMPONENTS], "SELECT nid FROM concept_v UNION SELECT nid FROM descr_v UNION SELECT nid FROM sememe_v"),
    "for_several": ([ForType.ALL_DESCRIPTIONS, ForType.ALL_SEMEMES], "SELECT nid FROM descr_v UNION SELECT nid FROM sememe_v"),
}
for _name, (_types, _body) in _universes.items():
    _query(_name, And(), _sql(_body), for_=ForSet(_types))
_SOME = [f"{n}" for n in (ROOT, ASIA, NATION_7, PART * STEP + 7)]


def _uuids(ids: list[str]) -> list[str]:
    return [hashlib.md5(i.encode()).hexdigest() for i in ids]


_query("for_custom_set", And(), _sql(f"SELECT DISTINCT nid FROM concept_v WHERE nid IN ({', '.join(_SOME)})"), for_=ForSet([ForType.CUSTOM_SET], _uuids(_SOME)))
_query("components_from_ids", ComponentsFromExternalIds("ids"), _sql(f"SELECT DISTINCT nid FROM concept_v WHERE nid IN ({', '.join(_SOME)})"), let={"ids": _uuids(_SOME)})

# hierarchy
_query("concept_is", ConceptIs("asia"), _sql(f"SELECT DISTINCT nid FROM concept_v WHERE nid = {ASIA}"), let={"asia": ASIA})
_query("child_of", ConceptIsChildOf("asia"), _sql(f"SELECT DISTINCT source AS nid FROM isa_s WHERE destination = {ASIA}"), let={"asia": ASIA})
_query("descendent_of", ConceptIsDescendentOf("asia"), _sql(f"SELECT nid FROM k WHERE nid <> {ASIA}", {"k": ASIA}), let={"asia": ASIA})
_query("kind_of", ConceptIsKindOf("asia"), _sql("SELECT nid FROM k", {"k": ASIA}), let={"asia": ASIA})
_query("kind_of_versioned", Or(ConceptIsKindOf("asia", "then")), _sql("SELECT nid FROM k_t", {"k_t": ASIA}, at=_EARLY), let={"asia": ASIA, "then": EARLY})

# set algebra
_both = {"asia": ASIA, "nation": NATION_7, "promo": PROMO, "brand": BRAND_3}
_k = {"a": ASIA, "n": NATION_7, "p": PROMO, "b": BRAND_3}
_query("and_", And(ConceptIsKindOf("promo"), ConceptIsKindOf("brand")), _sql("SELECT nid FROM p INTERSECT SELECT nid FROM b", _k), let=_both)
_query("intersection", Intersection(ConceptIsKindOf("asia"), ConceptIsDescendentOf("nation")), _sql(f"SELECT nid FROM n WHERE nid <> {NATION_7} AND nid IN (FROM a)", _k), let=_both)
_query("or_", Or(ConceptIsKindOf("brand"), ConceptIs("asia")), _sql(f"SELECT nid FROM b UNION SELECT {ASIA}", _k), let=_both)
_query("union_", Union(ConceptIsKindOf("promo"), ConceptIsKindOf("brand")), _sql("SELECT nid FROM p UNION SELECT nid FROM b", _k), let=_both)
_query("xor_", Xor(ConceptIsKindOf("promo"), ConceptIsKindOf("brand")), _sql("(SELECT nid FROM p EXCEPT SELECT nid FROM b) UNION (SELECT nid FROM b EXCEPT SELECT nid FROM p)", _k), let=_both)
_query("xor_three", Xor(ConceptIsKindOf("promo"), ConceptIsKindOf("brand"), ConceptIsChildOf("promo")), _sql(f"SELECT nid FROM (SELECT nid FROM p UNION ALL SELECT nid FROM b UNION ALL SELECT DISTINCT source FROM isa_s WHERE destination = {PROMO}) GROUP BY nid HAVING count(*) % 2 = 1", _k), let=_both)
_query("not_", Not(ConceptIsKindOf("asia")), _sql("SELECT nid FROM concept_s WHERE nid NOT IN (FROM a)", _k), let=_both)
_query("and_not", And(ConceptIsKindOf("promo"), AndNot(ConceptIsKindOf("brand"))), _sql("SELECT nid FROM p EXCEPT SELECT nid FROM b", _k), let=_both)
_query("and_not_two", AndNot(ConceptIsKindOf("promo"), ConceptIsKindOf("asia")), _sql("SELECT DISTINCT nid FROM concept_v EXCEPT SELECT nid FROM p EXCEPT SELECT nid FROM a", _k), let=_both)
_q = example_query(ASIA, ROOT, NATION_7)
_register("example_query", lambda spark, sf_dir: _q.results(star_store(spark, sf_dir)), _sql(f"SELECT nid FROM a WHERE nid = {NATION_7} AND nid NOT IN (SELECT source FROM isa_s WHERE destination = {ROOT})", _k))
_query("xor_versions", Xor(ConceptIsKindOf("asia"), ConceptIsKindOf("asia", "then")), _sql("(SELECT nid FROM k EXCEPT SELECT nid FROM k_t) UNION (SELECT nid FROM k_t EXCEPT SELECT nid FROM k)", {"k": ASIA, "k_t": ASIA}, at=_EARLY), let={"asia": ASIA, "then": EARLY})

# relationships
_AN = LINE + 1
_rel = {"type": _AN, "promo": PROMO, "part": PART * STEP + 7, "then": EARLY, "yes": True, "no": False}
_kr = {"t": _AN, "p": PROMO}
_restricted = "SELECT DISTINCT source AS nid FROM {} WHERE rtype IN (FROM {}) AND destination IN (FROM {}) AND source IN (SELECT nid FROM concept_v)"
_query("rel_restriction", RelRestriction("type", "promo"), _sql(_restricted.format("rel_s", "t", "p"), _kr), let=_rel)
_query("rel_restriction_flag", RelRestriction("type", "part", "no"), _sql(f"SELECT DISTINCT source AS nid FROM rel_s WHERE rtype IN (FROM t) AND destination = {PART * STEP + 7}", _kr), let=_rel)
_query("rel_restriction_no_dest_subsumption", RelRestriction("type", "part", destination_subsumption=False), _sql(f"SELECT DISTINCT source AS nid FROM rel_s WHERE rtype IN (FROM t) AND destination = {PART * STEP + 7}", _kr), let=_rel)
_query("rel_restriction_no_type_subsumption", RelRestriction("pair", "promo", type_subsumption=False), _sql(f"SELECT DISTINCT source AS nid FROM rel_s WHERE rtype = {pair_nid(1, 1)} AND destination IN (FROM p)", _kr), let=_rel | {"pair": pair_nid(1, 1)})
_query("rel_restriction_versioned", And(RelRestriction("type", "promo"), AndNot(RelRestriction("type", "promo", "then"))), _sql(f"{_restricted.format('rel_s', 't', 'p')} EXCEPT {_restricted.format('rel_t', 't_t', 'p_t')}", _kr | {"t_t": _AN, "p_t": PROMO}, at=_EARLY), let=_rel)
_query("rel_restriction_is_a", Or(RelRestriction("is_a", "asia")), _sql("SELECT DISTINCT source AS nid FROM isa_s WHERE destination IN (FROM k)", {"k": ASIA}), let={"is_a": IS_A, "asia": ASIA})
_query("rel_type", RelType("type"), _sql("SELECT DISTINCT source AS nid FROM rel_s WHERE rtype IN (FROM t)", _kr), let=_rel)
_query("rel_circular", RelationshipIsCircular("is_a", type_subsumption=False), _sql("SELECT DISTINCT source AS nid FROM isa_s"), let={"is_a": IS_A})
_query("nested_query_test", And(ConceptIsKindOf("asia"), And(Or(RelRestriction("type", "promo"), ConceptIsChildOf("nation")), Not(Or(ConceptIsChildOf("asia"), ConceptIs("asia"))))),
       _sql(f"SELECT nid FROM a WHERE (nid IN (SELECT source FROM rel_s WHERE rtype IN (FROM t) AND destination IN (FROM p)) OR nid IN (SELECT source FROM isa_s WHERE destination = {NATION_7})) AND nid NOT IN (SELECT source FROM isa_s WHERE destination = {ASIA}) AND nid <> {ASIA}", _k | {"t": _AN}), let=_both | _rel)

def _local_store(spark: SparkSession, sf_dir: str):
    """Orders also relate to the nations that their lines are supplied from."""
    store = star_store(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("l_suppkey") == F.col("s_suppkey"))
    columns = ["CAST(NULL AS LONG) AS nid", f"{ORDER * STEP} + l_orderkey AS source", f"{SUPPLIED} AS rtype", f"{NATION * STEP} + s_nationkey AS destination", "'INFERRED' AS premise", "l_shipdate AS time", "'ACTIVE' AS state"]
    store.relationship = store.relationship.unionByName(lines.selectExpr(*columns))
    return store


def _stated_store(spark: SparkSession, sf_dir: str):
    """What says which region a nation belongs to is stated, all else inferred."""
    store = star_store(spark, sf_dir)
    top = F.col("destination").between(REGION * STEP, NATION * STEP - 1) & (F.col("rtype") == IS_A)
    store.relationship = store.relationship.withColumn("premise", F.when(top, "STATED").otherwise(F.col("premise")))
    return store


SUPPLIED = IS_A + 1
_circular = Query(RelationshipIsCircular("supplied", type_subsumption=False), let={"supplied": SUPPLIED})
_register("rel_circular_some", lambda spark, sf_dir: _circular.results(_local_store(spark, sf_dir)),
          _sql("SELECT DISTINCT l.o AS nid FROM line l JOIN isa_s buyer ON buyer.source = l.o JOIN isa_s home ON home.source = buyer.destination JOIN isa_s seller ON seller.source = l.s WHERE home.destination = seller.destination"))
_stated = Query(ConceptIsKindOf("asia"), let={"asia": ASIA}, view=Coordinate(premise=Premise.STATED))
_register("kind_of_stated", lambda spark, sf_dir: _stated.results(_stated_store(spark, sf_dir)), _sql(f"SELECT {ASIA}::BIGINT AS nid UNION SELECT source FROM isa_s WHERE destination = {ASIA}"))

# versions
_HOUR = LATEST.at(2024, 1, 15, 12)
_users = (LATEST.with_states(State.ACTIVE, State.INACTIVE))
_store("latest_version", lambda st: st.snapshot("concept", _users).where(f"nid >= {USER * STEP} AND nid < {(USER + 1) * STEP}").select("nid", "time", "state"),
       f"SELECT {USER * STEP} + user_id AS nid, max(ts) AS time, arg_max(CASE WHEN event_type = 'error' THEN 'INACTIVE' ELSE 'ACTIVE' END, (ts, event_type = 'error')) AS state FROM events GROUP BY user_id")
_store("snapshot_as_of", lambda st: st.snapshot("concept", _HOUR).where(f"nid >= {USER * STEP} AND nid < {(USER + 1) * STEP}").select("nid", "time"),
       f"SELECT {USER * STEP} + user_id AS nid, max(ts) AS time FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id HAVING arg_max(event_type = 'error', (ts, event_type = 'error')) = false")
_BOTH_STATES = LATEST.at(2005, 1, 1)


def _documents(description: DataFrame, source: str | None) -> DataFrame:
    """The descriptions that are documents, of one source or of all."""
    if source is None:
        return description.where(F.col("nid").between(DOCUMENT * STEP, (DOCUMENT + 1) * STEP - 1))
    return description.where(F.col("ext_type") == F.md5(F.lit(source)))


def _edited_store(spark: SparkSession, sf_dir: str, source: str | None = "src0"):
    """Documents of a source (None: all) were edited in 2020."""
    store = star_store(spark, sf_dir)
    rows = _documents(store.description, source).where("state = 'ACTIVE'")
    store.description = store.description.unionByName(rows.withColumns({"text": F.concat("text", F.lit(" edited")), "time": F.expr("timestamp_ntz'2020-01-01 00:00:00'")}))
    return store


_changed = Query(ChangedFromPreviousVersion("then"), let={"then": _BOTH_STATES})
_register("changed_from_previous", lambda spark, sf_dir: _changed.results(_edited_store(spark, sf_dir)), _sql("SELECT DISTINCT concept_nid AS nid FROM descr_v WHERE ext_type = md5('src0') AND text IS NOT NULL"))

_register("changed_from_previous_all", lambda spark, sf_dir: _changed.results(_edited_store(spark, sf_dir, None)), _sql(f"SELECT DISTINCT concept_nid AS nid FROM descr_v WHERE nid >= {DOCUMENT * STEP} AND nid < {(DOCUMENT + 1) * STEP} AND text IS NOT NULL"))

# descriptions
_re = {"re": r"(?s)[Th].*\n.*is\b.*", "part_re": r".*(ring|bolt).*", "two": r"small .*"}
_query("desc_regex", DescriptionRegexMatch("re"), _sql(r"SELECT DISTINCT nid FROM descr_v WHERE regexp_full_match(text, '(?s)[Th].*\n.*is\b.*')"), let=_re, for_=DESCRIPTIONS)
_query("desc_active_regex", DescriptionActiveRegexMatch("re"), _sql(r"SELECT DISTINCT nid FROM descr_s WHERE regexp_full_match(text, '(?s)[Th].*\n.*is\b.*')"), let=_re, for_=DESCRIPTIONS)
_query("desc_active_regex_any_version", DescriptionActiveRegexMatch("re", any_version=True), _sql(r"SELECT DISTINCT nid FROM descr_v WHERE state = 'ACTIVE' AND regexp_full_match(text, '(?s)[Th].*\n.*is\b.*')"), let=_re, for_=DESCRIPTIONS)
_query("concept_for_component", ConceptForComponent(DescriptionRegexMatch("part_re")), _sql("SELECT DISTINCT concept_nid AS nid FROM descr_v WHERE regexp_full_match(text, '.*(ring|bolt).*')"), let=_re)
_query("not_concept_for_component", And(ConceptIsKindOf("promo"), Not(ConceptForComponent(DescriptionRegexMatch("part_re")))), _sql("SELECT nid FROM p WHERE nid NOT IN (SELECT concept_nid FROM descr_v WHERE regexp_full_match(text, '.*(ring|bolt).*'))", _k), let=_re | _both)
_best = "SELECT concept_nid, nid, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY concept_nid ORDER BY coalesce(nullif(list_position(['en', 'es', 'fr', 'de'], lang), 0), 5), nid) AS pick FROM descr_s WHERE dtype = '{}') WHERE pick = 1"
_fsn, _syn = _best.format("FSN"), _best.format("SYNONYM")
_query("fsn_for_concept", FullySpecifiedNameForConcept(ConceptIsKindOf("promo")), _sql(f"SELECT nid FROM ({_fsn}) WHERE concept_nid IN (FROM p)", _k), let=_both)
_query("preferred_for_concept", PreferredNameForConcept(ConceptIsKindOf("promo")), _sql(f"SELECT nid FROM ({_syn}) WHERE concept_nid IN (FROM p)", _k), let=_both)

# result shapes
_kinds = {"let": _both}
_query("return_uuids", ConceptIsKindOf("asia"), _sql("SELECT nid, uuid FROM concept_s WHERE nid IN (FROM a)", _k), returns=ReturnType.UUIDS, **_kinds)
_query("return_component", ConceptIsKindOf("promo"), _sql("SELECT nid, 'CONCEPT' AS kind, time, state FROM concept_s WHERE nid IN (FROM p)", _k), returns=ReturnType.COMPONENT, **_kinds)
_register("return_concept_version", lambda spark, sf_dir: Query(ConceptIsKindOf("asia"), let=_both).results(star_store(spark, sf_dir), ReturnType.CONCEPT_VERSION).select("nid", "uuid", "time", "state", F.size("members").cast("long").alias("n_members"), F.size("relationships").cast("long").alias("n_relationships")),
          _sql("SELECT nid, uuid, time, state, (SELECT count(*) FROM sememe_v m WHERE m.referenced = c.nid) AS n_members, (SELECT count(*) FROM rel_s r WHERE r.source = c.nid) AS n_relationships FROM concept_s c WHERE nid IN (FROM a)", _k))
_query("return_fsn", ConceptIsKindOf("promo"), _sql(f"SELECT * FROM ({_fsn}) WHERE concept_nid IN (FROM p)", _k), returns=ReturnType.DESCRIPTION_VERSION_FSN, **_kinds)
_query("return_for_component", ConceptIsKindOf("brand"), _sql(f"SELECT * FROM ({_fsn}) WHERE concept_nid IN (FROM b)", _k), returns=ReturnType.DESCRIPTION_FOR_COMPONENT, **_kinds)
_query("return_preferred", ConceptIsKindOf("promo"), _sql(f"SELECT * FROM ({_syn}) WHERE concept_nid IN (FROM p)", _k), returns=ReturnType.DESCRIPTION_VERSION_PREFERRED, **_kinds)

# reference sets
_ref = {"building": BUILDING, "household": HOUSEHOLD, "asia": ASIA, "customer": CUSTOMER * STEP + 33, "value": "11"}
_query("refset_contains_concept", RefsetContainsConcept("household", "customer"), _sql(f"SELECT DISTINCT assemblage AS nid FROM sememe_v WHERE assemblage = {HOUSEHOLD} AND referenced = {CUSTOMER * STEP + 33}"), let=_ref)
_query("refset_contains_kind_of_concept", RefsetContainsKindOfConcept("building", "asia"), _sql(f"SELECT DISTINCT assemblage AS nid FROM sememe_v WHERE assemblage = {BUILDING} AND referenced IN (FROM k)", {"k": ASIA}), let=_ref)
_query("refset_contains_string", RefsetContainsString("building", "CUSTOMER#00"), _sql(f"SELECT DISTINCT assemblage AS nid FROM sememe_v WHERE assemblage = {BUILDING} AND contains(lower(string1), 'customer#00')"), let=_ref)
_query("refset_long_match", RefsetLuceneMatch("value"), _sql("SELECT nid FROM sememe_v WHERE long1 = 11 ORDER BY nid LIMIT 1000"), let=_ref, for_=EVERYTHING)
_query("member_of_refset", ComponentIsMemberOfRefset("building"), _sql(f"SELECT DISTINCT referenced AS nid FROM sememe_v WHERE assemblage = {BUILDING}"), let=_ref)

# text
_texts = lambda st: st.description.select("nid", "text")


def _text(name: str, query: str, standard: str, whitespace: str | None, prefix: bool = False) -> None:
    """standard, whitespace: SQL for the ids that match under each analyzer."""
    _store(name, lambda st: text.match(_texts(st), query, prefix), _sql(standard if whitespace is None else f"({standard}) UNION ({whitespace})"))


_has = "SELECT nid FROM {0} WHERE term = '{1}'"
_text("text_terms", "ring widget", "SELECT DISTINCT nid FROM std WHERE term IN ('ring', 'widget')", "SELECT DISTINCT nid FROM wsa WHERE term IN ('ring', 'widget')")
_text("text_required_excluded", "+small +ring -part", "SELECT nid FROM std WHERE term = 'small' INTERSECT SELECT nid FROM std WHERE term = 'ring' EXCEPT SELECT nid FROM std WHERE term = 'part'", "SELECT nid FROM wsa WHERE term = 'small' INTERSECT SELECT nid FROM wsa WHERE term = 'ring' EXCEPT SELECT nid FROM wsa WHERE term = 'part'")
_text("text_boolean", "(small OR red) AND ring NOT part", "(SELECT nid FROM std WHERE term IN ('small', 'red') INTERSECT SELECT nid FROM std WHERE term = 'ring') EXCEPT SELECT nid FROM std WHERE term = 'part'", "(SELECT nid FROM wsa WHERE term IN ('small', 'red') INTERSECT SELECT nid FROM wsa WHERE term = 'ring') EXCEPT SELECT nid FROM wsa WHERE term = 'part'")
_phrase = "SELECT DISTINCT a.nid FROM {0} a JOIN {0} b ON a.nid = b.nid AND b.pos = a.pos + 1 WHERE a.term = 'small' AND b.term = 'ring'"
_text("text_phrase", '"small ring"', _phrase.format("std"), _phrase.format("wsa"))
_text("text_wildcard", "r?ng wid*", "SELECT DISTINCT nid FROM std WHERE term LIKE 'r_ng' OR term LIKE 'wid%'", "SELECT DISTINCT nid FROM wsa WHERE term LIKE 'r_ng' OR term LIKE 'wid%'")
_text("text_leading_wildcard", "*idget", "SELECT DISTINCT nid FROM std WHERE term LIKE '%idget'", "SELECT DISTINCT nid FROM wsa WHERE term LIKE '%idget'")
_text("text_prefix", "small ri", "SELECT nid FROM std WHERE term = 'small' INTERSECT SELECT nid FROM std WHERE term LIKE 'ri%'", "SELECT nid FROM wsa WHERE term = 'small' INTERSECT SELECT nid FROM wsa WHERE term LIKE 'ri%'", prefix=True)
_text("text_prefix_trailing_space", "small ring ", "SELECT nid FROM std WHERE term = 'small' INTERSECT SELECT nid FROM std WHERE term = 'ring'", "SELECT nid FROM wsa WHERE term = 'small' INTERSECT SELECT nid FROM wsa WHERE term = 'ring'", prefix=True)
_ring = "(SELECT nid FROM std WHERE term = 'ring' UNION SELECT nid FROM wsa WHERE term = 'ring')"
_store("text_by_type", lambda st: text.match(st.description.where("dtype = 'SYNONYM'").select("nid", "text"), "ring"), _sql(f"SELECT DISTINCT nid FROM descr_v WHERE dtype = 'SYNONYM' AND nid IN {_ring}"))
_store("text_by_ext_type", lambda st: text.match(st.description.where(F.col("ext_type") == F.md5(F.lit("src3"))).select("nid", "text"), "the"), _sql("SELECT DISTINCT nid FROM descr_v WHERE ext_type = md5('src3') AND nid IN (SELECT nid FROM wsa WHERE term = 'the')"))
_ranked = """weights AS (SELECT term, pow(1 + ln((SELECT count(DISTINCT nid) FROM texts)::DOUBLE / (count(DISTINCT nid) + 1)), 2) AS w FROM std WHERE term IN ({0}) GROUP BY term),
scored AS (SELECT nid, max(s) AS score FROM (SELECT nid, n, sum(w) / sqrt(n) AS s FROM (SELECT DISTINCT nid, term, n FROM std) JOIN weights USING (term) GROUP BY nid, n) GROUP BY nid),
found AS (SELECT nid FROM std WHERE term IN ({0}) UNION SELECT nid FROM wsa WHERE term IN ({0})),
hits AS (SELECT nid, round(coalesce(score, 0), 6) AS score FROM found LEFT JOIN scored USING (nid))"""


def _hits(body: str, *terms: str) -> str:
    return f"{_PRELUDE},\n{_ranked.format(', '.join(repr(t) for t in terms))}\n{body}"


_store("text_scored_topk", lambda st: text.search(_texts(st), "ring thand", limit=50), _hits("SELECT nid, score FROM hits ORDER BY score DESC, nid LIMIT 50", "ring", "thand"))
_query("desc_text", DescriptionLuceneMatch("words"), _hits("SELECT nid FROM hits ORDER BY score DESC, nid LIMIT 1000", "ring", "thand"), let={"words": "ring thand"}, for_=DESCRIPTIONS)
_query("desc_active_text", DescriptionActiveLuceneMatch("words"), _hits("SELECT nid FROM (SELECT nid FROM hits ORDER BY score DESC, nid LIMIT 1000) WHERE nid IN (SELECT nid FROM descr_s)", "idiot", "clown"), let={"words": "idiot clown"}, for_=DESCRIPTIONS)

# typed search
_store("long_equal", lambda st: st.sememe.where("long1 = 10").select("nid").distinct(), _sql("SELECT DISTINCT nid FROM sememe_v WHERE long1 = 10"))
_store("long_range", lambda st: st.sememe.where(F.col("long1").between(1, 10) & (F.col("assemblage") == LABELS)).select("nid").distinct(), _sql("SELECT DISTINCT nid FROM sememe_v WHERE long1 BETWEEN 1 AND 10"))
_event = "SELECT DISTINCT 32000000000000 + event_id AS nid FROM events WHERE "
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_ID = uuid.UUID("c4ca4238a0b923820dcc509a6f75849b")
for _name, _run, _where in (
    ("dyn_bool", lambda st: dynamic.equals(st.dynamic, True, EVENTS), "event_type = 'purchase'"),
    ("dyn_string", lambda st: dynamic.string_search(st.dynamic, "click OR sign*"), "event_type IN ('click', 'signup')"),
    ("dyn_int_equal", lambda st: dynamic.equals(st.dynamic, 42, columns=[0]), f"{_K} = 42"),
    ("dyn_long_range", lambda st: dynamic.between(st.dynamic, 10, 20, high_open=True, columns=[4]), "user_id >= 10 AND user_id < 20"),
    ("dyn_whole_range_any_column", lambda st: dynamic.between(st.dynamic, 60, 70), f"{_K} BETWEEN 60 AND 70 OR user_id BETWEEN 60 AND 70"),
    ("dyn_double_range_open", lambda st: dynamic.between(st.dynamic, 400.0, None, low_open=True, assemblage=EVENTS), "value > 400.0"),
    ("dyn_column_restricted", lambda st: dynamic.equals(st.dynamic, 5, columns=[0, 4]), f"{_K} = 5 OR user_id = 5"),
    ("dyn_uuid", lambda st: dynamic.equals(st.dynamic, _ID), "event_id = 1"),
    ("dyn_nid", lambda st: dynamic.nid_equals(st.dynamic, USER * STEP + 7), "user_id = 7"),
):
    _store(_name, _run, _event + _where)
_store("dyn_array_float", lambda st: dynamic.between(st.dynamic, 0.3, None, assemblage=VECTORS), "SELECT DISTINCT 33000000000000 + vec_id AS nid FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x >= 0.3::DOUBLE")

# index maintenance
_store("index_changed_versions", lambda st: changed_versions(st.description).select("nid", "time"), _sql("SELECT nid, min(time) AS time FROM descr_v GROUP BY nid"))
_register("index_changed_versions_edited", lambda spark, sf_dir: changed_versions(_edited_store(spark, sf_dir, None).description).select("nid", "time"),
          _sql(f"SELECT nid, min(time) AS time FROM descr_v GROUP BY nid UNION ALL SELECT DISTINCT nid, TIMESTAMP '2020-01-01' FROM descr_v WHERE nid >= {DOCUMENT * STEP} AND nid < {(DOCUMENT + 1) * STEP}"))


def _annotations(st, source: str | None) -> DataFrame:
    """Three annotations of each document of a source (None: of all): before its first version, between versions, after the last."""
    docs = _documents(st.description, source).select("nid").distinct()
    times = F.array(*(F.expr(f"timestamp_ntz'{t} 00:00:00'") for t in ("1980-01-01", "2000-01-01", "2022-01-01")))
    return docs.select("nid", F.lit("ann").alias("ext_type"), F.explode(times).alias("time"))


def _asof(spark: SparkSession, sf_dir: str, source: str | None = "src0") -> DataFrame:
    st = _edited_store(spark, sf_dir, source)
    return as_of_texts(st.description, _annotations(st, source)).select("nid", "time", F.md5("text").alias("text_md5"))


_register("index_asof_ext_type", _asof, """WITH docs AS (SELECT 20000000000000 + doc_id AS nid, text FROM documents WHERE source = 'src0' AND text IS NOT NULL)
SELECT nid, TIMESTAMP '1980-01-01' AS time, md5(text) AS text_md5 FROM docs UNION ALL SELECT nid, TIMESTAMP '2022-01-01', md5(text || ' edited') FROM docs""")  # fmt: skip
_register("index_asof_all", lambda spark, sf_dir: _asof(spark, sf_dir, None), """WITH docs AS (SELECT 20000000000000 + doc_id AS nid, text FROM documents WHERE text IS NOT NULL)
SELECT nid, TIMESTAMP '1980-01-01' AS time, md5(text) AS text_md5 FROM docs UNION ALL SELECT nid, TIMESTAMP '2022-01-01', md5(text || ' edited') FROM docs""")  # fmt: skip


def _config(spark: SparkSession) -> DataFrame:
    config = spark.createDataFrame([], dynamic.CONFIG)
    for assemblage, cols, time in ((EVENTS, [0], "2020-01-01"), (EVENTS, [1, 2], "2021-01-01"), (VECTORS, [0], "2020-01-01")):
        config = dynamic.configure(config, assemblage, cols, f"{time} 00:00:00")
    return config


_register("index_config_active", lambda spark, sf_dir: dynamic.indexed(star_store(spark, sf_dir).dynamic, _config(spark)).groupBy("assemblage", "col").agg(F.count_distinct("sememe_nid").alias("n")).select("assemblage", F.col("col").cast("long").alias("col"), "n"),
          f"SELECT {EVENTS}::BIGINT AS assemblage, unnest([1, 2])::BIGINT AS col, (SELECT count(*) FROM events) AS n UNION ALL SELECT {VECTORS}, 0, count(*) FROM embeddings")
_register("index_config_disabled", lambda spark, sf_dir: dynamic.indexed(star_store(spark, sf_dir).dynamic, dynamic.disable(_config(spark), EVENTS, "2022-01-01 00:00:00")).groupBy("assemblage").agg(F.count_distinct("sememe_nid").alias("n")),
          f"SELECT {VECTORS}::BIGINT AS assemblage, count(*) AS n FROM embeddings")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index the documents as a stream, then search the index."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a table may be one file or a folder of them
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*").select(F.col("doc_id").alias("nid"), "text")
    index = TokenIndex(spark, f"{base}/tokens")
    index.follow(stream, f"{base}/progress").awaitTermination()
    return index.tokens().groupBy("term").agg(F.count_distinct("nid").alias("df"), F.count("*").alias("n"))


_register("stream_index_generation", _streamed, f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP}))) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM t GROUP BY term""")  # fmt: skip

# serialization: what comes back from XML and JSON finds the same
_register("xml_round_trip", lambda spark, sf_dir: serde.from_xml(serde.to_xml(Query(And(ConceptIsKindOf("promo"), Not(ConceptIsKindOf("brand", "now"))), let=_both | {"now": LATEST}))).results(star_store(spark, sf_dir)), _sql("SELECT nid FROM p EXCEPT SELECT nid FROM b", _k))
_register("json_round_trip", lambda spark, sf_dir: serde.from_json(serde.to_json(Query(Xor(ConceptIsKindOf("promo"), ConceptIsKindOf("brand")), let=_both))).simplified().results(star_store(spark, sf_dir)), ORACLES["xor_"])

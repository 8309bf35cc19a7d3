"""The engine on a hand-built hierarchy, small enough to know every answer."""

from datetime import datetime

import pytest
from thicket.functions import dynamic, text
from thicket.operators.clauses import (
    And, AndNot, ChangedFromPreviousVersion, Clause, ComponentIsMemberOfRefset, ConceptForComponent, ConceptIs, ConceptIsChildOf, ConceptIsDescendentOf, ConceptIsKindOf,
    DescriptionActiveRegexMatch, DescriptionRegexMatch, FullySpecifiedNameForConcept, Not, Or, PreferredNameForConcept, RefsetContainsConcept, RefsetContainsKindOfConcept,
    RefsetContainsString, RefsetLuceneMatch, RelationshipIsCircular, RelRestriction, RelType, Xor,
)
from thicket.plans import serde
from thicket.plans.model import LATEST, SCHEMAS, Coordinate, DescriptionType, ForType, ReturnType, State
from thicket.plans.query import ForSet, Query, simplify
from thicket.session import ensure_checkpoint_dir
from thicket.sources.store import TermStore
from thicket.streaming.index import TokenIndex, as_of_texts, changed_versions

IS_A, TOUCHES, PRESSES = 99, 100, 101
OLD, MID, NEW = datetime(2010, 1, 1), datetime(2015, 1, 1), datetime(2020, 1, 1)
BEFORE = LATEST.at(2019, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    ensure_checkpoint_dir(spark)
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    concept = [(n, f"u{n}", OLD, "ACTIVE") for n in (1, 2, 3, 4, 5, 6, 7, IS_A, TOUCHES, PRESSES)]
    edges = [(2, 1), (3, 2), (4, 2), (5, 3), (6, 3), (6, 4), (7, 2), (PRESSES, TOUCHES)]
    relationship = [(None, a, IS_A, b, "INFERRED", OLD, "ACTIVE") for a, b in edges] + [(None, 7, IS_A, 2, "INFERRED", NEW, "INACTIVE")]
    relationship += [(900, 5, PRESSES, 4, "STATED", OLD, "ACTIVE"), (901, 6, TOUCHES, 3, "INFERRED", OLD, "ACTIVE"), (902, 4, TOUCHES, 2, "INFERRED", OLD, "ACTIVE")]
    names = {1: "root", 2: "motion", 3: "spin", 4: "drift", 5: "fast spin", 6: "wobble\n"}
    description = []
    for n, t in names.items():
        description += [(1000 + n, n, "FSN", "en", f"{t} (idea)", "x", OLD, "ACTIVE"), (2000 + n, n, "SYNONYM", "en", t, "x", OLD, "ACTIVE"), (3000 + n, n, "SYNONYM", "fr", f"le {t}", "x", OLD, "ACTIVE")]
    description += [(2003, 3, "SYNONYM", "en", "whirl", "x", NEW, "ACTIVE"), (2004, 4, "SYNONYM", "en", "drift", "x", NEW, "INACTIVE")]
    sememe = [(500, 200, 3, "STRING", "Mild spin", None, OLD, "ACTIVE"), (501, 200, 5, "STRING", "other", None, OLD, "ACTIVE"), (502, 201, 1, "LONG", None, 447, OLD, "ACTIVE")]
    none = (None,) * 6

    def attribute(n, col, dtype, pos=0, **v):
        kinds = ["v_str", "v_bool", "v_int", "v_long", "v_float", "v_double"]
        return (n, 300, col, pos, dtype, *(v.get(k, x) for k, x in zip(kinds, none)), OLD, "ACTIVE")

    rows = [
        attribute(600, 0, "INTEGER", v_int=-5), attribute(601, 0, "INTEGER", v_int=7), attribute(600, 1, "STRING", v_str="quiet -12 river"), attribute(601, 1, "STRING", v_str="storm"),
        attribute(600, 2, "DOUBLE", v_double=-0.5), attribute(601, 2, "DOUBLE", v_double=7.0), attribute(600, 3, "FLOAT", 0, v_float=0.25), attribute(600, 3, "FLOAT", 1, v_float=0.75),
        attribute(601, 4, "BOOLEAN", v_bool=True), attribute(600, 6, "NID", v_long=-5), attribute(600, 7, "LONG", v_long=7),
    ]
    return TermStore(spark, make("concept", concept), make("description", description), make("relationship", relationship), make("sememe", sememe), make("dynamic", rows), IS_A)


def find(store, where, view=LATEST, for_=None, **let):
    return {r["nid"] for r in Query(where, for_ or ForSet(), let, view=view).compute(store).collect()}


def ids(df):
    return {r["nid"] for r in df.collect()}


ALL = {1, 2, 3, 4, 5, 6, 7, IS_A, TOUCHES, PRESSES}
DESCRIPTIONS = ForSet([ForType.ALL_DESCRIPTIONS])


def test_hierarchy(store):
    assert find(store, ConceptIs(3)) == {3}
    assert find(store, ConceptIsChildOf(2)) == {3, 4}
    assert find(store, ConceptIsDescendentOf(2)) == {3, 4, 5, 6}
    assert find(store, ConceptIsKindOf(2)) == {2, 3, 4, 5, 6}
    assert find(store, ConceptIsKindOf(2, "then"), then=BEFORE) == {2, 3, 4, 5, 6, 7}
    assert find(store, ConceptIsKindOf(2), view=LATEST.at(2000, 1, 1)) == {2}


def test_set_algebra_identities(store):
    a, b = ConceptIsKindOf(3), ConceptIsKindOf(4)
    assert find(store, And(a, b)) == {6} and find(store, Or(a, b)) == {3, 4, 5, 6} and find(store, Xor(a, b)) == {3, 4, 5}
    assert find(store, Xor(a, a)) == set() and find(store, Xor(a, b, ConceptIs(6))) == {3, 4, 5, 6}
    assert find(store, And()) == ALL and find(store, Or()) == set() == find(store, Xor())
    assert find(store, Not(Not(a))) == find(store, a)
    assert find(store, Not(a)) == ALL - {3, 5, 6}
    assert find(store, AndNot(a, ConceptIs(1))) == ALL - {1, 3, 5, 6}
    assert find(store, And(ConceptIsKindOf(2), AndNot(RelRestriction(TOUCHES, 3)))) == {2, 3, 4, 5}
    assert find(store, Not(RelRestriction(TOUCHES, 3))) == ALL - {6}
    assert find(store, Or(a), for_=ForSet([ForType.CUSTOM_SET], ["u5", "u1", "none"])) == {5}
    assert find(store, a, for_=DESCRIPTIONS) == set()


def test_relationships(store):
    assert find(store, RelRestriction(TOUCHES, 2)) == {4, 5, 6}
    assert find(store, RelRestriction(TOUCHES, 2, type_subsumption=False)) == {4, 6}
    assert find(store, RelRestriction(TOUCHES, 2, "flag"), flag=False) == {4}
    assert find(store, RelRestriction(IS_A, 2, "then"), then=BEFORE) == {3, 4, 5, 6, 7}
    assert find(store, RelType(TOUCHES)) == {4, 5, 6} and find(store, RelType(TOUCHES, type_subsumption=False)) == {4, 6}
    assert find(store, RelationshipIsCircular(TOUCHES)) == {4, 6}


def test_reference_sets(store):
    any_set = ForSet([ForType.ALL_COMPONENTS])
    assert find(store, RefsetContainsConcept(200, 3)) == {200} and find(store, RefsetContainsConcept(200, 4)) == set()
    assert find(store, RefsetContainsKindOfConcept(200, 2)) == {200} and find(store, RefsetContainsKindOfConcept(200, 4)) == set()
    assert find(store, RefsetContainsString(200, "mILD")) == {200} and find(store, RefsetContainsString(200, "wild")) == set()
    assert find(store, RefsetLuceneMatch("k"), for_=any_set, k="447") == {502}
    assert find(store, ComponentIsMemberOfRefset(200)) == {3, 5}


def test_descriptions(store):
    assert find(store, DescriptionRegexMatch("r"), for_=DESCRIPTIONS, r="s.*n") == {2003}  # an earlier version
    assert find(store, DescriptionActiveRegexMatch("r"), for_=DESCRIPTIONS, r="s.*n") == set()
    assert find(store, DescriptionActiveRegexMatch("r", any_version=True), for_=DESCRIPTIONS, r="drift") == {2004}
    assert find(store, DescriptionActiveRegexMatch("r"), for_=DESCRIPTIONS, r="drift") == set()
    assert find(store, DescriptionRegexMatch("r"), for_=DESCRIPTIONS, r="wobble") == set()  # not up to a last line break
    assert find(store, ConceptForComponent(DescriptionRegexMatch("r")), r=".*spin.*") == {3, 5}
    assert find(store, FullySpecifiedNameForConcept(ConceptIsKindOf(3))) == {1003, 1005, 1006}
    assert find(store, PreferredNameForConcept(Or(ConceptIs(4), ConceptIs(3), ConceptIs(7)))) == {2003, 3004}
    french = Coordinate(languages=("fr", "en"))
    assert find(store, PreferredNameForConcept(ConceptIs(3)), view=french) == {3003}
    assert find(store, ChangedFromPreviousVersion("then"), then=BEFORE) == {3}


def test_snapshots(store):
    both = LATEST.with_states(State.ACTIVE, State.INACTIVE)
    assert store.snapshot("description", LATEST).where("nid = 2004").count() == 0
    assert store.snapshot("description", BEFORE).where("nid = 2004").count() == 1
    assert store.snapshot("description", both).where("nid = 2004").first()["state"] == "INACTIVE"


def test_result_shapes(store):
    q = Query(ConceptIsKindOf(3))
    assert {(r["nid"], r["uuid"]) for r in q.results(store, ReturnType.UUIDS).collect()} == {(3, "u3"), (5, "u5"), (6, "u6")}
    assert {r["kind"] for r in q.results(store, ReturnType.COMPONENT).collect()} == {"CONCEPT"}
    rows = {r["nid"]: r for r in q.results(store, ReturnType.CONCEPT_VERSION).collect()}
    assert [m["assemblage"] for m in rows[3]["members"]] == [200] and len(rows[6]["relationships"]) == 3 and rows[6]["members"] == []
    assert {r["text"] for r in q.results(store, ReturnType.DESCRIPTION_VERSION_PREFERRED).collect()} == {"whirl", "fast spin", "wobble\n"}
    assert q.results(store, ReturnType.DESCRIPTION_FOR_COMPONENT).count() == 3 and q.results(store, limit=2).count() == 2
    with pytest.raises(ValueError):
        q.results(store, "OTHER")
    with pytest.raises(ValueError):
        ForSet(["OTHER"]).collection(store)
    assert [DescriptionType.from_ordinal(n).name for n in range(3)] == ["FSN", "SYNONYM", "DEFINITION"]
    with pytest.raises(ValueError):
        DescriptionType.from_ordinal(9)


def test_serialized_queries_run(store):
    q = Query(And(ConceptIsKindOf("k", "then"), Not(Or(ConceptIs("one"), RelRestriction(TOUCHES, 3, type_subsumption=False)))), let={"k": 2, "then": BEFORE, "one": 5}, view=LATEST)
    expect = {2, 3, 4, 7}
    assert find(store, q.where, **q.let) == expect
    for write, read in ((serde.to_json, serde.from_json), (serde.to_xml, serde.from_xml)):
        back = read(write(q))
        assert write(back) == write(q) and ids(back.compute(store)) == expect
    assert "ConceptIsKindOf" in q.explain() and q.where.where_tree()["semantic"] == "And"
    with pytest.raises(ValueError):
        serde.clause_from_dict({"clause": "Nothing"})


def test_simplified_queries_find_the_same(store):
    where = And(And(ConceptIsKindOf(2), And(ConceptIsKindOf(3))), Or(Or(ConceptIs(5), ConceptIs(6)), ConceptIs(1)))
    assert [type(c).__name__ for c in simplify(where).children] == ["ConceptIsKindOf", "ConceptIsKindOf", "Or"]
    assert find(store, simplify(where)) == find(store, where) == {5, 6}


def test_custom_clauses(store):
    class Odd(Clause):
        def compile(self, ctx, incoming):
            return incoming.where("nid % 2 = 1")

    assert find(store, And(ConceptIsKindOf(2), Odd())) == {3, 5}
    assert ids(Query(lambda ctx, incoming: incoming.where("nid < 3")).compute(store)) == {1, 2}


TEXTS = [(1, "The small red ring"), (2, "red small widget"), (3, "A ring, a small ring"), (4, "don't stop"), (5, None), (6, ""), (3, "A ring, a small ring")]


@pytest.mark.parametrize(
    "query,expect",
    [
        ("ring", {1, 3}), ("ring widget", {1, 2, 3}), ("+ring -red", {3}), ("ring AND red", {1}), ("ring OR widget", {1, 2, 3}), ("ring NOT red", {3}), ('"small ring"', {3}), ('"ring small ring"', {3}),
        ('"red small"', {2}), ("wid*", {2}), ("*dget", {2}), ("r?ng", {1, 3}), ("(ring OR widget) AND small", {1, 2, 3}), ("don't", {4}), ("the", {1}), ("nothing", set()), ("", set()), ("-ring", set()), ("RING)", {1, 3}),
    ],
)
def test_text_queries(spark, query, expect):
    rows = spark.createDataFrame(TEXTS, "nid long, text string")
    assert ids(text.match(rows, query)) == expect


def test_prefix_and_scores(spark):
    rows = spark.createDataFrame(TEXTS, "nid long, text string")
    assert ids(text.match(rows, "small ri", prefix=True)) == {1, 3} and ids(text.match(rows, "small ri ", prefix=True)) == set()
    best = text.search(rows, "ring widget", limit=2).collect()
    assert [r["nid"] for r in best][0] == 2 and len(best) == 2 and best[0]["score"] > best[1]["score"]


def test_typed_search(store):
    d = store.dynamic
    assert ids(dynamic.equals(d, -5)) == {600} and ids(dynamic.equals(d, 7)) == {600, 601} and ids(dynamic.equals(d, 7, columns=[0])) == {601}
    assert ids(dynamic.equals(d, 7.0)) == {601} and ids(dynamic.equals(d, True)) == {601} and ids(dynamic.nid_equals(d, -5)) == {600}
    assert ids(dynamic.between(d, -10, -1)) == {600} and ids(dynamic.between(d, -1.0, 0.0)) == {600} and ids(dynamic.between(d, 0.7, None, assemblage=300, columns=[3])) == {600}
    assert ids(dynamic.between(d, 7, None, low_open=True)) == set() and ids(dynamic.between(d, None, 7, high_open=True)) == {600}
    assert ids(dynamic.string_search(d, "-12")) == {600} and ids(dynamic.string_search(d, "stor", prefix=True)) == {601}
    for wrong in (lambda: dynamic.equals(d, b"x"), lambda: dynamic.between(d, None, None), lambda: dynamic.between(d, "a", 1)):
        with pytest.raises(ValueError):
            wrong()


def test_index_configuration(spark, store):
    none = spark.createDataFrame([], dynamic.CONFIG)
    one = dynamic.configure(none, 300, [0, 1], "2020-01-01 00:00:00")
    assert dynamic.is_indexed(one, 300) and not dynamic.is_indexed(none, 300)
    assert dynamic.indexed(store.dynamic, one).select("col").distinct().count() == 2
    off = dynamic.disable(one, 300, "2021-01-01 00:00:00")
    assert not dynamic.is_indexed(off, 300) and dynamic.disable(none, 300, "2021-01-01 00:00:00").count() == 0
    with pytest.raises(ValueError):
        dynamic.configure(none, 300, None, "2020-01-01 00:00:00")


def test_versions_to_index(spark, store):
    changed = {(r["nid"], r["text"]) for r in changed_versions(store.description).where("concept_nid IN (3, 4) AND lang = 'en' AND dtype = 'SYNONYM'").collect()}
    assert changed == {(2003, "spin"), (2003, "whirl"), (2004, "drift")}
    notes = spark.createDataFrame([(2003, "t", datetime(2000, 1, 1)), (2003, "t", MID), (2003, "t", datetime(2021, 1, 1))], "nid long, ext_type string, time timestamp_ntz")
    assert [(r["time"].year, r["text"]) for r in as_of_texts(store.description, notes).orderBy("time").collect()] == [(2000, "spin"), (2021, "whirl")]


def test_token_index(spark, tmp_path):
    schema = "nid long, text string"
    index = TokenIndex(spark, f"{tmp_path}/index")
    assert index.generation() == -1 and index.tokens().count() == 0
    spark.createDataFrame([(1, "quiet river"), (2, "storm")], schema).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    index.follow(stream(), f"{tmp_path}/progress").awaitTermination()
    first = index.generation()
    spark.createDataFrame([(2, "storm"), (3, "river storm")], schema).write.parquet(f"{tmp_path}/in/b")
    index.follow(stream(), f"{tmp_path}/progress").awaitTermination()
    assert index.generation() > first >= 0
    terms = lambda: sorted((r["term"], r["nid"]) for r in index.tokens().collect())
    expect = [("quiet", 1), ("river", 1), ("river", 3), ("storm", 2), ("storm", 3)]
    assert terms() == expect
    index.compact()
    assert terms() == expect
    index.enabled = False
    index.add(spark.createDataFrame([(9, "none")], schema), 99)
    assert terms() == expect
    index.clear()
    assert index.generation() == -1

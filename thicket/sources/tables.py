"""A store over a star schema: regions, nations, customers, suppliers, orders and parts as a hierarchy of concepts, line items as
relationships, names and documents as descriptions, segments and labels as reference sets, events as versions and attributes.

A component's id is its kind times 10^12 plus its key. Keys of named values (part types, segments) come from a hash of the name,
so no table is needed to number them.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thicket.sources.store import TermStore

STEP = 10**12
ROOT = 0
REGION, NATION, CUSTOMER, SUPPLIER, ORDER, PART, PART_TYPE, BRAND, RTYPE, ROW, USER, REFSET = range(1, 13)
DOCUMENT, PART_FSN, PART_SYNONYM = 20, 21, 22
MEMBER, LABEL, EVENT, VECTOR = 30, 31, 32, 33

LINE = RTYPE * STEP
IS_A = RTYPE * STEP + 1000
LABELS = REFSET * STEP
EVENTS = REFSET * STEP + 1
VECTORS = REFSET * STEP + 2

START, EDITED = "timestamp_ntz'1990-01-01 00:00:00'", "timestamp_ntz'2010-01-01 00:00:00'"


def nid(kind: int, key: Column | str) -> Column:
    return F.lit(kind * STEP) + (F.col(key) if isinstance(key, str) else key).cast("long")


def named(kind: int, name: Column | str) -> Column:
    """The id of a named value: a hash of the name as its key."""
    return F.lit(kind * STEP) + F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def named_nid(kind: int, name: str) -> int:
    return kind * STEP + int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def _flag() -> Column:
    return F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)


def pair_nid(flag: int, status: int) -> int:
    return RTYPE * STEP + 10 * flag + status


class StarStore(TermStore):
    """Each table is planned when a query first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.is_a, self._closures, self._folder = spark, IS_A, {}, sf_dir

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{table}.parquet")

    def _rows(self, ids: list[int]) -> DataFrame:
        """(nid) of a few fixed ids."""
        return self.spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("nid"))

    def _types(self) -> DataFrame:
        return self._rows([LINE, IS_A, *(LINE + f for f in (1, 2, 3)), *(pair_nid(f, s) for f in (1, 2, 3) for s in (1, 2))])

    @cached_property
    def concept(self) -> DataFrame:
        start = F.expr(START)
        region = self._read("region")
        nation = self._read("nation")
        customer = self._read("customer")
        supplier = self._read("supplier")
        orders = self._read("orders")
        part = self._read("part")
        events = self._read("events")

        def concepts(df: DataFrame, key: Column, time: Column = start, state: Column = F.lit("ACTIVE")) -> DataFrame:  # noqa: B008
            return df.select(key.alias("nid"), F.md5(key.cast("string")).alias("uuid"), time.alias("time"), state.alias("state"))

        types = self._types()
        root = self._rows([ROOT])
        concept = concepts(root, F.col("nid"))
        for rows in (
            concepts(types, F.col("nid")),
            concepts(region, nid(REGION, "r_regionkey")),
            concepts(nation, nid(NATION, "n_nationkey")),
            concepts(customer, nid(CUSTOMER, "c_custkey")),
            concepts(supplier, nid(SUPPLIER, "s_suppkey")),
            concepts(orders, nid(ORDER, "o_orderkey"), F.col("o_orderdate")),
            concepts(part, nid(PART, "p_partkey")),
            concepts(part.select("p_type").distinct(), named(PART_TYPE, "p_type")),
            concepts(part.select("p_brand").distinct(), nid(BRAND, F.substring("p_brand", 7, 9))),
            concepts(events, nid(USER, "user_id"), F.col("ts"), F.when(F.col("event_type") == "error", "INACTIVE").otherwise("ACTIVE")),
        ):
            concept = concept.unionByName(rows)
        return concept

    @cached_property
    def relationship(self) -> DataFrame:
        start = F.expr(START)
        types = self._types()
        region = self._read("region")
        nation = self._read("nation")
        customer = self._read("customer")
        supplier = self._read("supplier")
        orders = self._read("orders")
        part = self._read("part")
        lineitem = self._read("lineitem")

        def edges(df: DataFrame, source: Column, destination: Column, rtype: Column = F.lit(IS_A), time: Column = start, state: str = "ACTIVE") -> DataFrame:  # noqa: B008
            return df.select(F.lit(None).cast("long").alias("nid"), source.alias("source"), rtype.cast("long").alias("rtype"), destination.alias("destination"), F.lit("INFERRED").alias("premise"), time.alias("time"), F.lit(state).alias("state"))

        top = F.lit(ROOT).cast("long")
        order, buyer = nid(ORDER, "o_orderkey"), nid(CUSTOMER, "o_custkey")
        relationship = edges(region, nid(REGION, "r_regionkey"), top)
        pairs = types.where((F.col("nid") > LINE) & (F.col("nid") < IS_A))
        up = F.when(F.col("nid") < LINE + 10, F.lit(LINE)).otherwise(F.lit(LINE) + F.floor((F.col("nid") - LINE) / 10))
        line = lineitem.select(nid(ORDER, "l_orderkey").alias("o"), (F.lit(RTYPE * STEP) + 10 * _flag() + F.when(F.col("l_linestatus") == "F", 1).otherwise(2)).alias("t"), nid(PART, "l_partkey").alias("p"), nid(SUPPLIER, "l_suppkey").alias("s"), "l_shipdate", (F.lit(ROW * STEP) + F.col("l_orderkey") * 10**6 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("row"))
        for rows in (
            edges(nation, nid(NATION, "n_nationkey"), nid(REGION, "n_regionkey")),
            edges(customer, nid(CUSTOMER, "c_custkey"), nid(NATION, "c_nationkey")),
            edges(supplier, nid(SUPPLIER, "s_suppkey"), nid(NATION, "s_nationkey")),
            edges(orders, order, buyer, time=F.col("o_orderdate")),
            edges(orders.where("o_orderstatus = 'F'"), order, buyer, time=F.expr("o_orderdate + interval 365 days"), state="INACTIVE"),
            edges(part.select("p_type").distinct(), named(PART_TYPE, "p_type"), top),
            edges(part.select("p_brand").distinct(), nid(BRAND, F.substring("p_brand", 7, 9)), top),
            edges(part, nid(PART, "p_partkey"), named(PART_TYPE, "p_type")),
            edges(part, nid(PART, "p_partkey"), nid(BRAND, F.substring("p_brand", 7, 9))),
            edges(pairs, F.col("nid"), up.cast("long")),
            *(line.select(F.col("row").alias("nid"), F.col("o").alias("source"), F.col("t").cast("long").alias("rtype"), F.col(c).alias("destination"), F.lit("INFERRED").alias("premise"), F.col("l_shipdate").alias("time"), F.lit("ACTIVE").alias("state")) for c in ("p", "s")),
        ):
            relationship = relationship.unionByName(rows)
        return relationship

    @cached_property
    def description(self) -> DataFrame:
        start, edited = F.expr(START), F.expr(EDITED)
        part = self._read("part")
        documents = self._read("documents")
        labels = self._read("labels")

        def described(df: DataFrame, key: Column, owner: Column, dtype: Column, lang: Column, text: Column, time: Column = start, state: str = "ACTIVE") -> DataFrame:  # noqa: B008
            return df.select(key.alias("nid"), owner.alias("concept_nid"), dtype.alias("dtype"), lang.alias("lang"), text.alias("text"), F.lit(None).cast("string").alias("ext_type"), time.alias("time"), F.lit(state).alias("state"))

        # documents describe parts, dealt out by number
        n_parts, first_part = part.agg(F.count("*"), F.min("p_partkey")).first()
        doc_owner = F.lit(PART * STEP + (first_part or 0)) + F.pmod("doc_id", F.lit(n_parts or 1))
        doc_type = F.element_at(F.array(F.lit("DEFINITION"), F.lit("SYNONYM"), F.lit("FSN")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
        toxic = labels.where("toxic = 1").select("doc_id").distinct()
        texts = [nid(DOCUMENT, "doc_id").alias("nid"), doc_owner.alias("concept_nid"), doc_type.alias("dtype"), "lang", "text", F.md5("source").alias("ext_type")]
        doc_rows = documents.select(*texts, start.alias("time"), F.lit("ACTIVE").alias("state"))
        gone = documents.join(toxic, "doc_id", "left_semi").select(*texts, edited.alias("time"), F.lit("INACTIVE").alias("state"))
        return (
            doc_rows.unionByName(gone)
            .unionByName(described(part, nid(PART_FSN, "p_partkey"), nid(PART, "p_partkey"), F.lit("FSN"), F.lit("en"), F.concat("p_name", F.lit(" (part)"))))
            .unionByName(described(part, nid(PART_SYNONYM, "p_partkey"), nid(PART, "p_partkey"), F.lit("SYNONYM"), F.lit("en"), F.col("p_name")))
        )

    @cached_property
    def sememe(self) -> DataFrame:
        start = F.expr(START)
        customer = self._read("customer")
        labels = self._read("labels")
        events = self._read("events")
        embeddings = self._read("embeddings")

        def members(df: DataFrame, key: Column, assemblage: Column, referenced: Column, kind: str, string1: Column, long1: Column) -> DataFrame:
            return df.select(key.alias("nid"), assemblage.alias("assemblage"), referenced.alias("referenced"), F.lit(kind).alias("kind"), string1.cast("string").alias("string1"), long1.cast("long").alias("long1"), start.alias("time"), F.lit("ACTIVE").alias("state"))

        none = F.lit(None)
        return members(customer, nid(MEMBER, "c_custkey"), named(REFSET, "c_mktsegment"), nid(CUSTOMER, "c_custkey"), "STRING", F.col("c_name"), none).unionByName(
            members(labels, nid(LABEL, "doc_id"), F.lit(LABELS), nid(DOCUMENT, "doc_id"), "LONG", none, 10 * F.col("quality") + F.col("toxic"))
        ).unionByName(members(events, nid(EVENT, "event_id"), F.lit(EVENTS), nid(USER, "user_id"), "DYNAMIC", none, none)).unionByName(members(embeddings, nid(VECTOR, "vec_id"), F.lit(VECTORS), F.lit(ROOT).cast("long"), "DYNAMIC", none, none))

    @cached_property
    def dynamic(self) -> DataFrame:
        start, none = F.expr(START), F.lit(None)
        events = self._read("events")
        embeddings = self._read("embeddings")

        values = {"v_str": "string", "v_bool": "boolean", "v_int": "int", "v_long": "long", "v_float": "float", "v_double": "double"}

        def attribute(col: int, dtype: str, **value: Column) -> Column:
            return F.struct(F.lit(col).alias("col"), F.lit(dtype).alias("dtype"), *(value.get(v, none).cast(t).alias(v) for v, t in values.items()))

        columns = F.array(
            attribute(0, "INTEGER", v_int=F.get_json_object("props", "$.k")),
            attribute(1, "STRING", v_str=F.col("event_type")),
            attribute(2, "DOUBLE", v_double=F.col("value")),
            attribute(3, "BOOLEAN", v_bool=F.col("event_type") == "purchase"),
            attribute(4, "LONG", v_long=F.col("user_id")),
            attribute(5, "UUID", v_str=F.md5(F.col("event_id").cast("string"))),
            attribute(6, "NID", v_long=nid(USER, "user_id")),
        )
        rest = [F.lit(0).alias("pos"), start.alias("time"), F.lit("ACTIVE").alias("state")]
        flat = events.select(nid(EVENT, "event_id").alias("sememe_nid"), F.lit(EVENTS).alias("assemblage"), F.explode(columns).alias("a")).select("sememe_nid", "assemblage", "a.*", *rest)
        nested = embeddings.select(nid(VECTOR, "vec_id").alias("sememe_nid"), F.lit(VECTORS).alias("assemblage"), F.posexplode("embedding").alias("pos", "v_float")).select(
            "sememe_nid", "assemblage", F.lit(0).alias("col"), F.lit("FLOAT").alias("dtype"), *(F.col("v_float").cast("float") if v == "v_float" else none.cast(t).alias(v) for v, t in values.items()), "pos", start.alias("time"), F.lit("ACTIVE").alias("state")
        )
        return flat.unionByName(nested)


def star_store(spark: SparkSession, sf_dir: str) -> StarStore:
    return StarStore(spark, sf_dir)

"""Full-text search over a token table: analyzers, a query-string parser, prefix search, scoring.

Every text is analyzed twice: into words (runs of letters and digits, lower-cased, without English stop words) and into tokens between
white space (lower-cased). A query matches if it does under either analyzer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The stop words of the standard English analyzer.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]

STANDARD, WHITESPACE = "standard", "whitespace"


def analyzed(text: Column, analyzer: str) -> Column:
    """The terms of a text, in order."""
    if analyzer == WHITESPACE:
        return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(STOP_WORDS))


def analyze(text: str, analyzer: str) -> list[str]:
    """The same for a query's text."""
    if analyzer == WHITESPACE:
        return text.lower().split()
    return [t for t in re.split(r"[\W_]+", text.lower()) if t and t not in STOP_WORDS]


def token_table(rows: DataFrame, analyzer: str = STANDARD) -> DataFrame:
    """(nid, term, pos, len, version) of every term of rows (nid, text). len: terms of the text; version: a hash of it."""
    terms = rows.select("nid", F.xxhash64("text").alias("version"), analyzed(F.col("text"), analyzer).alias("terms"))
    return terms.select("nid", "version", F.size("terms").alias("len"), F.posexplode("terms").alias("pos", "term")).select("nid", "term", "pos", "len", "version")


# query strings ----------------------------------------------------------------------------------------------------------


@dataclass
class Term:
    text: str


@dataclass
class Phrase:
    text: str


@dataclass
class Wildcard:
    """``*`` any characters, ``?`` one."""

    text: str

    def like(self) -> str:
        escaped = re.sub(r"([\\%_])", r"\\\1", self.text.lower())
        return escaped.replace("*", "%").replace("?", "_")


@dataclass
class Group:
    """parts: (occurs, part) with occurs in MUST, SHOULD, NOT."""

    parts: list[tuple[str, Term | Phrase | Wildcard | Group]]


MUST, SHOULD, NOT = "+", " ", "-"
_LEX = re.compile(r'\s*(?:(?P<quote>"[^"]*"?)|(?P<open>\()|(?P<close>\))|(?P<sign>[+\-!](?=\S))|(?P<word>[^\s()"]+))')


def parse(query: str) -> Group:
    """Bare terms are alternatives; ``+t -t``, ``AND OR NOT && || !``, phrases, wildcards (leading ones too), parentheses."""
    tokens = [(m.lastgroup, m.group(m.lastgroup)) for m in _LEX.finditer(query) if m.lastgroup]
    group, rest = _group(tokens)
    while rest:  # stray closing parentheses
        more, rest = _group(rest[1:])
        group.parts.extend(more.parts)
    return group


def _group(tokens: list[tuple[str, str]]) -> tuple[Group, list[tuple[str, str]]]:
    parts: list[tuple[str, Term | Phrase | Wildcard | Group]] = []
    sign, joined = SHOULD, ""
    while tokens:
        kind, value = tokens[0]
        if kind == "close":
            break
        tokens = tokens[1:]
        if kind == "sign":
            sign = NOT if value in "-!" else MUST
            continue
        if kind == "word" and value in ("AND", "&&", "OR", "||"):
            joined = MUST if value in ("AND", "&&") else SHOULD
            if joined == MUST and parts and parts[-1][0] == SHOULD:
                parts[-1] = MUST, parts[-1][1]
            continue
        if kind == "word" and value == "NOT":
            sign = NOT
            continue
        if kind == "open":
            part, tokens = _group(tokens)
            tokens = tokens[1:]
        elif kind == "quote":
            part = Phrase(value.strip('"'))
        else:
            part = Wildcard(value) if re.search(r"[*?]", value) else Term(value)
        parts.append((MUST if joined == MUST and sign == SHOULD else sign, part))
        sign, joined = SHOULD, ""
    return Group(parts), tokens


# matching ---------------------------------------------------------------------------------------------------------------


def _terms_match(tokens: DataFrame, terms: list[str]) -> DataFrame | None:
    if not terms:
        return None
    # terms one after another (a phrase, or a word that the analyzer splits): one hit a term and start, all starts present
    hits = tokens.where(F.col("term").isin(terms))
    if len(terms) == 1:
        return hits.select("nid").distinct()
    places = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms))), lambda p: p["t"] == F.col("term"))
    starts = hits.select("nid", "version", "pos", F.explode(places).alias("p")).select("nid", "version", (F.col("pos") - F.col("p.i")).alias("start"), "p.i")
    return starts.groupBy("nid", "version", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(terms)).select("nid").distinct()


def _matches(part: Term | Phrase | Wildcard | Group, tokens: DataFrame, analyzer: str) -> DataFrame | None:
    """Ids that the part matches; None if the analyzer leaves nothing of it."""
    if isinstance(part, Wildcard):
        return tokens.where(F.col("term").like(part.like())).select("nid").distinct()
    if isinstance(part, (Term, Phrase)):
        return _terms_match(tokens, analyze(part.text, analyzer))
    found = [(occurs, m) for occurs, p in part.parts if (m := _matches(p, tokens, analyzer)) is not None]
    must, should, never = ([m for occurs, m in found if occurs == o] for o in (MUST, SHOULD, NOT))
    if must:
        out = reduce(lambda a, b: a.join(b, "nid", "left_semi"), must)
    elif should:
        out = reduce(DataFrame.union, should).distinct()
    else:
        return None
    return reduce(lambda a, b: a.join(b, "nid", "left_anti"), never, out)


def _scored_terms(part: Term | Phrase | Wildcard | Group, analyzer: str) -> list[str]:
    if isinstance(part, (Term, Phrase)):
        return analyze(part.text, analyzer)
    if isinstance(part, Wildcard):
        return []
    return [t for occurs, p in part.parts if occurs != NOT for t in _scored_terms(p, analyzer)]


def match(rows: DataFrame, query: str, prefix: bool = False) -> DataFrame:
    """Ids of the rows (nid, text) that the query matches under either analyzer."""
    found = []
    for analyzer in (STANDARD, WHITESPACE):
        tokens = token_table(rows, analyzer)
        found.append(_prefix_matches(tokens, query, analyzer) if prefix else _matches(parse(query), tokens, analyzer))
    found = [f for f in found if f is not None]
    return reduce(DataFrame.union, found).distinct() if found else rows.select("nid").limit(0)


def _prefix_matches(tokens: DataFrame, query: str, analyzer: str) -> DataFrame | None:
    """Every token is required; the last is a prefix, unless white space ends the query."""
    terms = analyze(query, analyzer)
    if not terms:
        return None
    whole, last = (terms, None) if query[-1].isspace() else (terms[:-1], terms[-1])
    wanted = [F.col("term") == t for t in dict.fromkeys(whole)] + ([F.col("term").startswith(last)] if last else [])
    # one pass: which of the conditions each id meets
    met = tokens.where(reduce(lambda a, b: a | b, wanted)).groupBy("nid").agg(*(F.max(w.cast("int")).alias(f"w{i}") for i, w in enumerate(wanted)))
    return met.where(reduce(lambda a, b: a & b, (F.col(f"w{i}") == 1 for i in range(len(wanted))))).select("nid")


def scores(rows: DataFrame, query: str) -> DataFrame:
    """(nid, score): sum over the query's terms that a text has of idf^2 / sqrt(length); idf = 1 + ln(N / (df + 1)). How often a term occurs
    in a text doesn't count. Texts that only wildcards match score 0."""
    terms = list(dict.fromkeys(_scored_terms(parse(query), STANDARD)))
    hits = token_table(rows).where(F.col("term").isin(terms)).select("nid", "term", "len").distinct()
    total = rows.agg(F.count_distinct("nid")).first()[0]
    weight = (1 + F.log(F.lit(float(total)) / (F.col("df") + 1))) ** 2
    idf = hits.groupBy("term").agg(F.count_distinct("nid").alias("df")).select("term", weight.alias("w"))  # a row for each of the query's terms
    per_text = hits.join(F.broadcast(idf), "term").groupBy("nid", "len").agg((F.sum("w") / F.sqrt(F.col("len"))).alias("s"))
    return per_text.groupBy("nid").agg(F.max("s").alias("score"))


def search(rows: DataFrame, query: str, limit: int | None = None, prefix: bool = False) -> DataFrame:
    """(nid, score) of the matches, best first (ties by id). An id with several texts counts once, before the limit."""
    found = match(rows, query, prefix)
    ranked = found.join(scores(rows, query), "nid", "left").select("nid", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    return ranked.orderBy(F.desc("score"), "nid").limit(limit) if limit is not None else ranked

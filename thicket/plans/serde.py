"""Queries as dictionaries, JSON and XML, and back; what comes back can be run."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from typing import Any

from thicket.operators.clauses import Clause, Parent
from thicket.plans.model import Coordinate, ForType, ReturnType
from thicket.plans.query import ForSet, Query


def _value(v: Any) -> Any:
    return {"coordinate": v.to_dict()} if isinstance(v, Coordinate) else v


def _back(v: Any) -> Any:
    return Coordinate.from_dict(v["coordinate"]) if isinstance(v, dict) and "coordinate" in v else v


def clause_to_dict(c: Clause) -> dict:
    out: dict[str, Any] = {"clause": type(c).__name__}
    if isinstance(c, Parent):
        return out | {"children": [clause_to_dict(x) for x in c.children]}
    return out | {"with": {k: _value(v) for k, v in c.parameters().items()}}


def clause_from_dict(d: dict) -> Clause:
    try:
        kind = Clause.registry[d["clause"]]
    except KeyError:
        raise ValueError(f"no such clause: {d.get('clause')}") from None
    if issubclass(kind, Parent):
        return kind(*map(clause_from_dict, d.get("children", [])))
    return kind(**{k: _back(v) for k, v in d.get("with", {}).items()})


def to_dict(q: Query) -> dict:
    if not isinstance(q.where, Clause):
        raise ValueError("a query with a callable for WHERE has no serialized form")
    return {
        "for": [t.value for t in q.for_.types],
        "custom": q.for_.custom,
        "let": {k: _value(v) for k, v in q.let.items()},
        "where": clause_to_dict(q.where),
        "return": q.returns.value,
        "view": q.view.to_dict(),
    }


def from_dict(d: dict) -> Query:
    return Query(
        clause_from_dict(d["where"]),
        ForSet([ForType(t) for t in d["for"]], list(d.get("custom", []))),
        {k: _back(v) for k, v in d.get("let", {}).items()},
        ReturnType(d.get("return", "NIDS")),
        Coordinate.from_dict(d["view"]) if d.get("view") else Coordinate(),
    )


def to_json(q: Query) -> str:
    return json.dumps(to_dict(q), sort_keys=True)


def from_json(text: str) -> Query:
    return from_dict(json.loads(text))


def to_xml(q: Query) -> str:
    """Elements for, custom, let, where, return and view; values are JSON, so their types stay."""
    d, root = to_dict(q), ET.Element("query")
    for t in d["for"]:
        ET.SubElement(root, "for").text = t
    for u in d["custom"]:
        ET.SubElement(root, "custom").text = u
    for k, v in d["let"].items():
        ET.SubElement(root, "let", key=k).text = json.dumps(v, sort_keys=True)

    def put(up: ET.Element, c: dict) -> None:
        e = ET.SubElement(up, "clause", name=c["clause"])
        for k, v in c.get("with", {}).items():
            ET.SubElement(e, "with", key=k).text = json.dumps(v, sort_keys=True)
        for x in c.get("children", []):
            put(e, x)

    put(ET.SubElement(root, "where"), d["where"])
    ET.SubElement(root, "return").text = d["return"]
    ET.SubElement(root, "view").text = json.dumps(d["view"], sort_keys=True)
    return ET.tostring(root, encoding="unicode")


def from_xml(text: str) -> Query:
    root = ET.fromstring(text)

    def take(e: ET.Element) -> dict:
        return {"clause": e.get("name"), "with": {w.get("key"): json.loads(w.text) for w in e.findall("with")}, "children": [take(x) for x in e.findall("clause")]}

    return from_dict(
        {
            "for": [e.text for e in root.findall("for")],
            "custom": [e.text for e in root.findall("custom")],
            "let": {e.get("key"): json.loads(e.text) for e in root.findall("let")},
            "where": take(root.find("where/clause")),
            "return": root.findtext("return"),
            "view": json.loads(root.findtext("view")),
        }
    )

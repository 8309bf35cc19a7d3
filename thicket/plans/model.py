"""Coordinates (the view that a query is evaluated under), enumerations and table schemas."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from datetime import datetime
from enum import Enum


class State(str, Enum):
    ACTIVE = "ACTIVE"
    INACTIVE = "INACTIVE"


class Premise(str, Enum):
    STATED = "STATED"
    INFERRED = "INFERRED"


class ForType(str, Enum):
    """Universes that a query can start from."""

    ALL_COMPONENTS = "ALL_COMPONENTS"
    ALL_CONCEPTS = "ALL_CONCEPTS"
    ALL_DESCRIPTIONS = "ALL_DESCRIPTIONS"
    ALL_RELATIONSHIPS = "ALL_RELATIONSHIPS"
    ALL_SEMEMES = "ALL_SEMEMES"
    CUSTOM_SET = "CUSTOM_SET"


class ReturnType(str, Enum):
    NIDS = "NIDS"
    UUIDS = "UUIDS"
    COMPONENT = "COMPONENT"
    CONCEPT_VERSION = "CONCEPT_VERSION"
    DESCRIPTION_VERSION_FSN = "DESCRIPTION_VERSION_FSN"
    DESCRIPTION_VERSION_PREFERRED = "DESCRIPTION_VERSION_PREFERRED"
    DESCRIPTION_FOR_COMPONENT = "DESCRIPTION_FOR_COMPONENT"


class DescriptionType(Enum):
    # The types' numbers.
    FSN = 0
    SYNONYM = 1
    DEFINITION = 2

    @classmethod
    def from_ordinal(cls, n: int) -> DescriptionType:
        """The type of that number; ValueError if there is none."""
        return cls(n)


@dataclass(frozen=True)
class Coordinate:
    """as_of: versions later than this are not seen (None: all are). States are looked at only after the latest version is found, so
    an inactive latest version hides older active ones. languages: most preferred first."""

    as_of: datetime | None = None
    states: tuple[State, ...] = (State.ACTIVE,)
    languages: tuple[str, ...] = ("en", "es", "fr", "de")
    premise: Premise | None = None

    def at(self, *when: int) -> Coordinate:
        """The same view at another time: ``at(2002, 1, 31)``."""
        return replace(self, as_of=datetime(*when))

    def with_states(self, *states: State) -> Coordinate:
        return replace(self, states=states)

    def to_dict(self) -> dict:
        out = asdict(self)
        return out | {"as_of": self.as_of and self.as_of.isoformat(), "states": [s.value for s in self.states], "languages": list(self.languages), "premise": self.premise and self.premise.value}

    @classmethod
    def from_dict(cls, d: dict) -> Coordinate:
        return cls(
            datetime.fromisoformat(d["as_of"]) if d.get("as_of") else None,
            tuple(State(s) for s in d.get("states", ["ACTIVE"])),
            tuple(d.get("languages", cls.languages)),
            Premise(d["premise"]) if d.get("premise") else None,
        )


LATEST = Coordinate()
#: The LET key that every query has: its own view.
CURRENT_VIEW = "view of the query"

SCHEMAS = {
    "concept": "nid long, uuid string, time timestamp_ntz, state string",
    "description": "nid long, concept_nid long, dtype string, lang string, text string, ext_type string, time timestamp_ntz, state string",
    "relationship": "nid long, source long, rtype long, destination long, premise string, time timestamp_ntz, state string",
    "sememe": "nid long, assemblage long, referenced long, kind string, string1 string, long1 long, time timestamp_ntz, state string",
    "dynamic": "sememe_nid long, assemblage long, col int, pos int, dtype string, v_str string, v_bool boolean, v_int int, v_long long, v_float float, v_double double, time timestamp_ntz, state string",
}
#: What identifies a component among its versions.
KEYS = {"concept": ["nid"], "description": ["nid"], "relationship": ["source", "rtype", "destination", "premise"], "sememe": ["nid"], "dynamic": ["sememe_nid", "col", "pos"]}

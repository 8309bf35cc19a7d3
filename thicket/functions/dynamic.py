"""Search over typed attribute columns (the ``dynamic`` table), and which of them are indexed.

Numbers compare within their family after widening: int with long, float with double. Whole and fractional columns don't meet,
unless a range has bounds of both kinds. A null bound is open.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from thicket.functions import text as text_index

#: Types that cannot be indexed.
NOT_INDEXABLE = frozenset({"BYTEARRAY", "POLYMORPHIC"})

_WHOLE = ("v_int", "v_long")
_FRACTION = ("v_float", "v_double")


def is_indexable(dtype: str) -> bool:
    return dtype.upper() not in NOT_INDEXABLE


def _scope(dynamic: DataFrame, assemblage: int | None, columns: list[int] | None) -> DataFrame:
    if assemblage is not None:
        dynamic = dynamic.where(F.col("assemblage") == assemblage)
    return dynamic.where(F.col("col").isin(columns)) if columns is not None else dynamic


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("sememe_nid").alias("nid")).distinct()


def equals(dynamic: DataFrame, value: bool | int | float | uuid.UUID, assemblage: int | None = None, columns: list[int] | None = None) -> DataFrame:
    """Rows with that value. A negative whole number is also looked for among component ids."""
    rows = _scope(dynamic, assemblage, columns)
    if isinstance(value, bool):
        return _ids(rows.where(F.col("v_bool") == value))
    if isinstance(value, uuid.UUID):
        return _ids(rows.where((F.col("dtype") == "UUID") & F.col("v_str").isin(value.hex, str(value))))
    if isinstance(value, int):
        own = ~F.col("dtype").isin("NID") & _any(_WHOLE, lambda c: c == value)
        return _ids(rows.where(own | (F.col("dtype").isin("NID") & (F.col("v_long") == value)) if value < 0 else own))
    if isinstance(value, float):
        return _ids(rows.where(_any(_FRACTION, lambda c: c == value)))
    raise ValueError(f"no search for values of {type(value).__name__}")


def nid_equals(dynamic: DataFrame, nid: int, assemblage: int | None = None, columns: list[int] | None = None) -> DataFrame:
    return _ids(_scope(dynamic, assemblage, columns).where((F.col("dtype") == "NID") & (F.col("v_long") == nid)))


def _any(columns: tuple[str, ...], test) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(test(F.col(c).cast("double") if c in _FRACTION else F.col(c).cast("long")), F.lit(False)) for c in columns))


def between(dynamic: DataFrame, low: float | None, high: float | None, low_open: bool = False, high_open: bool = False, assemblage: int | None = None, columns: list[int] | None = None) -> DataFrame:
    """Rows with a number in the range; ValueError for bounds that are no numbers, or without bounds."""
    bounds = [b for b in (low, high) if b is not None]
    if not bounds or any(isinstance(b, bool) or not isinstance(b, (int, float)) for b in bounds):
        raise ValueError("a range needs numbers for bounds")
    families = (_WHOLE if any(isinstance(b, int) for b in bounds) else ()) + (_FRACTION if any(isinstance(b, float) for b in bounds) else ())

    def test(c: Column) -> Column:
        out = F.lit(True) & c.isNotNull()
        if low is not None:
            out = out & (c > low if low_open else c >= low)
        if high is not None:
            out = out & (c < high if high_open else c <= high)
        return out

    return _ids(_scope(dynamic, assemblage, columns).where((F.col("dtype") != "NID") & _any(families, test)))


def string_search(dynamic: DataFrame, query: str, prefix: bool = False, assemblage: int | None = None, columns: list[int] | None = None) -> DataFrame:
    """Rows whose string matches a query string. A leading ``-`` of a word is part of it, so that ids can be searched."""
    rows = _scope(dynamic, assemblage, columns).where(F.col("dtype") == "STRING").select(F.col("sememe_nid").alias("nid"), F.col("v_str").alias("text"))
    return text_index.match(rows, " ".join(f'"{w}"' if w.startswith("-") else w for w in query.split(" ")), prefix)


# which columns are indexed ----------------------------------------------------------------------------------------------

CONFIG = "assemblage long, cols array<int>, time timestamp_ntz, state string"


def active_config(config: DataFrame) -> DataFrame:
    """(assemblage, cols) of the latest configurations that are active."""
    last = config.groupBy("assemblage").agg(F.max(F.struct("time", "state", "cols")).alias("v"))
    return last.where(F.col("v.state") == "ACTIVE").select("assemblage", "v.cols")


def is_indexed(config: DataFrame, assemblage: int) -> bool:
    return not active_config(config).where(F.col("assemblage") == assemblage).isEmpty()


def configure(config: DataFrame, assemblage: int, cols: list[int] | None, time: str) -> DataFrame:
    """The configurations with one more version, that indexes these columns."""
    if cols is None:
        raise ValueError("columns to index are needed")
    return config.unionByName(config.sparkSession.createDataFrame([(assemblage, cols)], "assemblage long, cols array<int>").select("*", F.lit(time).cast("timestamp_ntz").alias("time"), F.lit("ACTIVE").alias("state")))


def disable(config: DataFrame, assemblage: int, time: str) -> DataFrame:
    """The configurations with the assemblage's index off; unchanged if it has none."""
    last = active_config(config).where(F.col("assemblage") == assemblage)
    return config.unionByName(last.select("assemblage", "cols", F.lit(time).cast("timestamp_ntz").alias("time"), F.lit("INACTIVE").alias("state")))


def indexed(dynamic: DataFrame, config: DataFrame) -> DataFrame:
    """The attribute rows that the active configurations index."""
    wanted = active_config(config).select("assemblage", F.explode("cols").alias("col"))
    return dynamic.where(~F.col("dtype").isin(sorted(NOT_INDEXABLE))).join(wanted, ["assemblage", "col"], "left_semi")

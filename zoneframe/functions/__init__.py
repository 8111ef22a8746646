"""Column functions: ASCII case folding, unit values, text rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Kind

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_FOLD = str.maketrans(_UPPER, _LOWER)


def fold(text: Column) -> Column:
    """A-Z in lower case; other letters stay, unlike with lower()."""
    return F.translate(text, _UPPER, _LOWER)


def folded(text: str) -> str:
    return text.translate(_FOLD)


def literal(value, kind: Kind) -> Column:
    """A value as a column of exactly its type; only these two need a cast, and each call into the JVM takes time."""
    return F.lit(value).cast(kind.spark.simpleString()) if kind in (Kind.I64, Kind.FLT) else F.lit(value)


def unit_view(column: Column, kind: Kind) -> Column:
    """The column with NULL shown as its type's unit value."""
    return F.coalesce(column, literal(kind.unit, kind))


def string_bytes(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def rendered(column: Column, kind: Kind) -> Column:
    """As text: booleans 0 or 1, floats with six decimals, NULL as (null)."""
    if kind is Kind.BIT:
        text = F.when(column, "1").otherwise("0")
    elif kind in (Kind.FLT, Kind.DBL):
        text = F.format_string("%f", column.cast("double"))
    else:
        text = column.cast("string")
    return F.when(column.isNull(), "(null)").otherwise(text)

"""Predicates as Catalyst expressions that are two-valued and still reach the Parquet scan.

NOT is pushed to the leaves. A NULL compares as its type's unit value; rather
than coalesce the column, which no scan can use, a leaf that the unit value
satisfies gets ``OR column IS NULL``. NaN satisfies no comparison.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fold, folded, literal, unit_view
from ..types import Kind, StoreSchema
from .predicate import Always, At, Compare, Custom, Group, IsNull, Predicate, cheapest_first, validate


def compile_predicate(p: Predicate, schema: StoreSchema, col: Callable[[str], Column] = F.col, nulls: str = "unit") -> Column:
    """A filter condition, validated and with cheap operands first.

    ``nulls``: "unit" compares NULL as the unit value; "sql" lets no comparison
    match a NULL, whether negated or not.
    """
    if nulls not in ("unit", "sql"):
        raise ValueError(f"nulls is 'unit' or 'sql', not {nulls!r}")
    return _node(cheapest_first(validate(p, schema)), False, schema, col, nulls)


def projected(p: Predicate, schema: StoreSchema, col: Callable[[str], Column] = F.col, nulls: str = "unit") -> Column:
    """The predicate as a column that is never NULL."""
    return F.coalesce(compile_predicate(p, schema, col, nulls), F.lit(False))


def matching(df: DataFrame, p: Predicate, nulls: str = "unit") -> DataFrame:
    return df.where(compile_predicate(p, StoreSchema.of(df.schema), lambda n: F.col(f"`{n}`"), nulls))


def _node(p: Predicate, flip: bool, schema: StoreSchema, col: Callable[[str], Column], nulls: str) -> Column:
    no = p.negated != flip
    if isinstance(p, Always):
        return F.lit(not no)
    if isinstance(p, Group):
        parts = [_node(x, no, schema, col, nulls) for x in p.operands]
        return reduce((lambda a, b: a & b) if (p.op == "and") != no else (lambda a, b: a | b), parts)
    held = schema[p.column]
    c = col(held.name)
    if isinstance(p, IsNull):
        return c.isNotNull() if no else c.isNull()
    if isinstance(p, Custom):
        return _custom(p, c, no, nulls)
    if isinstance(p.value, float) and math.isnan(p.value):
        return F.lit(no) if nulls == "unit" else (c.isNotNull() if no else F.lit(False))
    test, floating = _test(p, c), p.kind in (Kind.FLT, Kind.DBL)
    if floating and p.op == "gt":
        test = (~test | F.isnan(c)) if no else (test & ~F.isnan(c))
    elif no:
        test = ~test
    if nulls == "unit" and satisfied(p, p.kind.unit) != no:
        return test | c.isNull()
    return test


def _test(p: Compare, c: Column) -> Column:
    value = p.value
    if p.kind is Kind.STR and not p.case_sensitive:
        c, value = fold(c), folded(value)
    if p.op == "has":
        return {At.START: c.startswith, At.END: c.endswith, At.ANY: c.contains}[p.at](value)
    v = literal(value, p.kind)
    if p.op == "eq":
        return c == v
    return c < v if p.op == "lt" else c > v


def _custom(p: Custom, c: Column, no: bool, nulls: str) -> Column:
    if p.rows is None:
        found = F.lit(False)
    else:
        given = unit_view(c, p.kind)
        found = F.coalesce(_arrow(p.rows)(given) if p.arrow else p.rows(given), F.lit(False))
    found = ~found if no else found
    return found & c.isNotNull() if nulls == "sql" else found


def _arrow(rows: Callable[[pa.Array], pa.Array]):
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield rows(batch)

    each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, "boolean")


def satisfied(p: Compare, value) -> bool:
    """Whether one plain value satisfies the leaf, its negation aside."""
    want = p.value
    if p.kind is Kind.STR:
        if not p.case_sensitive:
            value, want = folded(value), folded(want)
        value, want = value.encode(), want.encode()
    if p.op == "eq":
        return value == want
    if p.op == "lt":
        return value < want
    if p.op == "gt":
        return value > want
    return {At.START: value.startswith, At.END: value.endswith, At.ANY: lambda w: w in value}[p.at](want)


def evaluate(p: Predicate, schema: StoreSchema, row: tuple) -> bool:
    """The same semantics in plain Python for one row (no custom leaves); the model that tests compare with."""
    if isinstance(p, Always):
        found = True
    elif isinstance(p, Group):
        found = (all if p.op == "and" else any)([evaluate(x, schema, row) for x in p.operands])
    elif isinstance(p, IsNull):
        found = row[schema.place(p.column)] is None
    elif isinstance(p, Compare):
        value = row[schema.place(p.column)]
        found = satisfied(p, p.kind.unit if value is None else value)
    else:
        raise TypeError(f"no plain model of {p!r}")
    return found != p.negated

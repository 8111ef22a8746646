"""The predicate language: leaves over one column, AND, OR, NOT, and custom tests.

Trees are immutable. A column is a place or a name. Every leaf has a type, which
must be the column's own: nothing is cast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from ..types import Kind, StoreSchema, checked


class PredicateError(ValueError):
    """A predicate that does not fit the schema it is asked of."""


class At(Enum):
    """Where a needle has to be."""

    START = "start"
    END = "end"
    ANY = "any"


class Predicate:
    negated: bool = False

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return replace(self, negated=not self.negated)  # type: ignore[type-var]


@dataclass(frozen=True)
class Always(Predicate):
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Predicate):
    column: int | str
    negated: bool = False


@dataclass(frozen=True)
class Compare(Predicate):
    """op: eq, lt, gt or has (a needle)."""

    op: str
    column: int | str
    kind: Kind
    value: Any
    case_sensitive: bool = True
    at: At | None = None
    negated: bool = False


@dataclass(frozen=True)
class Group(Predicate):
    op: str
    operands: tuple[Predicate, ...]
    negated: bool = False


@dataclass(frozen=True)
class Custom(Predicate):
    """A test of the caller's own.

    ``rows`` maps the column (NULL replaced by its type's unit value) to a
    boolean column; with ``arrow`` it maps an Arrow array to a boolean array
    instead. Without ``rows`` nothing matches. ``zone`` maps the least and
    greatest value of a zone (of strings: byte length) to -1, 0 or 1.
    """

    column: int | str
    kind: Kind
    rows: Callable | None = None
    zone: Callable | None = None
    cost: int = -1
    arrow: bool = False
    negated: bool = False


def true() -> Predicate:
    return Always()


def is_null(column: int | str) -> Predicate:
    return IsNull(column)


def _compare(op: str, kind: Kind):
    def leaf(column: int | str, value: Any) -> Predicate:
        return Compare(op, column, kind, checked(kind, value))

    leaf.__name__ = f"{kind.name.lower()}_{op}"
    return leaf


bit_eq = _compare("eq", Kind.BIT)
i32_eq, i32_lt, i32_gt = (_compare(op, Kind.I32) for op in ("eq", "lt", "gt"))
i64_eq, i64_lt, i64_gt = (_compare(op, Kind.I64) for op in ("eq", "lt", "gt"))
flt_eq, flt_lt, flt_gt = (_compare(op, Kind.FLT) for op in ("eq", "lt", "gt"))
dbl_eq, dbl_lt, dbl_gt = (_compare(op, Kind.DBL) for op in ("eq", "lt", "gt"))


def str_eq(column: int | str, value: str, case_sensitive: bool = True) -> Predicate:
    return Compare("eq", column, Kind.STR, checked(Kind.STR, value), case_sensitive)


def str_lt(column: int | str, value: str, case_sensitive: bool = True) -> Predicate:
    return Compare("lt", column, Kind.STR, checked(Kind.STR, value), case_sensitive)


def str_gt(column: int | str, value: str, case_sensitive: bool = True) -> Predicate:
    return Compare("gt", column, Kind.STR, checked(Kind.STR, value), case_sensitive)


def str_has(column: int | str, needle: str, case_sensitive: bool = True, at: At = At.ANY) -> Predicate:
    return Compare("has", column, Kind.STR, checked(Kind.STR, needle), case_sensitive, at)


def custom(column: int | str, kind: Kind, rows: Callable | None = None, zone: Callable | None = None, cost: int = -1, arrow: bool = False) -> Predicate:
    return Custom(column, kind, rows, zone, cost, arrow)


def _group(op: str, given: tuple) -> Predicate:
    operands = tuple(given[0]) if len(given) == 1 and not isinstance(given[0], Predicate) and isinstance(given[0], Iterable) else given
    if not operands or not all(isinstance(x, Predicate) for x in operands):
        raise ValueError(f"{op} takes one predicate or more, got {operands!r}")
    return Group(op, operands)


def all_of(*operands: Predicate | Iterable[Predicate]) -> Predicate:
    return _group("and", operands)


def any_of(*operands: Predicate | Iterable[Predicate]) -> Predicate:
    return _group("or", operands)


def at_most(make_gt: Callable[..., Predicate], column: int | str, value: Any) -> Predicate:
    """<= as NOT >, which is true of NaN."""
    return ~make_gt(column, value)


def at_least(make_lt: Callable[..., Predicate], column: int | str, value: Any) -> Predicate:
    """>= as NOT <, which is true of NaN."""
    return ~make_lt(column, value)


def validate(p: Predicate, schema: StoreSchema) -> Predicate:
    """The predicate itself; PredicateError if a leaf doesn't fit the schema."""
    if isinstance(p, Group):
        for x in p.operands:
            validate(x, schema)
    elif not isinstance(p, Always):
        try:
            held = schema[p.column]
        except (IndexError, KeyError, TypeError) as e:
            raise PredicateError(str(e)) from e
        if not isinstance(p, IsNull) and held.kind is not p.kind:
            raise PredicateError(f"column {p.column!r} is {held.kind.name}; the predicate takes {p.kind.name}")
        if isinstance(p, Compare):
            if p.kind is Kind.BIT and p.op != "eq":
                raise PredicateError("booleans have no order")
            if p.op == "has" and p.kind is not Kind.STR:
                raise PredicateError("only strings can hold a needle")
    return p


def has_custom(p: Predicate) -> bool:
    return isinstance(p, Custom) or (isinstance(p, Group) and any(map(has_custom, p.operands)))


_COST = {Kind.BIT: 1, Kind.I32: 8, Kind.FLT: 8, Kind.I64: 16, Kind.DBL: 16, Kind.STR: 128}


def cost(p: Predicate) -> int:
    if isinstance(p, Always):
        return 0
    if isinstance(p, IsNull):
        return 1
    if isinstance(p, Group):
        return sum(map(cost, p.operands))
    if isinstance(p, Custom) and p.cost >= 0:
        return p.cost
    return _COST[p.kind]


def cheapest_first(p: Predicate) -> Predicate:
    """The same tree with each group's operands by cost; equal ones stay in order. Spark tests conjuncts as written."""
    if not isinstance(p, Group):
        return p
    return replace(p, operands=tuple(sorted(map(cheapest_first, p.operands), key=cost)))

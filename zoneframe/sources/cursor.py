"""A cursor over rows in file order, for callers that read one value at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row

from ..types import Kind, StoreSchema


class Cursor:
    """``next`` moves to the next row, getters read it: while there is one, they give values, and a NULL as its type's unit value.

    One partition at a time is on the driver. A failure while reading ends the
    rows; ``error`` keeps it until ``rewind``. A getter of another type than the
    column's is a TypeError, one without a row an IndexError.
    """

    def __init__(self, schema: StoreSchema, rows: Callable[[], Iterator[Row]]) -> None:
        self.schema, self._rows = schema, rows
        self.rewind()

    def rewind(self) -> Cursor:
        """Before the first row, without an error."""
        self._left: Iterator[Row] | None = None
        self._row: Row | None = None
        self.error: Exception | None = None
        return self

    def next(self) -> bool:
        """Whether there is a next row."""
        self._row = None
        if self.error is None:
            try:
                if self._left is None:
                    self._left = iter(self._rows())
                self._row = next(self._left, None)
            except Exception as e:  # whatever ends a job: the caller asks for it
                self.error = e
        return self._row is not None

    def _get(self, column: int | str, kind: Kind | None = None):
        place = self.schema.place(column)
        held = self.schema[place].kind
        if kind is not None and held is not kind:
            raise TypeError(f"column {column!r} is {held.name}, not {kind.name}")
        if self._row is None:
            raise IndexError("the cursor is at no row")
        return self._row[place]

    def _value(self, column: int | str, kind: Kind):
        found = self._get(column, kind)
        return kind.unit if found is None else found

    def get_null(self, column: int | str) -> bool:
        return self._get(column) is None

    def get_bit(self, column: int | str) -> bool:
        return self._value(column, Kind.BIT)

    def get_i32(self, column: int | str) -> int:
        return self._value(column, Kind.I32)

    def get_i64(self, column: int | str) -> int:
        return self._value(column, Kind.I64)

    def get_flt(self, column: int | str) -> float:
        return self._value(column, Kind.FLT)

    def get_dbl(self, column: int | str) -> float:
        return self._value(column, Kind.DBL)

    def get_str(self, column: int | str) -> str:
        return self._value(column, Kind.STR)

    def get_str_length(self, column: int | str) -> int:
        """In bytes."""
        return len(self.get_str_bytes(column))

    def get_str_bytes(self, column: int | str) -> bytes:
        return self._value(column, Kind.STR).encode()

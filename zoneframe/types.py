"""The six scalar types, codecs, and schemas of stored tables."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import types as T


class Kind(IntEnum):
    """Type codes as they are stored."""

    BIT = 0
    I32 = 1
    I64 = 2
    FLT = 3
    DBL = 4
    STR = 5

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def unit(self):
        """What a NULL of this type compares as."""
        return _UNIT[self]

    @staticmethod
    def of(data_type: T.DataType) -> Kind:
        for kind, spark in _SPARK.items():
            if isinstance(data_type, type(spark)):
                return kind
        raise TypeError(f"{data_type.simpleString()} is outside the six scalar types")


_SPARK = {
    Kind.BIT: T.BooleanType(),
    Kind.I32: T.IntegerType(),
    Kind.I64: T.LongType(),
    Kind.FLT: T.FloatType(),
    Kind.DBL: T.DoubleType(),
    Kind.STR: T.StringType(),
}
_UNIT = {Kind.BIT: False, Kind.I32: 0, Kind.I64: 0, Kind.FLT: 0.0, Kind.DBL: 0.0, Kind.STR: ""}
_RANGE = {Kind.I32: 1 << 31, Kind.I64: 1 << 63}


class Codec(IntEnum):
    NONE = 0
    LZ4 = 1
    LZ4HC = 2
    ZSTD = 3

    @property
    def spark(self) -> str:
        return ("none", "lz4_raw", "lz4_raw", "zstd")[self]


def checked(kind: Kind, value):
    """The value as the type holds it (32-bit floats rounded); TypeError or ValueError if it can't hold it."""
    if kind is Kind.BIT:
        if not isinstance(value, bool):
            raise TypeError(f"{value!r} is not a boolean")
        return value
    if kind in (Kind.I32, Kind.I64):
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError(f"{value!r} is not an integer")
        if not -_RANGE[kind] <= value < _RANGE[kind]:
            raise ValueError(f"{value} does not fit {kind.name}")
        return value
    if kind in (Kind.FLT, Kind.DBL):
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise TypeError(f"{value!r} is not a number")
        if kind is Kind.DBL:
            return float(value)
        try:
            return struct.unpack("f", struct.pack("f", value))[0]
        except OverflowError:
            return float("inf") if value > 0 else float("-inf")
    if not isinstance(value, str):
        raise TypeError(f"{value!r} is not a string")
    if "\0" in value:
        raise ValueError("strings cannot hold NUL")
    return value


@dataclass(frozen=True)
class StoreColumn:
    """A column and how its owner asked to have it stored."""

    name: str
    kind: Kind
    encoding: int = 0
    codec: Codec = Codec.NONE
    level: int = 1

    def field(self) -> T.StructField:
        held = {"zf.encoding": self.encoding, "zf.codec": int(self.codec), "zf.level": self.level}
        return T.StructField(self.name, self.kind.spark, True, held)

    @staticmethod
    def of(field: T.StructField) -> StoreColumn:
        m = field.metadata or {}
        return StoreColumn(field.name, Kind.of(field.dataType), m.get("zf.encoding", 0), Codec(m.get("zf.codec", 0)), m.get("zf.level", 1))


@dataclass(frozen=True)
class StoreSchema:
    """Ordered columns, addressed by place or by name, and one optional string about the file."""

    columns: tuple[StoreColumn, ...]
    metadata: str | None = None

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError(f"column names repeat: {names}")

    @staticmethod
    def of(schema: T.StructType) -> StoreSchema:
        about = next((f.metadata["zf.metadata"] for f in schema.fields if f.metadata and "zf.metadata" in f.metadata), None)
        return StoreSchema(tuple(map(StoreColumn.of, schema.fields)), about)

    @staticmethod
    def build(columns: Iterable[StoreColumn], metadata: str | None = None) -> StoreSchema:
        return StoreSchema(tuple(columns), metadata)

    def struct(self) -> T.StructType:
        fields = [c.field() for c in self.columns]
        if fields and self.metadata is not None:
            fields[0].metadata = fields[0].metadata | {"zf.metadata": self.metadata}
        return T.StructType(fields)

    def place(self, column: int | str) -> int:
        """The ordinal of a column given by ordinal or name."""
        if isinstance(column, bool) or not isinstance(column, int | str):
            raise TypeError(f"{column!r} is neither a place nor a name")
        if isinstance(column, int):
            if not 0 <= column < len(self.columns):
                raise IndexError(f"no column {column}; there are {len(self.columns)}")
            return column
        for i, c in enumerate(self.columns):
            if c.name == column:
                return i
        raise KeyError(f"no column {column!r}")

    def __getitem__(self, column: int | str) -> StoreColumn:
        return self.columns[self.place(column)]

    def renamed(self, names: Iterable[str]) -> StoreSchema:
        return replace(self, columns=tuple(replace(c, name=n) for c, n in zip(self.columns, names, strict=True)))

"""Describe, concatenate, dump and preview stored tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rendered
from ..types import Codec, StoreSchema
from .reader import ROW_GROUP, Reader
from .writer import write_frame

#: Rows of a preview.
PREVIEW = 20


def analyze(reader: Reader) -> DataFrame:
    """(path, rows, columns, place, name, type, compression) for each column; compression is null where none was asked for."""
    rows = reader.row_count()
    held = [
        (reader.path, rows, reader.column_count, i, c.name, c.kind.name, None if c.codec is Codec.NONE else f"{c.codec.name} ({c.level})")
        for i, c in enumerate(reader.schema.columns)
    ]
    return reader.spark.createDataFrame(held, "path string, rows bigint, columns int, place int, name string, type string, compression string")


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by place; names and storage of the first. ValueError for unlike counts, TypeError for unlike types."""
    if not frames:
        raise ValueError("one table at least")
    first = StoreSchema.of(frames[0].schema)
    for f in frames[1:]:
        other = StoreSchema.of(f.schema)
        if len(other.columns) != len(first.columns):
            raise ValueError(f"{len(other.columns)} columns beside {len(first.columns)}")
        for a, b in zip(first.columns, other.columns):
            if a.kind is not b.kind:
                raise TypeError(f"{b.name} is {b.kind.name}; {a.name} is {a.kind.name}")
    names = [c.name for c in first.columns]
    return reduce(DataFrame.union, [f.toDF(*names) for f in frames])


def cat(spark: SparkSession, inputs: Sequence[str], output: str, row_group_size: int = ROW_GROUP) -> None:
    """The inputs one after the other as a new table; names and storage of the first, no file metadata."""
    readers = [Reader(spark, p) for p in inputs]
    if not readers:
        raise ValueError("one table at least")
    union = concatenated([r.frame for r in readers])
    write_frame(union, output, StoreSchema(readers[0].schema.columns), row_group_size)


def dump(reader: Reader, column: int | str) -> DataFrame:
    """(value): one column as text, in file order."""
    held = reader.schema[column]
    return reader.ordered().select(rendered(F.col(f"`{held.name}`"), held.kind).alias("value"))


def dumped(reader: Reader, column: int | str) -> Iterator[str]:
    """The same texts one by one, file after file, without a sort of the whole table."""
    held = reader.schema[column]
    for row in reader.rows(lambda df: df.select(rendered(F.col(f"`{held.name}`"), held.kind).alias("value"))):
        yield row["value"]


def rendered_rows(df: DataFrame) -> DataFrame:
    """Every column as text."""
    schema = StoreSchema.of(df.schema)
    return df.select(*(rendered(F.col(f"`{c.name}`"), c.kind).alias(c.name) for c in schema.columns))


def head(reader: Reader, n: int = PREVIEW) -> DataFrame:
    """The first rows in file order, as text; only n rows of each task are kept for the merge."""
    names = [f"`{c.name}`" for c in reader.schema.columns]
    first = reader.placed().orderBy("zf_file", "zf_row").limit(n)
    return rendered_rows(first.select(*names))


def head_text(reader: Reader, n: int = PREVIEW) -> str:
    """A header line and the first rows, separated by tabs."""
    lines = ["\t".join(c.name for c in reader.schema.columns)]
    return "\n".join(lines + ["\t".join(r) for r in head(reader, n).collect()])

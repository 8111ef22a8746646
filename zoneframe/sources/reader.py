"""Scans: typed, optionally filtered, in file order when rows are asked for one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import string_bytes, unit_view
from ..operators.counts import parallel_query
from ..operators.zones import ALL, NONE, zone_map, zone_match
from ..plans.compile import compile_predicate
from ..plans.predicate import Predicate, has_custom, validate
from ..types import Codec, Kind, StoreColumn, StoreSchema
from . import files
from .cursor import Cursor

#: Rows of a row group where a writer asks for nothing else; the folder, under a table's path, of its zone map.
ROW_GROUP, ZONES = 100_000, "_zones"

_FILE, _ROW = "zf_file", "zf_row"


class Reader:
    """A table of Parquet files under one path. Nothing is read before a result is asked for.

    The predicate is validated at once. Columns are addressed by place or name.
    A reader holds no position: iterating again starts anew.
    """

    def __init__(self, spark: SparkSession, path: str, predicate: Predicate | None = None, row_group_size: int = ROW_GROUP, nulls: str = "unit") -> None:
        if row_group_size < 1:
            raise ValueError("a row group has one row at least")
        self.spark, self.path, self.predicate, self.row_group_size, self.nulls = spark, path, predicate, row_group_size, nulls
        self._scan = spark.read.parquet(path)
        self.schema = StoreSchema.of(self._scan.schema)
        if predicate is not None:
            validate(predicate, self.schema)

    def _matching(self, df: DataFrame) -> DataFrame:
        if self.predicate is None:
            return df
        return df.where(compile_predicate(self.predicate, self.schema, lambda n: F.col(f"`{n}`"), self.nulls))

    @property
    def frame(self) -> DataFrame:
        """The matching rows, in no order."""
        return self._matching(self._scan)

    def select(self, *columns: int | str) -> DataFrame:
        """Some columns of the matching rows; only these and the predicate's are read."""
        return self.frame.select(*(self.get(c) for c in columns))

    def placed(self) -> DataFrame:
        """The matching rows with zf_file and zf_row, their place in the table."""
        scan = self._scan.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
        return self._matching(scan)

    def ordered(self) -> DataFrame:
        """The matching rows in file order (a range sort of the table: for previews; ``rows`` goes file by file)."""
        names = [f"`{c.name}`" for c in self.schema.columns]
        return self.placed().orderBy(_FILE, _ROW).select(*names)

    def rows(self, shown: Callable[[DataFrame], DataFrame] = lambda df: df) -> Iterator[Row]:
        """Row by row in file order: file after file, each sorted by its own rows alone, one partition at a time on the driver.

        ``shown``: what to select of the rows, without changing their order.
        """
        names = [f"`{c.name}`" for c in self.schema.columns]
        for name in sorted(self._scan.inputFiles()):
            scan = self.spark.read.schema(self._scan.schema).parquet(unquote(name))
            held = self._matching(scan.select("*", F.col("_metadata.row_index").alias(_ROW)))
            yield from shown(held.orderBy(_ROW).select(*names)).toLocalIterator()

    __iter__ = rows

    def cursor(self) -> Cursor:
        """A position among the matching rows, in file order, with typed getters."""
        return Cursor(self.schema, self.rows)

    def rewind(self) -> Reader:
        """For callers that expect one: a reader keeps no position, each iteration starts at the first row."""
        return self

    def row_count(self) -> int:
        """Unfiltered: from the files' footers, no column is read."""
        return self.frame.count()

    def parallel_query(self, visit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        return parallel_query(self.frame, visit, schema)

    # Getters: columns to select.

    def get(self, column: int | str, kind: Kind | None = None) -> Column:
        """A column; TypeError if ``kind`` is given and not the column's own."""
        held = self.schema[column]
        if kind is not None and held.kind is not kind:
            raise TypeError(f"column {column!r} is {held.kind.name}, not {kind.name}")
        return F.col(f"`{held.name}`")

    def get_null(self, column: int | str) -> Column:
        return self.get(column).isNull()

    def get_bit(self, column: int | str) -> Column:
        return self.get(column, Kind.BIT)

    def get_i32(self, column: int | str) -> Column:
        return self.get(column, Kind.I32)

    def get_i64(self, column: int | str) -> Column:
        return self.get(column, Kind.I64)

    def get_flt(self, column: int | str) -> Column:
        return self.get(column, Kind.FLT)

    def get_dbl(self, column: int | str) -> Column:
        return self.get(column, Kind.DBL)

    def get_str(self, column: int | str) -> Column:
        return self.get(column, Kind.STR)

    def get_str_length(self, column: int | str) -> Column:
        """In bytes."""
        return F.octet_length(self.get_str(column))

    def get_str_bytes(self, column: int | str) -> Column:
        return string_bytes(self.get_str(column))

    def get_unit(self, column: int | str) -> Column:
        """The value, or the type's unit value for NULL."""
        return unit_view(self.get(column), self.schema[column].kind)

    # Descriptions.

    @property
    def column_count(self) -> int:
        return len(self.schema.columns)

    @property
    def metadata(self) -> str | None:
        return self.schema.metadata

    def column(self, column: int | str) -> StoreColumn:
        return self.schema[column]

    def column_name(self, column: int | str) -> str:
        return self.schema[column].name

    def column_type(self, column: int | str) -> Kind:
        return self.schema[column].kind

    def column_encoding(self, column: int | str) -> int:
        return self.schema[column].encoding

    def column_compression(self, column: int | str) -> tuple[Codec, int]:
        """(codec, level) as asked for when the table was written."""
        held = self.schema[column]
        return held.codec, held.level

    # Row groups: ``row_group_size`` rows of a file each, as write_frame lays them out.

    def grouped(self) -> DataFrame:
        """The matching rows with zf_file and zf_group."""
        group = F.floor(F.col(_ROW) / self.row_group_size).cast("bigint").alias("zf_group")
        return self.placed().select(*(f"`{c.name}`" for c in self.schema.columns), _FILE, group)

    def row_group(self, k: int) -> DataFrame:
        """The matching rows of the k-th row group of each file."""
        names = [f"`{c.name}`" for c in self.schema.columns]
        low, high = k * self.row_group_size, (k + 1) * self.row_group_size
        return self.placed().where((F.col(_ROW) >= low) & (F.col(_ROW) < high)).select(*names)

    def row_group_counts(self) -> DataFrame:
        """(zf_file, zf_group, n): matching rows of each row group that has any."""
        return self.grouped().groupBy(_FILE, "zf_group").agg(F.count(F.lit(1)).alias("n"))

    # Zones: what is known of each row group without its rows.

    def _located(self, scan: DataFrame) -> DataFrame:
        group = F.floor(F.col("_metadata.row_index") / self.row_group_size).cast("bigint")
        return scan.select("*", F.struct(F.col("_metadata.file_name").alias("file"), group.alias("group")).alias("zf_zone"))

    def zone_map(self) -> DataFrame:
        """(file, group, n, and for each column <i>_nulls, <i>_min, <i>_max, <i>_nan) of all rows, from a scan."""
        found = zone_map(self._located(self._scan), F.col("zf_zone"), schema=self.schema)
        return found.select("zone.file", "zone.group", *(f"`{c}`" for c in found.columns if c != "zone"))

    def zones(self) -> DataFrame | None:
        """The stored zone map; None if the table has none."""
        path = files.inside(self.path, ZONES)
        return self.spark.read.parquet(path) if files.exists(self.spark, path) else None

    def pruned(self) -> DataFrame:
        """The matching rows, by the stored zone map: files without a zone that can match are not read.

        A plain predicate goes on to the scan of the other files, which skips
        row groups by their own statistics. With a custom test, rows of zones
        told to match nothing are left out, and those of zones told to match
        wholly pass untested. Without a stored map, an ordinary scan. Only the
        names of files reach the driver, which lists them anyway.
        """
        zones = self.zones()
        if self.predicate is None or zones is None:
            return self.frame
        told = zones.select("file", "group", zone_match(self.predicate, self.schema).alias("zf_match")).where(F.col("zf_match") != NONE)
        names = sorted(r["file"] for r in told.select("file").distinct().collect())
        if not names:
            return self._scan.where(F.lit(False))
        scan = self.spark.read.schema(self._scan.schema).parquet(*(files.inside(self.path, n) for n in names))
        if not has_custom(self.predicate):
            return self._matching(scan)
        zone = F.struct("file", "group")
        joined = self._located(scan).join(told.select(zone.alias("zf_told"), "zf_match"), F.col("zf_zone") == F.col("zf_told"))
        test = compile_predicate(self.predicate, self.schema, lambda n: F.col(f"`{n}`"), self.nulls)
        return joined.where((F.col("zf_match") == ALL) | F.coalesce(test, F.lit(False))).select(*(f"`{c.name}`" for c in self.schema.columns))


def open_table(spark: SparkSession, path: str, row_group_size: int = ROW_GROUP) -> Reader:
    return Reader(spark, path, None, row_group_size)


def open_matching(spark: SparkSession, path: str, predicate: Predicate, row_group_size: int = ROW_GROUP, nulls: str = "unit") -> Reader:
    return Reader(spark, path, predicate, row_group_size, nulls)

"""Writers: frames of any size, or rows put one by one."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Codec, Kind, StoreColumn, StoreSchema, checked
from . import files
from .reader import ROW_GROUP, ZONES, Reader

#: Bytes of full row groups that a Writer holds before it writes them as a file.
HELD = 1 << 26

_ARROW = {Kind.BIT: pa.bool_(), Kind.I32: pa.int32(), Kind.I64: pa.int64(), Kind.FLT: pa.float32(), Kind.DBL: pa.float64(), Kind.STR: pa.string()}


def file_codec(columns: Iterable[StoreColumn]) -> tuple[Codec, int]:
    """Parquet files written by Spark have one codec: the strongest that a column asks for, at the highest level asked for it."""
    held = list(columns)
    codec = max((c.codec for c in held), default=Codec.NONE)
    return codec, max((c.level for c in held if c.codec is codec), default=1)


def write_frame(df: DataFrame, path: str, schema: StoreSchema | None = None, row_group_size: int = ROW_GROUP, mode: str = "error", zones: bool = True) -> None:
    """The frame's rows as they are partitioned, in row groups of ``row_group_size`` rows.

    ``schema`` names, types and describes the columns by place; types must agree.
    With ``zones``, the zone map of every row group is stored beside the rows,
    which reads them once more; ``Reader.pruned`` uses it.
    """
    if row_group_size < 1:
        raise ValueError("a row group has one row at least")
    schema = schema or StoreSchema.of(df.schema)
    if not schema.columns:
        raise ValueError("a table has one column at least")
    kinds = [Kind.of(f.dataType) for f in df.schema.fields]
    if kinds != [c.kind for c in schema.columns]:
        raise TypeError(f"the frame has {[k.name for k in kinds]}, the schema {[c.kind.name for c in schema.columns]}")
    fields = schema.struct().fields
    by_place = df.toDF(*(f"c{i}" for i in range(len(fields))))
    named = by_place.select(*(F.col(f"c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(fields)))
    codec, level = file_codec(schema.columns)
    out = named.write.mode(mode).option("compression", codec.spark).option("parquet.block.row.count.limit", row_group_size)
    if codec is Codec.ZSTD:
        out = out.option("parquet.compression.codec.zstd.level", level)
    out.parquet(path)
    if zones:
        write_zones(df.sparkSession, path, row_group_size)


def write_zones(spark: SparkSession, path: str, row_group_size: int = ROW_GROUP) -> None:
    """Stores the zone map of a table's row groups under its path, in a folder that scans of the table don't see."""
    Reader(spark, path, None, row_group_size).zone_map().write.mode("overwrite").parquet(files.inside(path, ZONES))


class Writer:
    """Rows put one by one on the driver, written in order when the block ends without an error.

    Full row groups are written as soon as ``HELD`` bytes of them are there, as
    files beside the table; at the end these are moved into it, numbered in
    order, so the driver holds no more than that and one row group. A block that
    fails leaves nothing. For frames, use write_frame: it writes where the rows are.
    """

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[StoreColumn] = (), row_group_size: int = ROW_GROUP, sync: bool = True, zones: bool = True) -> None:
        if row_group_size < 1:
            raise ValueError("a row group has one row at least")
        self.spark, self.path, self.row_group_size, self.sync, self.zones = spark, path, row_group_size, sync, zones
        self.columns = list(columns)
        self.metadata: str | None = None
        self._held: list[list] = [[] for _ in self.columns]
        self._batches: list[pa.RecordBatch] = []
        self._staging, self._files, self._described = f"{path.rstrip('/')}-{uuid.uuid4().hex}", 0, None
        self._started = self._done = False

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.finish()
        else:
            self._done = True
            files.delete(self.spark, self._staging)

    def add_column(self, column: StoreColumn) -> None:
        if self._started or self._done:
            raise RuntimeError("columns are declared before the first value")
        self.columns.append(column)
        self._held.append([])

    def set_metadata(self, text: str) -> None:
        """The last one set is kept."""
        self.metadata = text

    def put(self, row: Sequence) -> None:
        """One value for each column, None for NULL; a row that doesn't fit changes nothing."""
        if self._done:
            raise RuntimeError("the table is finished")
        if len(row) != len(self.columns):
            raise ValueError(f"{len(row)} values for {len(self.columns)} columns")
        if not self.columns:
            raise ValueError("a table has one column at least")
        if len({len(h) for h in self._held}) > 1:
            raise ValueError("a row that was begun by single values is not complete")
        values = [None if v is None else checked(c.kind, v) for c, v in zip(self.columns, row)]
        for held, v in zip(self._held, values):
            held.append(v)
        self._started = True
        self._flush_full()

    def _put(self, column: int | str, kind: Kind | None, value) -> None:
        """One value of one column; a row is complete once each of its columns has one."""
        if self._done:
            raise RuntimeError("the table is finished")
        i = StoreSchema.build(self.columns).place(column)
        held = self.columns[i]
        if kind is not None and held.kind is not kind:
            raise TypeError(f"column {column!r} is {held.kind.name}, not {kind.name}")
        self._held[i].append(None if kind is None else checked(kind, value))
        self._started = True
        self._flush_full()

    def put_null(self, column: int | str) -> None:
        self._put(column, None, None)

    def put_bit(self, column: int | str, value: bool) -> None:
        self._put(column, Kind.BIT, value)

    def put_i32(self, column: int | str, value: int) -> None:
        self._put(column, Kind.I32, value)

    def put_i64(self, column: int | str, value: int) -> None:
        self._put(column, Kind.I64, value)

    def put_flt(self, column: int | str, value: float) -> None:
        self._put(column, Kind.FLT, value)

    def put_dbl(self, column: int | str, value: float) -> None:
        self._put(column, Kind.DBL, value)

    def put_str(self, column: int | str, value: str) -> None:
        self._put(column, Kind.STR, value)

    def _flush_full(self) -> None:
        if len(self._held[0]) >= self.row_group_size and len({len(h) for h in self._held}) == 1:
            self._flush()
            if sum(b.nbytes for b in self._batches) >= HELD:
                self._write()

    def _flush(self) -> None:
        sizes = [len(h) for h in self._held]
        if len(set(sizes)) > 1:
            raise ValueError(f"columns of unlike length: {sizes}")
        if self._held and self._held[0]:
            arrays = [pa.array(h, _ARROW[c.kind]) for h, c in zip(self._held, self.columns)]
            self._batches.append(pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))]))
            self._held = [[] for _ in self.columns]

    def _write(self) -> None:
        """The full row groups held, as one file of their own."""
        self._described = self._described if self._files else self.metadata
        self._store(f"{self._files:06d}", self._batches)
        self._files, self._batches = self._files + 1, []

    def _store(self, name: str, batches: list[pa.RecordBatch]) -> None:
        kinds = pa.schema([(f"c{i}", _ARROW[c.kind]) for i, c in enumerate(self.columns)])
        frame = self.spark.createDataFrame(pa.Table.from_batches(batches, kinds))
        write_frame(frame.coalesce(1), files.inside(self._staging, name), StoreSchema.build(self.columns, self.metadata), self.row_group_size, zones=False)

    def finish(self) -> None:
        """Writes the table; again: nothing."""
        if self._done:
            return
        if not self.columns:
            raise ValueError("a table has one column at least")
        StoreSchema.build(self.columns, self.metadata)
        self._flush()
        try:
            if self._batches or not self._files:
                self._write()
            folders = [files.inside(self._staging, f"{k:06d}") for k in range(self._files)]
            if self._described != self.metadata:  # a table is described by its first file
                self._store("first", [])
                folders.insert(0, files.inside(self._staging, "first"))
            files.gather(self.spark, folders, self.path)
        finally:
            files.delete(self.spark, self._staging)
        self._done = True
        if self.zones:
            write_zones(self.spark, self.path, self.row_group_size)

"""Helpers shared by the corpus operators: column picking, Arrow text UDFs, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<double>": pa.list_(pa.float64()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of each exact name, by position.

    Extra columns never interfere, even where they repeat a name or differ only
    in case, which a lookup by name would call ambiguous.
    """
    at = []
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r} among {df.columns}")
        at.append(df.columns.index(name))
    by_place = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return by_place.select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column], Callable[[DataFrame], DataFrame]]:
    """The frame with columns c0, c1, ...; a lookup by old name; and the way back to the old names."""
    names = df.columns

    def col(name: str) -> Column:
        if name not in names:
            raise ValueError(f"no column {name!r} among {names}")
        return F.col(f"c{names.index(name)}")

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)

    return df.toDF(*(f"c{i}" for i in range(len(names)))), col, back


def texts(values: pa.Array) -> Iterator[str | None]:
    """Python strings one by one; bytes that are not UTF-8 become U+FFFD."""
    for v in values:
        try:
            yield v.as_py()
        except UnicodeDecodeError:
            yield v.as_buffer().to_pybytes().decode("utf-8", "replace")


def struct_udf(fields: dict[str, str], rows: Callable[[Iterable[str | None]], Iterable[tuple]]):
    """An Arrow UDF over a text column that returns a struct; ``rows`` maps one batch of texts to tuples."""
    ddl = "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"
    kinds = [ARROW[v] for v in fields.values()]
    names = list(fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for row in rows(texts(batch)):
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _typed(run, ddl)


def _typed(run: Callable, ddl: str):
    def scalar_iter(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    scalar_iter.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scalar_iter, ddl)


def array_udf(ddl: str, run: Callable[[pa.Array], pa.Array]):
    """An Arrow UDF over one column; ``run`` maps one batch to one batch."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield run(batch)

    return _typed(each, ddl)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names.

    A temporary folder serves only in local mode where the session names none. Spark
    removes the files itself once nothing refers to them, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()

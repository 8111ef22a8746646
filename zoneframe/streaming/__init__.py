"""The same predicates over streams: a compiled predicate is a plain column expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import compile_predicate
from ..plans.predicate import Predicate
from ..types import StoreSchema


def open_stream(spark: SparkSession, path: str, schema: StoreSchema, predicate: Predicate | None = None, nulls: str = "unit") -> DataFrame:
    """Rows of files as they arrive under a path, filtered without state."""
    stream = spark.readStream.schema(schema.struct()).parquet(path)
    if predicate is None:
        return stream
    return stream.where(compile_predicate(predicate, schema, lambda n: F.col(f"`{n}`"), nulls))

"""Counts and per-partition queries of a scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def parallel_query(df: DataFrame, visit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``visit`` over the batches of each partition, all partitions at once; what it yields is the result.

    There is no state between partitions: combine what they yield with an aggregate.
    """
    return df.mapInArrow(visit, schema)


def parallel_count(df: DataFrame, name: str = "n") -> DataFrame:
    """A count of all partitions at once: Spark counts each and adds the counts up. ``parallel_query`` is for what only Python can express."""
    return row_count(df, name)

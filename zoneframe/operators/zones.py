"""Zone maps: per group of rows, what a predicate can be told from bounds alone.

A tri-state is -1 (no row matches), 1 (every row matches) or 0 (look at the rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literal, unit_view
from ..plans.compile import compile_predicate
from ..plans.predicate import Always, Compare, Custom, Group, IsNull, Predicate, validate
from ..types import Kind, StoreSchema

NONE, UNKNOWN, ALL = -1, 0, 1


def zone_map(df: DataFrame, group: Column, columns: Iterable[int | str] | None = None, name: str = "zone", schema: StoreSchema | None = None) -> DataFrame:
    """(zone, n, and for each column <i>_nulls, <i>_min, <i>_max, <i>_nan): one shuffle of partial aggregates.

    Bounds are over unit values for NULL and leave NaN out; of strings, over byte lengths.
    ``schema``: the columns, if the frame has others too.
    """
    schema = schema or StoreSchema.of(df.schema)
    places = range(len(schema.columns)) if columns is None else sorted({schema.place(c) for c in columns})
    parts = [F.count(F.lit(1)).alias("n")]
    for i in places:
        c, kind = df[f"`{schema[i].name}`"], schema[i].kind
        value = F.octet_length(unit_view(c, kind)) if kind is Kind.STR else unit_view(c, kind)
        floating = kind in (Kind.FLT, Kind.DBL)
        if floating:
            value = F.when(~F.isnan(value), value)
        parts += [
            F.count_if(c.isNull()).alias(f"{i}_nulls"),
            F.min(value).alias(f"{i}_min"),
            F.max(value).alias(f"{i}_max"),
            (F.coalesce(F.bool_or(F.isnan(c)), F.lit(False)) if floating else F.lit(False)).alias(f"{i}_nan"),
        ]
    return df.groupBy(group.alias(name)).agg(*parts)


def zone_match(p: Predicate, schema: StoreSchema) -> Column:
    """The tri-state of a predicate, over the columns of a zone map."""
    return _node(validate(p, schema), schema)


def _state(none: Column, every: Column) -> Column:
    none, every = F.coalesce(none, F.lit(True)), F.coalesce(every, F.lit(False))
    return F.when(none, F.lit(NONE)).when(every, F.lit(ALL)).otherwise(F.lit(UNKNOWN))


def _node(p: Predicate, schema: StoreSchema) -> Column:
    if isinstance(p, Always):
        found = F.lit(ALL)
    elif isinstance(p, Group):
        parts = [_node(x, schema) for x in p.operands]
        found = parts[0] if len(parts) == 1 else (F.least if p.op == "and" else F.greatest)(*parts)
    else:
        found = _leaf(p, schema)
    return -found if p.negated else found


def _leaf(p: Predicate, schema: StoreSchema) -> Column:
    i = schema.place(p.column)
    low, high = F.col(f"`{i}_min`"), F.col(f"`{i}_max`")
    if isinstance(p, IsNull):
        return _state(F.col(f"`{i}_nulls`") == 0, F.col(f"`{i}_nulls`") == F.col("n"))
    if isinstance(p, Custom):
        return F.coalesce(p.zone(low, high), F.lit(UNKNOWN)) if p.zone else F.lit(UNKNOWN)
    assert isinstance(p, Compare)
    no = F.lit(False)
    if isinstance(p.value, float) and math.isnan(p.value):
        return F.lit(NONE)
    if p.kind is Kind.STR:
        size = len(p.value.encode())
        if p.op == "eq":
            return _state((low > size) | (high < size), no)
        return _state(high < size, no) if p.op == "has" else F.lit(UNKNOWN)
    v, clean = literal(p.value, p.kind), ~F.col(f"`{i}_nan`")
    if p.op == "eq":
        return _state((low > v) | (high < v), (low == v) & (high == v) & clean)
    if p.op == "lt":
        return _state(low >= v, (high < v) & clean)
    return _state(high <= v, (low > v) & clean)


def explain_zones(df: DataFrame, group: Column, p: Predicate, name: str = "zone") -> DataFrame:
    """(zone, n, match) of every zone."""
    schema = StoreSchema.of(df.schema)
    zones = zone_map(df, group, _columns(p), name)
    return zones.select(name, "n", zone_match(p, schema).alias("match"))


def zone_filtered(df: DataFrame, group: Column, p: Predicate) -> DataFrame:
    """The matching rows, by zone: those of zones told to match nothing are skipped, those of zones told to match wholly pass untested.

    For custom zone tests, which a file's own statistics cannot serve; plain
    predicates over Parquet are pruned by the scan itself. The zone map is one
    row for each zone, and Spark broadcasts it only where it measures it small.
    """
    schema, zone, match = StoreSchema.of(df.schema), "zf_zone", "zf_match"
    zones = explain_zones(df, group, p, zone).select(zone, F.col("match").alias(match)).where(F.col(match) != NONE)
    joined = df.withColumn(zone, group).join(zones, zone)
    test = compile_predicate(p, schema, lambda n: F.col(f"`{n}`"))
    return joined.where((F.col(match) == ALL) | F.coalesce(test, F.lit(False))).drop(zone, match)


def _columns(p: Predicate) -> set[int | str]:
    if isinstance(p, Group):
        return set().union(*map(_columns, p.operands))
    return set() if isinstance(p, Always) else {p.column}

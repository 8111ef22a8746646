"""One query for each operator of the library, with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import contextlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import string_bytes, unit_view
from .operators.counts import parallel_count, row_count
from .operators.zones import explain_zones, zone_filtered, zone_map
from .plans import predicate as p
from .plans.compile import matching, projected
from .sources import files, tools
from .sources.cursor import Cursor
from .sources.reader import ROW_GROUP, Reader, open_matching, open_table
from .sources.writer import Writer, write_frame
from .types import Codec, Kind, StoreColumn, StoreSchema

Query = Callable[[SparkSession, str], DataFrame]


def _path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


# Tables with the six types. Timestamps are no part of the model and stay out.

LINES = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a boolean and a 32-bit float column."""
    df = spark.read.parquet(_path(sf_dir, "lineitem"))
    return df.select(*LINES, (F.col("l_returnflag") == "R").alias("is_return"), F.col("l_discount").cast("float").alias("f_discount"))


LINES_SQL = f"SELECT {', '.join(LINES)}, l_returnflag = 'R' AS is_return, CAST(l_discount AS FLOAT) AS f_discount FROM lineitem"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with NULLs in columns of three types."""
    df = spark.read.parquet(_path(sf_dir, "customer"))
    return df.select(
        "c_custkey",
        "c_name",
        F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
    )


PEOPLE_SQL = """SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS nation, nullif(c_mktsegment, 'BUILDING') AS segment,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer"""


def shown(df: DataFrame) -> DataFrame:
    """people with the 32-bit column as its unit view and a flag: not every client tells a 32-bit NULL from NaN."""
    return df.select("c_custkey", "c_name", unit_view(F.col("nation"), Kind.I32).alias("nation"), F.col("nation").isNull().alias("nation_null"), "segment", "balance")


_SHOWN = "c_custkey, c_name, coalesce(nation, 0) AS nation, nation IS NULL AS nation_null, segment, balance"


def odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with NaN, infinities, letters beyond ASCII, and NULLs of all types but the key's."""
    df = spark.read.parquet(_path(sf_dir, "part"))
    k = F.col("p_partkey")
    price = F.when(k % 7 == 0, math.nan).when(k % 7 == 2, -math.inf).when(k % 7 == 3, math.inf).when(k % 7 != 1, F.col("p_retailprice"))
    name = F.when(k % 4 == 0, F.concat(F.lit("École "), "p_brand")).when(k % 4 == 1, F.concat(F.lit("éCOLE "), "p_brand")).when(k % 4 == 3, F.col("p_name"))
    return df.select("p_partkey", name.alias("name"), F.when(k % 3 != 0, F.col("p_size")).alias("size"), F.when(k % 5 != 0, k % 2 == 0).alias("flag"), price.alias("price"), price.cast("float").alias("price32"))


ODD_SQL = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'École ' || p_brand WHEN 1 THEN 'éCOLE ' || p_brand WHEN 3 THEN p_name END AS name,
    CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 2 = 0 END AS flag, price, CAST(price AS FLOAT) AS price32
    FROM (SELECT *, CASE p_partkey % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN 'inf'::DOUBLE WHEN 1 THEN NULL ELSE p_retailprice END AS price FROM part) AS q"""


@dataclass(frozen=True)
class Filtered:
    base: Callable[[SparkSession, str], DataFrame]
    base_sql: str
    predicate: p.Predicate
    where: str
    nulls: str = "unit"

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        found = matching(self.base(spark, sf_dir), self.predicate, self.nulls)
        if self.base is people:
            return shown(found)
        return found.select("p_partkey", "name") if self.base is odd else found

    @property
    def sql(self) -> str:
        columns = {people: _SHOWN, odd: "p_partkey, name"}.get(self.base, "*")
        return f"SELECT {columns} FROM ({self.base_sql}) AS t WHERE {self.where}"


def _of_lines(predicate: p.Predicate, where: str) -> Filtered:
    return Filtered(lines, LINES_SQL, predicate, where)


def _of_people(predicate: p.Predicate, where: str) -> Filtered:
    return Filtered(people, PEOPLE_SQL, predicate, where)


def _of_odd(predicate: p.Predicate, where: str, nulls: str = "unit") -> Filtered:
    return Filtered(odd, ODD_SQL, predicate, where, nulls)


_FLAGS = p.any_of(p.str_eq("l_returnflag", "R"), p.str_eq("l_returnflag", "N"))

FILTERS: dict[str, Filtered] = {
    "pred_true": _of_people(p.true(), "TRUE"),
    "is_null": _of_people(p.is_null("segment"), "segment IS NULL"),
    "not_null": _of_people(~p.is_null("segment"), "segment IS NOT NULL"),
    "bit_eq_true": _of_lines(p.bit_eq("is_return", True), "is_return"),
    "bit_eq_false": _of_lines(p.bit_eq("is_return", False), "NOT is_return"),
    "i32_eq": _of_lines(p.i32_eq("l_linenumber", 3), "l_linenumber = 3"),
    "i32_lt": _of_lines(p.i32_lt("l_linenumber", 3), "l_linenumber < 3"),
    "i32_gt": _of_lines(p.i32_gt("l_linenumber", 5), "l_linenumber > 5"),
    "i64_eq": _of_lines(p.i64_eq("l_partkey", 77), "l_partkey = 77"),
    "i64_lt": _of_lines(p.i64_lt("l_orderkey", 500), "l_orderkey < 500"),
    "i64_gt": _of_lines(p.i64_gt("l_partkey", 150), "l_partkey > 150"),
    "flt_eq": _of_lines(p.flt_eq("f_discount", 0.07), "f_discount = CAST(0.07 AS FLOAT)"),
    "flt_lt": _of_lines(p.flt_lt("f_discount", 0.02), "f_discount < CAST(0.02 AS FLOAT)"),
    "flt_gt": _of_lines(p.flt_gt("f_discount", 0.08), "f_discount > CAST(0.08 AS FLOAT)"),
    "dbl_eq": _of_lines(p.dbl_eq("l_quantity", 24.0), "l_quantity = 24"),
    "dbl_lt": _of_lines(p.dbl_lt("l_quantity", 4.0), "l_quantity < 4"),
    "dbl_gt": _of_lines(p.dbl_gt("l_quantity", 47.0), "l_quantity > 47"),
    "derived_le": _of_lines(p.at_most(p.dbl_gt, "l_quantity", 3.0), "l_quantity <= 3"),
    "derived_ge": _of_lines(p.at_least(p.dbl_lt, "l_quantity", 48.0), "l_quantity >= 48"),
    "derived_ne": _of_lines(~p.i32_eq("l_linenumber", 1), "l_linenumber <> 1"),
    "in_via_or": _of_lines(p.any_of(*(p.i32_eq("l_linenumber", v) for v in (2, 4, 6))), "l_linenumber IN (2, 4, 6)"),
    "between_via_and": _of_lines(
        p.all_of(p.at_least(p.i64_lt, "l_orderkey", 100), p.at_most(p.i64_gt, "l_orderkey", 300)), "l_orderkey BETWEEN 100 AND 300"
    ),
    "str_eq_cs": _of_people(p.str_eq("segment", "MACHINERY"), "segment = 'MACHINERY'"),
    "str_eq_ci": _of_people(p.str_eq("segment", "machinery", False), "lower(segment) = 'machinery'"),
    "str_lt_cs": _of_people(p.str_lt("c_name", "Customer#000000200"), "c_name < 'Customer#000000200'"),
    "str_lt_ci": _of_people(p.str_lt("c_name", "CUSTOMER#000000200", False), "lower(c_name) < 'customer#000000200'"),
    "str_gt_cs": _of_people(p.str_gt("segment", "HOUSEHOLD"), "segment > 'HOUSEHOLD'"),
    "str_gt_ci": _of_people(p.str_gt("segment", "household", False), "lower(segment) > 'household'"),
    "str_start_cs": _of_people(p.str_has("segment", "MA", True, p.At.START), "prefix(segment, 'MA')"),
    "str_start_ci": _of_people(p.str_has("segment", "ma", False, p.At.START), "prefix(lower(segment), 'ma')"),
    "str_end_cs": _of_people(p.str_has("c_name", "7", True, p.At.END), "suffix(c_name, '7')"),
    "str_end_ci": _of_people(p.str_has("segment", "hold", False, p.At.END), "suffix(lower(segment), 'hold')"),
    "str_any_cs": _of_people(p.str_has("segment", "CHIN"), "contains(segment, 'CHIN')"),
    "str_any_ci": _of_people(p.str_has("segment", "chin", False), "contains(lower(segment), 'chin')"),
    "and_nary": _of_lines(
        p.all_of(p.dbl_gt("l_quantity", 20.0), p.i32_lt("l_linenumber", 5), p.bit_eq("is_return", True), p.flt_lt("f_discount", 0.05)),
        "l_quantity > 20 AND l_linenumber < 5 AND is_return AND f_discount < CAST(0.05 AS FLOAT)",
    ),
    "or_nary": _of_lines(
        p.any_of(p.dbl_lt("l_quantity", 2.0), p.i32_eq("l_linenumber", 7), p.i64_eq("l_partkey", 12)),
        "l_quantity < 2 OR l_linenumber = 7 OR l_partkey = 12",
    ),
    "nested": _of_lines(
        p.all_of(_FLAGS, p.any_of(p.dbl_gt("l_quantity", 45.0), p.all_of(p.i32_eq("l_linenumber", 1), p.dbl_lt("l_quantity", 5.0)))),
        "l_returnflag IN ('R', 'N') AND (l_quantity > 45 OR (l_linenumber = 1 AND l_quantity < 5))",
    ),
    "negate_group": _of_lines(~p.any_of(p.dbl_gt("l_quantity", 5.0), _FLAGS), "NOT (l_quantity > 5 OR l_returnflag IN ('R', 'N'))"),
    "negate_twice": _of_lines(~~p.i32_eq("l_linenumber", 2), "l_linenumber = 2"),
    "null_as_unit_eq": _of_people(p.i32_eq("nation", 0), "coalesce(nation, 0) = 0"),
    "null_as_unit_not": _of_people(~p.i32_eq("nation", 4), "coalesce(nation, 0) <> 4"),
    "null_as_unit_lt": _of_people(p.dbl_lt("balance", 10.0), "coalesce(balance, 0) < 10"),
    "null_as_unit_str": _of_people(p.str_lt("segment", "B"), "coalesce(segment, '') < 'B'"),
    "custom_rows": _of_lines(p.custom("l_orderkey", Kind.I64, rows=lambda c: c % 7 == 3), "l_orderkey % 7 = 3"),
    "custom_rows_arrow": _of_lines(
        p.custom("l_partkey", Kind.I64, rows=lambda a: pc.equal(pc.bit_wise_and(a, pa.scalar(63, pa.int64())), 5), arrow=True) & p.i64_lt("l_orderkey", 5000),
        "l_partkey & 63 = 5 AND l_orderkey < 5000",
    ),
    # NaN satisfies no comparison, so its negation does; a NULL compares as its unit value.
    "nan_dbl_gt": _of_odd(p.dbl_gt("price", 920.0), "price > 920 AND NOT isnan(price)"),
    "nan_dbl_not_gt": _of_odd(~p.dbl_gt("price", 920.0), "price IS NULL OR isnan(price) OR price <= 920"),
    "nan_dbl_lt": _of_odd(p.dbl_lt("price", 920.0), "price IS NULL OR price < 920"),
    "nan_dbl_not_lt": _of_odd(~p.dbl_lt("price", 920.0), "isnan(price) OR price >= 920"),
    "nan_dbl_eq": _of_odd(p.dbl_eq("price", math.nan), "FALSE"),
    "nan_dbl_not_eq": _of_odd(~p.dbl_eq("price", math.nan), "TRUE"),
    "nan_flt_gt": _of_odd(p.flt_gt("price32", 920.0), "price32 > 920 AND NOT isnan(price32)"),
    "nan_flt_not_lt": _of_odd(~p.flt_lt("price32", -5.0), "price32 IS NULL OR isnan(price32) OR price32 >= -5"),
    "inf_eq": _of_odd(p.dbl_eq("price", math.inf) | p.flt_eq("price32", -math.inf), "price = 'inf'::DOUBLE OR price32 = '-inf'::FLOAT"),
    "null_bit_eq_false": _of_odd(p.bit_eq("flag", False), "flag IS NULL OR NOT flag"),
    "null_bit_not": _of_odd(~p.bit_eq("flag", True), "flag IS NULL OR NOT flag"),
    "null_flt_eq_zero": _of_odd(p.flt_eq("price32", 0.0), "price32 IS NULL"),
    "null_i32_lt": _of_odd(p.i32_lt("size", 5), "coalesce(size, 0) < 5"),
    "str_beyond_ascii_ci": _of_odd(p.str_has("name", "éCoLe", False, p.At.START), "prefix(name, 'éCOLE')"),
    "str_beyond_ascii_eq_ci": _of_odd(p.str_has("name", "ÉCOLE BRAND#1", False), "contains(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'École brand#1')"),
    "str_beyond_ascii_gt": _of_odd(p.str_gt("name", "zz"), "name > 'zz'"),
    "str_empty_needle": _of_odd(p.str_has("name", "", True, p.At.START), "TRUE"),
    "sql_nulls_lt": _of_odd(p.dbl_lt("price", 920.0), "price < 920", "sql"),
    "sql_nulls_not": _of_odd(~p.i32_eq("size", 7), "size <> 7", "sql"),
    "sql_nulls_nested": _of_odd(p.any_of(~p.bit_eq("flag", True), p.all_of(p.i32_gt("size", 20), ~p.str_has("name", "cole"))), "NOT flag OR (size > 20 AND NOT contains(name, 'cole'))", "sql"),
}


# Scans and getters.


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_table(spark, _path(sf_dir, "customer")).frame


def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_table(spark, _path(sf_dir, "customer")).select("c_custkey", "c_acctbal")


def scan_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over strings and floats together, two columns out."""
    wanted = p.all_of(p.dbl_gt("c_acctbal", 20.0), p.i32_lt("c_nationkey", 12), p.str_has("c_mktsegment", "B", True, p.At.START), ~p.is_null("c_name"))
    return open_matching(spark, _path(sf_dir, "customer"), wanted).select("c_custkey", "c_acctbal")


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matching row with its place among all rows."""
    placed = open_matching(spark, _path(sf_dir, "customer"), p.i32_lt("c_nationkey", 5)).placed()
    return placed.select("c_custkey", F.col("zf_row").alias("place"))


def row_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching rows as an iteration meets them, numbered."""
    reader = open_matching(spark, _path(sf_dir, "customer"), p.i32_lt("c_nationkey", 5))
    return spark.createDataFrame([(i, r["c_custkey"]) for i, r in enumerate(reader.rows())], "turn bigint, c_custkey bigint")


def cursor_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values, one by one, of a stored table with NULLs; the cursor had moved on and was rewound."""
    path = scratch(spark)
    write_frame(people(spark, sf_dir).orderBy("c_custkey").coalesce(1), path, row_group_size=200)
    at, rows = open_matching(spark, path, p.i64_gt(0, 30)).cursor(), []
    at.next(), at.next()
    at.rewind()
    while at.next():
        rows.append((len(rows), at.get_i64(0), at.get_str("c_name"), at.get_i32(2), at.get_null(2), at.get_str_length(3), at.get_dbl(4)))
    return spark.createDataFrame(rows, "turn bigint, c_custkey bigint, c_name string, nation int, nation_null boolean, n_bytes int, balance double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(_path(sf_dir, "lineitem")).drop("l_shipdate")
    wanted = p.all_of(p.dbl_gt("l_quantity", 20.0), p.dbl_lt("l_discount", 0.08), p.str_has("l_returnflag", "R", True, p.At.START), ~p.is_null("l_linestatus"))
    return matching(df, wanted).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


def project_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = people(spark, sf_dir)
    rich = projected(p.dbl_gt("balance", 5000.0) | p.is_null("segment"), StoreSchema.of(df.schema))
    return df.select("c_custkey", rich.alias("wanted"))


def get_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("c_custkey", F.col("segment").isNull().alias("missing"))


def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = people(spark, sf_dir)
    shown = [unit_view(F.col(c.name), c.kind).alias(c.name) for c in StoreSchema.of(df.schema).columns]
    return df.select(*shown)


def string_bytes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = open_table(spark, _path(sf_dir, "customer"))
    return reader.frame.select("c_custkey", F.hex(string_bytes(reader.get_str("c_name"))).alias("bytes"), reader.get_str_length("c_name").cast("bigint").alias("n_bytes"))


# Counts.


def row_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(spark.read.parquet(_path(sf_dir, "lineitem")))


def row_count_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(matching(lines(spark, sf_dir), p.dbl_gt("l_quantity", 30.0) & p.str_eq("l_returnflag", "A")))


def parallel_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parallel_count(matching(lines(spark, sf_dir), p.dbl_gt("l_quantity", 30.0)))


def parallel_queried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor of each partition's matching rows that keeps totals of its own; these are added up."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, keys = 0, 0
        for b in batches:
            n, keys = n + b.num_rows, keys + (pc.sum(b.column("c_custkey")).as_py() or 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([keys], pa.int64())], ["n", "keys"])

    reader = open_matching(spark, _path(sf_dir, "customer"), p.dbl_gt("c_acctbal", 1000.0))
    return reader.parallel_query(visit, "n bigint, keys bigint").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each 300-row group of a file."""
    reader = Reader(spark, _path(sf_dir, "part"), None, 300)
    return reader.row_group_counts().select("zf_group", "n")


def row_group_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third group of 300 rows."""
    return Reader(spark, _path(sf_dir, "part"), None, 300).row_group(2)


# Zones: ranges of the key stand for row groups, as every file has a single one.


def _order_zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    df = spark.read.parquet(_path(sf_dir, "orders"))
    held = df.select(
        "o_orderkey",
        F.col("o_custkey").cast("int").alias("cust"),
        (F.col("o_orderstatus") == "F").alias("done"),
        F.col("o_totalprice").cast("float").alias("price"),
        "o_totalprice",
        "o_orderpriority",
    )
    return held, F.expr("o_orderkey div 1000")


_ZONES_SQL = """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS cust, o_orderstatus = 'F' AS done, CAST(o_totalprice AS FLOAT) AS price,
    o_totalprice, o_orderpriority FROM orders"""


def _zone_build(column: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, zone = _order_zones(spark, sf_dir)
        i = df.columns.index(column)
        zones = zone_map(df, zone, [column])
        return zones.select("zone", "n", F.col(f"{i}_nulls").alias("nulls"), F.col(f"{i}_min").alias("least"), F.col(f"{i}_max").alias("most"))

    return build


def _zone_build_sql(value: str) -> str:
    return f"""SELECT o_orderkey // 1000 AS zone, count(*) AS n, CAST(count(*) - count({value}) AS BIGINT) AS nulls, min({value}) AS least, max({value}) AS most
        FROM ({_ZONES_SQL}) AS t GROUP BY 1"""


def _zone_match(predicate: p.Predicate) -> Query:
    def match(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, zone = _order_zones(spark, sf_dir)
        return explain_zones(df, zone, predicate)

    return match


def _zone_match_sql(state: str) -> str:
    return f"SELECT o_orderkey // 1000 AS zone, count(*) AS n, CAST({state} AS INTEGER) AS match FROM ({_ZONES_SQL}) AS t GROUP BY 1"


_EQ = "CASE WHEN min({c}) > {v} OR max({c}) < {v} THEN -1 WHEN min({c}) = {v} AND max({c}) = {v} THEN 1 ELSE 0 END"
_LT = "CASE WHEN min({c}) >= {v} THEN -1 WHEN max({c}) < {v} THEN 1 ELSE 0 END"
_GT = "CASE WHEN max({c}) <= {v} THEN -1 WHEN min({c}) > {v} THEN 1 ELSE 0 END"
_HAS = "CASE WHEN max(strlen({c})) < {v} THEN -1 ELSE 0 END"

ZONE_BUILDS = {"bit": "done", "i32": "cust", "i64": "o_orderkey", "flt": "price", "dbl": "o_totalprice", "str": "o_orderpriority"}

ZONE_MATCHES: dict[str, tuple[p.Predicate, str]] = {
    "zone_match_eq": (p.i64_eq("o_orderkey", 2500), _EQ.format(c="o_orderkey", v=2500)),
    "zone_match_lt": (p.i64_lt("o_orderkey", 3000), _LT.format(c="o_orderkey", v=3000)),
    "zone_match_gt": (p.i64_gt("o_orderkey", 3500), _GT.format(c="o_orderkey", v=3500)),
    "zone_match_contains": (p.str_has("o_orderpriority", "x" * 9), _HAS.format(c="o_orderpriority", v=9)),
    "zone_match_and_or_not": (
        p.all_of(~p.i64_lt("o_orderkey", 2000), p.any_of(p.i64_gt("o_orderkey", 4999), p.i64_eq("o_orderkey", 2100))),
        f"least(-({_LT.format(c='o_orderkey', v=2000)}), greatest({_GT.format(c='o_orderkey', v=4999)}, {_EQ.format(c='o_orderkey', v=2100)}))",
    ),
    "zone_match_null": (p.is_null("cust"), "CASE WHEN count(cust) = count(*) THEN -1 WHEN count(cust) = 0 THEN 1 ELSE 0 END"),
    "custom_index": (
        p.custom("o_orderkey", Kind.I64, zone=lambda low, high: F.when(low > 6000, -1).when(high < 1000, 1).otherwise(0)),
        "CASE WHEN min(o_orderkey) > 6000 THEN -1 WHEN max(o_orderkey) < 1000 THEN 1 ELSE 0 END",
    ),
}


def _inside() -> p.Predicate:
    return p.custom(
        "o_orderkey",
        Kind.I64,
        rows=lambda c: (c >= 1500) & (c < 4200),
        zone=lambda low, high: F.when((high < 1500) | (low >= 4200), -1).when((low >= 1500) & (high < 4200), 1).otherwise(0),
    )


def zone_filtered_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom test with a zone test of its own, over a frame: whole zones are skipped or passed."""
    df, zone = _order_zones(spark, sf_dir)
    return zone_filtered(df, zone, _inside() & p.dbl_gt("o_totalprice", 100000.0)).select("o_orderkey", "o_totalprice")


def _stored_orders(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    write_frame(_order_zones(spark, sf_dir)[0].repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey"), path, row_group_size=500)
    return path


def zone_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stored table: its stored zone map tells which files are read, and which rows pass untested."""
    found = open_matching(spark, _stored_orders(spark, sf_dir), _inside() & p.dbl_gt("o_totalprice", 100000.0), 500).pruned()
    return found.select("o_orderkey", "o_totalprice")


def zone_pruned_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = p.i64_lt("o_orderkey", 700) & ~p.flt_lt("price", 50000.0)
    return open_matching(spark, _stored_orders(spark, sf_dir), wanted, 500).pruned().select("o_orderkey", "cust")


def zones_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone map that a writer stored: bounds of the key, NULLs and byte lengths of a string."""
    path = scratch(spark)
    write_frame(people(spark, sf_dir).orderBy("c_custkey").coalesce(1), path, row_group_size=400)
    names = {"group": "zone", "n": "n", "0_min": "least", "0_max": "most", "3_nulls": "nulls", "1_max": "longest"}
    return open_table(spark, path, 400).zones().select(*(F.col(f"`{k}`").alias(v) for k, v in names.items()))


# Tools.


def cat_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = open_table(spark, _path(sf_dir, "customer")).select("c_custkey", "c_name", "c_acctbal")
    supplier = open_table(spark, _path(sf_dir, "supplier")).select("s_suppkey", "s_name", "s_acctbal")
    return tools.concatenated([customer, supplier])


def head_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.head(open_table(spark, _path(sf_dir, "customer")))


def dump_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.dump(open_table(spark, _path(sf_dir, "customer")), 1)


def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.rendered_rows(people(spark, sf_dir).select("c_custkey", "nation", "segment", "balance", (F.col("nation") > 9).alias("far")))


def cat_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored tables written one after the other as a third."""
    one, two, out = scratch(spark), scratch(spark), scratch(spark)
    write_frame(open_table(spark, _path(sf_dir, "customer")).select("c_custkey", "c_name", "c_acctbal"), one)
    write_frame(open_table(spark, _path(sf_dir, "supplier")).select("s_suppkey", "s_name", "s_acctbal"), two)
    tools.cat(spark, [one, two], out, 500)
    return open_table(spark, out, 500).frame


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.analyze(open_table(spark, _path(sf_dir, "customer"))).drop("path")


# Sinks.

_scratched: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    """Scratch tables are read after their query returns, so they go when the program ends."""
    for spark, path in _scratched:
        with contextlib.suppress(Exception):
            files.delete(spark, path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the session shares."""
    path = f"{files.shared_folder(spark)}/zoneframe-{uuid.uuid4().hex}"
    _scratched.append((spark, path))
    return path


def _roundtrip(codec: Codec) -> Query:
    def through(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = people(spark, sf_dir)
        columns = [StoreColumn(c.name, c.kind, codec=codec, level=5) for c in StoreSchema.of(df.schema).columns]
        path = scratch(spark)
        write_frame(df, path, StoreSchema.build(columns), 250)
        return shown(open_table(spark, path, 250).frame)

    return through


_KINDS = {"i": Kind.I32, "l": Kind.I64, "b": Kind.BIT, "s": Kind.STR, "f": Kind.FLT, "d": Kind.DBL}


def put_null_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put one by one, NULLs of every type among them, filtered on reading; shown as unit values and flags."""
    columns = [StoreColumn(n, k, codec=Codec.ZSTD if n == "s" else Codec.NONE) for n, k in _KINDS.items()]
    path = scratch(spark)
    with Writer(spark, path, columns, 25) as w:
        for i in range(100):
            values = (i, i * 10, i % 3 == 0, f"row {i}", i / 8, i / 64)
            w.put(tuple(None if i % (12 + k) == 0 else v for k, v in enumerate(values)))
    found = open_matching(spark, path, p.all_of(~p.i32_gt(0, 70), p.i64_lt(1, 900)), 25)
    views = [x for n in _KINDS for x in (found.get_unit(n).alias(n), found.get_null(n).alias(f"{n}_null"))]
    return found.frame.select(F.col("s").alias("raw"), *views)


def put_single_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values put one column at a time, in any order of columns."""
    path = scratch(spark)
    with Writer(spark, path, [StoreColumn(n, k) for n, k in _KINDS.items()], 4) as w:
        for i in range(10):
            w.put_str("s", f"é{i}")
            w.put_dbl(5, i / 4)
            w.put_flt("f", i / 2)
            w.put_bit(2, i % 2 == 1)
            w.put_null("l") if i == 3 else w.put_i64("l", -i)
            w.put_i32(0, i)
    reader = open_table(spark, path, 4)
    return reader.select("i", "b", "s", "f", "d").join(reader.frame.select("i", reader.get_unit("l").alias("l")), "i")


def metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    with Writer(spark, path, [StoreColumn("i", Kind.I32, codec=Codec.ZSTD, level=3)]) as w:
        w.set_metadata("first")
        w.set_metadata("last")
        w.put((1,))
    reader = open_table(spark, path)
    codec, level = reader.column_compression(0)
    return spark.createDataFrame([(reader.metadata, codec.name, level)], "metadata string, codec string, level int")


def columns_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader tells of the columns of a written table, defaults and all."""
    path = scratch(spark)
    columns = [StoreColumn("a", Kind.I32), StoreColumn("b", Kind.STR, 0, Codec.LZ4, 9), StoreColumn("c", Kind.BIT, codec=Codec.ZSTD)]
    with Writer(spark, path, columns) as w:
        w.put((1, "x", True))
    r = open_table(spark, path)
    rows = [(i, r.column_name(i), r.column_type(i).name, int(r.column_type(i)), r.column_encoding(i), r.column_compression(i)[0].name, r.column_compression(i)[1]) for i in range(r.column_count)]
    return spark.createDataFrame(rows, "place int, name string, type string, code int, encoding int, codec string, level int")


def edge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without a row, of one row, of a row beyond a full group, and without metadata."""
    rows = []
    for n in (0, 1, 3, 4):
        path = scratch(spark)
        with Writer(spark, path, [StoreColumn("a", Kind.I32), StoreColumn("b", Kind.STR)], 3) as w:
            for i in range(n):
                w.put((i, None))
        r = open_table(spark, path, 3)
        rows.append((n, r.row_count(), r.column_count, r.row_group_counts().count(), r.metadata is None, r.cursor().next()))
    return spark.createDataFrame(rows, "put int, n int, columns int, row_groups int, bare boolean, has_row boolean")


def _outcome(do: Callable[[], object]) -> str:
    """The kind of error, or ok."""
    try:
        do()
    except Exception as e:
        kinds = (p.PredicateError, FileExistsError, KeyError, IndexError, TypeError, RuntimeError, ValueError)
        return next((k.__name__ for k in kinds if isinstance(e, k)), "Error")
    return "ok"


def misuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and how: getters, predicates, opening, putting."""
    path, customer = scratch(spark), _path(sf_dir, "customer")
    with Writer(spark, path, [StoreColumn("a", Kind.I32), StoreColumn("b", Kind.STR)]) as w:
        w.put((1, "x"))
    reader, at, whole = open_table(spark, path), open_table(spark, path).cursor(), StoreSchema.build([StoreColumn("a", Kind.I32), StoreColumn("b", Kind.STR), StoreColumn("c", Kind.BIT)])
    text = scratch(spark)
    spark.createDataFrame([("no table",)], "value string").write.text(text)
    halves = Writer(spark, scratch(spark), [StoreColumn("a", Kind.I32), StoreColumn("b", Kind.I32)])
    halves.put_i32(1, 5)

    def failing():
        yield {"a": 1}
        raise OSError

    broken = Cursor(reader.schema, failing)
    tries: dict[str, Callable[[], object]] = {
        "getter of the column's type": lambda: reader.get_i32("a"),
        "getter of another type": lambda: reader.get_i64("a"),
        "getter beyond the columns": lambda: reader.get(2),
        "getter of no column": lambda: reader.get("z"),
        "cursor before its first row": lambda: at.get_i32(0),
        "cursor at a row": lambda: at.next() and at.get_i32(0),
        "cursor of another type": lambda: at.get_str(0),
        "open what is not there": lambda: open_table(spark, path + "-none"),
        "open what is no table": lambda: open_table(spark, text),
        "open with a fitting predicate": lambda: open_matching(spark, path, p.i32_eq("a", 1) & p.true()),
        "open with a predicate of another type": lambda: open_matching(spark, path, p.i64_eq("a", 1)),
        "open with a predicate beyond the columns": lambda: open_matching(spark, customer, p.is_null(20)),
        "predicate of another type inside a group": lambda: p.validate(p.true() | ~p.all_of(p.i32_eq(0, 1), p.str_eq(0, "x")), whole),
        "order of booleans": lambda: p.validate(p.Compare("lt", "c", Kind.BIT, True), whole),
        "needle in a number": lambda: p.validate(p.Compare("has", 0, Kind.I32, 1), whole),
        "group of nothing": lambda: p.all_of(),
        "number beyond its type": lambda: p.i32_eq(0, 1 << 31),
        "string with NUL": lambda: p.str_eq(1, "a\0b"),
        "put too few values": lambda: halves.put((1,)),
        "put a row into a begun one": lambda: halves.put((1, 2)),
        "put another type": lambda: halves.put_str(0, "x"),
        "declare after the first value": lambda: halves.add_column(StoreColumn("c", Kind.I32)),
        "finish with columns of unlike length": lambda: halves.finish(),
        "finish without columns": lambda: Writer(spark, scratch(spark)).finish(),
        "put without columns": lambda: Writer(spark, scratch(spark)).put(()),
        "finish where a table is": lambda: Writer(spark, path, [StoreColumn("a", Kind.I32)]).finish(),
    }
    rows = [(k, _outcome(do)) for k, do in tries.items()]
    steps = [broken.next(), broken.next(), broken.next(), isinstance(broken.error, OSError), broken.rewind().error is None]
    rows.append(("cursor over rows that fail", " ".join(map(str, steps))))
    return spark.createDataFrame(rows, "what string, outcome string")


MISUSE = {
    "getter of the column's type": "ok",
    "getter of another type": "TypeError",
    "getter beyond the columns": "IndexError",
    "getter of no column": "KeyError",
    "cursor before its first row": "IndexError",
    "cursor at a row": "ok",
    "cursor of another type": "TypeError",
    "open what is not there": "Error",
    "open what is no table": "Error",
    "open with a fitting predicate": "ok",
    "open with a predicate of another type": "PredicateError",
    "open with a predicate beyond the columns": "PredicateError",
    "predicate of another type inside a group": "PredicateError",
    "order of booleans": "PredicateError",
    "needle in a number": "PredicateError",
    "group of nothing": "ValueError",
    "number beyond its type": "ValueError",
    "string with NUL": "ValueError",
    "put too few values": "ValueError",
    "put a row into a begun one": "ValueError",
    "put another type": "TypeError",
    "declare after the first value": "RuntimeError",
    "finish with columns of unlike length": "ValueError",
    "finish without columns": "ValueError",
    "put without columns": "ValueError",
    "finish where a table is": "FileExistsError",
    "cursor over rows that fail": "True False False True True",
}


def cost_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands by cost: cheap tests first, custom ones by the cost they name."""
    held = p.any_of(p.custom(0, Kind.I32), p.custom(1, Kind.I64, cost=999), p.i64_eq(1, 1), p.str_eq(2, "x"), p.true(), p.all_of(p.i32_eq(0, 1), p.bit_eq(3, True)))
    rows = [(k, type(x).__name__, p.cost(x)) for k, x in enumerate(p.cheapest_first(held).operands)]
    return spark.createDataFrame(rows, "turn int, what string, cost int")


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


PLAIN: dict[str, tuple[Query, str | None]] = {
    "scan_all": (scan_all, "SELECT * FROM customer"),
    "scan_project": (scan_project, "SELECT c_custkey, c_acctbal FROM customer"),
    "scan_matching": (scan_matching, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 20 AND c_nationkey < 12 AND prefix(c_mktsegment, 'B')"),
    "file_order": (file_order, "SELECT c_custkey, c_custkey - (SELECT min(c_custkey) FROM customer) AS place FROM customer WHERE c_nationkey < 5"),
    "row_iteration": (row_iteration, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS turn, c_custkey FROM customer WHERE c_nationkey < 5"),
    "cursor_values": (
        cursor_values,
        f"""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS turn, c_custkey, c_name, coalesce(nation, 0) AS nation, nation IS NULL AS nation_null,
        CAST(strlen(coalesce(segment, '')) AS INTEGER) AS n_bytes, coalesce(balance, 0) AS balance FROM ({PEOPLE_SQL}) AS t WHERE c_custkey > 30""",
    ),
    "flagship": (
        flagship,
        """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem
        WHERE l_quantity > 20 AND l_discount < 0.08 AND prefix(l_returnflag, 'R') AND l_linestatus IS NOT NULL""",
    ),
    "project_predicate": (project_predicate, f"SELECT c_custkey, coalesce(balance, 0) > 5000 OR segment IS NULL AS wanted FROM ({PEOPLE_SQL}) AS t"),
    "get_null": (get_null, f"SELECT c_custkey, segment IS NULL AS missing FROM ({PEOPLE_SQL}) AS t"),
    "unit_view": (
        unit_values,
        f"SELECT c_custkey, c_name, coalesce(nation, 0) AS nation, coalesce(segment, '') AS segment, coalesce(balance, 0) AS balance FROM ({PEOPLE_SQL}) AS t",
    ),
    "string_bytes": (string_bytes_of, "SELECT c_custkey, hex(encode(c_name)) AS bytes, CAST(strlen(c_name) AS BIGINT) AS n_bytes FROM customer"),
    "row_count_all": (row_count_all, "SELECT count(*) AS n FROM lineitem"),
    "row_count_matching": (row_count_matching, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'A'"),
    "parallel_count": (parallel_counted, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30"),
    "parallel_query": (parallel_queried, "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_acctbal > 1000"),
    "row_groups": (row_groups, "SELECT g AS zf_group, count(*) AS n FROM (SELECT (row_number() OVER () - 1) // 300 AS g FROM part) AS t GROUP BY g"),
    "row_group": (row_group_two, "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER () - 1 AS r FROM part) AS t WHERE r // 300 = 2"),
    "zones_stored": (
        zones_stored,
        f"""SELECT g AS zone, count(*) AS n, min(c_custkey) AS least, max(c_custkey) AS most, CAST(count(*) - count(segment) AS BIGINT) AS nulls, max(strlen(c_name)) AS longest
        FROM (SELECT *, (row_number() OVER (ORDER BY c_custkey) - 1) // 400 AS g FROM ({PEOPLE_SQL}) AS q) AS t GROUP BY g""",
    ),
    "zone_pruned_plain": (zone_pruned_plain, "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS cust FROM orders WHERE o_orderkey < 700 AND CAST(o_totalprice AS FLOAT) >= 50000"),
    "zone_filtered_frame": (zone_filtered_frame, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1500 AND o_orderkey < 4200 AND o_totalprice > 100000"),
    "zone_pruned_scan": (zone_pruned_scan, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1500 AND o_orderkey < 4200 AND o_totalprice > 100000"),
    "cat_union_all": (cat_union_all, "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "head_20": (
        head_20,
        """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, printf('%.6f', c_acctbal) AS c_acctbal, c_mktsegment
        FROM customer ORDER BY customer.c_custkey LIMIT 20""",
    ),
    "dump_column": (dump_column, "SELECT c_name AS value FROM customer"),
    "render_text": (
        render_text,
        f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(CAST(nation AS VARCHAR), '(null)') AS nation, coalesce(segment, '(null)') AS segment,
        coalesce(printf('%.6f', balance), '(null)') AS balance, CASE WHEN nation IS NULL THEN '(null)' WHEN nation > 9 THEN '1' ELSE '0' END AS far
        FROM ({PEOPLE_SQL}) AS t""",
    ),
    "cat_stored": (cat_stored, "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "analyze": (
        analyze,
        f"""SELECT (SELECT count(*) FROM customer) AS rows, CAST(5 AS INTEGER) AS columns, CAST(place AS INTEGER) AS place, name, type, CAST(NULL AS VARCHAR) AS compression FROM (
        {_values([(0, 'c_custkey', 'I64'), (1, 'c_name', 'STR'), (2, 'c_nationkey', 'I32'), (3, 'c_acctbal', 'DBL'), (4, 'c_mktsegment', 'STR')], 'place, name, type')}) AS q""",
    ),
    **{f"write_roundtrip_{c.name.lower()}": (_roundtrip(c), f"SELECT {_SHOWN} FROM ({PEOPLE_SQL}) AS t") for c in Codec},
    "put_null_roundtrip": (
        put_null_roundtrip,
        """SELECT CASE WHEN i % 15 <> 0 THEN 'row ' || i END AS raw, CAST(CASE WHEN i % 12 = 0 THEN 0 ELSE i END AS INTEGER) AS i, i % 12 = 0 AS i_null,
        CAST(CASE WHEN i % 13 = 0 THEN 0 ELSE i * 10 END AS BIGINT) AS l, i % 13 = 0 AS l_null, i % 14 <> 0 AND i % 3 = 0 AS b, i % 14 = 0 AS b_null,
        CASE WHEN i % 15 = 0 THEN '' ELSE 'row ' || i END AS s, i % 15 = 0 AS s_null, CAST(CASE WHEN i % 16 = 0 THEN 0 ELSE i / 8 END AS FLOAT) AS f, i % 16 = 0 AS f_null,
        CASE WHEN i % 17 = 0 THEN 0 ELSE i / 64 END AS d, i % 17 = 0 AS d_null
        FROM range(100) AS r(i) WHERE (i <= 70 OR i % 12 = 0) AND (i * 10 < 900 OR i % 13 = 0)""",
    ),
    "put_single_values": (
        put_single_values,
        "SELECT CAST(i AS INTEGER) AS i, i % 2 = 1 AS b, 'é' || i AS s, CAST(i / 2 AS FLOAT) AS f, i / 4 AS d, CAST(CASE WHEN i = 3 THEN 0 ELSE -i END AS BIGINT) AS l FROM range(10) AS r(i)",
    ),
    "metadata_roundtrip": (metadata_roundtrip, _values([("last", "ZSTD", 3)], "metadata, codec, level")),
    "columns_described": (
        columns_described,
        _values([(0, "a", "I32", 1, 0, "NONE", 1), (1, "b", "STR", 5, 0, "LZ4", 9), (2, "c", "BIT", 0, 0, "ZSTD", 1)], "place, name, type, code, encoding, codec, level"),
    ),
    "edge_tables": (
        edge_tables,
        _values([(0, 0, 2, 0, True, False), (1, 1, 2, 1, True, True), (3, 3, 2, 1, True, True), (4, 4, 2, 2, True, True)], "put, n, columns, row_groups, bare, has_row"),
    ),
    "defaults": (
        lambda spark, sf_dir: spark.createDataFrame([(ROW_GROUP, int(StoreColumn("a", Kind.I32).codec), StoreColumn("a", Kind.I32).level, StoreColumn("a", Kind.I32).encoding)], "row_group int, codec int, level int, encoding int"),
        _values([(100_000, 0, 1, 0)], "row_group, codec, level, encoding"),
    ),
    "misuse": (misuse, _values(list(MISUSE.items()), "what, outcome")),
    "cost_order": (
        cost_order,
        _values([(0, "Always", 0), (1, "Custom", 8), (2, "Group", 9), (3, "Compare", 16), (4, "Compare", 128), (5, "Custom", 999)], "turn, what, cost"),
    ),
}


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {k: q for k, (q, _) in PLAIN.items()} | dict(FILTERS)
    found |= {f"zone_build_{k}": _zone_build(c) for k, c in ZONE_BUILDS.items()}
    return found | {k: _zone_match(x) for k, (x, _) in ZONE_MATCHES.items()}


def oracle_sql() -> dict[str, str]:
    found = {k: sql for k, (_, sql) in PLAIN.items() if sql} | {k: f.sql for k, f in FILTERS.items()}
    found |= {f"zone_build_{k}": _zone_build_sql("strlen(o_orderpriority)" if k == "str" else c) for k, c in ZONE_BUILDS.items()}
    return found | {k: _zone_match_sql(state) for k, (_, state) in ZONE_MATCHES.items()}

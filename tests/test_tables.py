"""Writing, reading, tools, streams, and every query against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from zoneframe import queries as library
from zoneframe.operators.counts import parallel_count
from zoneframe.plans import predicate as p
from zoneframe.sources import tools
from zoneframe.sources.reader import Reader, open_matching, open_table
from zoneframe.sources.writer import Writer, write_frame
from zoneframe.streaming import open_stream
from zoneframe.types import Codec, Kind, StoreColumn, StoreSchema

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def hundred(spark, path, codec, group=25):
    columns = [StoreColumn(f"column {i}", k, codec=codec, level=5) for i, k in enumerate([Kind.I32, Kind.I64, Kind.BIT, Kind.STR, Kind.FLT, Kind.DBL])]
    with Writer(spark, path, columns, group) as w:
        for i in range(100):
            w.put((i, i * 10, i % 3 == 0, None if i % 12 == 0 else f"zf {i}", i / 10, i / 100))
        w.set_metadata("foo")
        w.set_metadata("bar")
        w.finish()
        w.finish()
    return columns


@pytest.mark.parametrize("codec", list(Codec))
def test_round_trip(spark, tmp_path, codec):
    path = str(tmp_path / "t")
    columns = hundred(spark, path, codec)
    reader = open_table(spark, path, 25)
    assert (reader.row_count(), reader.column_count, reader.metadata) == (100, 6, "bar")
    assert [reader.column(i) for i in range(6)] == columns
    assert reader.column_compression(3) == (codec, 5) and reader.column_type("column 4") is Kind.FLT and reader.column_encoding(0) == 0
    rows = list(reader.rows())
    assert [r[0] for r in rows] == list(range(100)) == [r[0] for r in reader]
    assert rows[13] == (13, 130, False, "zf 13", rows[13][4], 0.13) and rows[12][3] is None
    assert parallel_count(reader.frame).first()[0] == 100
    assert [r["n"] for r in reader.row_group_counts().collect()] == [25] * 4
    assert sorted(r[0] for r in reader.row_group(2).collect()) == list(range(50, 75))
    (file,) = (tmp_path / "t").glob("*.parquet")
    assert [pq.ParquetFile(file).metadata.row_group(k).num_rows for k in range(4)] == [25] * 4
    wanted = p.all_of(p.i32_gt(0, 20), p.i64_lt(1, 900), p.bit_eq(2, True), ~p.is_null(3), p.str_has(3, "0", False, p.At.END))
    match = open_matching(spark, path, wanted)
    assert [r[0] for r in match.rows()] == [30] and match.row_count() == 1
    nulls = open_matching(spark, path, p.is_null(3))
    assert nulls.row_count() == 9
    got = reader.frame.select(reader.get_i32(0), reader.get_null(3), reader.get_unit(3), reader.get_str_length(3), reader.get_str_bytes(3)).where("`column 0` = 13").first()
    assert tuple(got) == (13, False, "zf 13", 5, bytearray(b"zf 13"))


def test_wrong_use(spark, tmp_path):
    path = str(tmp_path / "t")
    hundred(spark, path, Codec.NONE)
    reader = Reader(spark, path)
    with pytest.raises(p.PredicateError):
        open_matching(spark, path, p.i64_eq(0, 3))
    with pytest.raises(TypeError):
        reader.get_i64(0)
    with pytest.raises(IndexError):
        reader.get(6)
    with pytest.raises(ValueError):
        Reader(spark, path, None, 0)
    w = Writer(spark, str(tmp_path / "u"), [StoreColumn("a", Kind.I32), StoreColumn("b", Kind.STR)])
    for row in ((1,), (1, 2, 3)):
        with pytest.raises(ValueError):
            w.put(row)
    for row in (("x", "y"), (1.0, "y"), (1, 2), (True, "y")):
        with pytest.raises(TypeError):
            w.put(row)
    with pytest.raises(ValueError):
        w.put((1, "a\0"))
    w.put((1, "x"))
    with pytest.raises(RuntimeError):
        w.add_column(StoreColumn("c", Kind.I32))
    with pytest.raises(ValueError):
        Writer(spark, str(tmp_path / "v")).finish()
    with pytest.raises(ValueError):
        StoreSchema.build([StoreColumn("a", Kind.I32)] * 2)
    with pytest.raises(TypeError):
        write_frame(spark.range(3), str(tmp_path / "w"), StoreSchema.build([StoreColumn("id", Kind.I32)]))


def test_single_values(spark, tmp_path):
    path = str(tmp_path / "t")
    kinds = [Kind.BIT, Kind.I32, Kind.I64, Kind.FLT, Kind.DBL, Kind.STR]
    with Writer(spark, path, [StoreColumn(k.name, k) for k in kinds], 2) as w:
        for i in range(5):
            w.put_i32("I32", i)
            w.put_bit(0, i > 2)
            w.put_i64(2, -i)
            w.put_flt(3, i / 2)
            w.put_null(4) if i % 2 else w.put_dbl(4, i / 4)
            w.put_str(5, str(i))
    reader = open_table(spark, path, 2)
    assert [tuple(r) for r in reader.rewind()] == [(i > 2, i, -i, i / 2, None if i % 2 else i / 4, str(i)) for i in range(5)]
    assert sorted(r["n"] for r in reader.row_group_counts().collect()) == [1, 2, 2]
    w = Writer(spark, str(tmp_path / "u"), [StoreColumn("a", Kind.I32), StoreColumn("b", Kind.I32)])
    w.put_i32(0, 1)
    with pytest.raises(ValueError):
        w.finish()
    with pytest.raises(TypeError):
        w.put_str(0, "x")
    with pytest.raises(IndexError):
        w.put_i32(2, 1)


def test_zone_filtered(spark):
    from zoneframe.operators.zones import zone_filtered
    from zoneframe.plans.compile import matching

    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("m"))
    zone = F.expr("id div 10")
    for q in (p.i64_lt("id", 35) & ~p.i64_eq("m", 3), ~p.i64_gt("id", 90), p.true(), ~p.true()):
        assert sorted(r["id"] for r in zone_filtered(df, zone, q).collect()) == sorted(r["id"] for r in matching(df, q).collect())
    whole = p.custom("id", Kind.I64, zone=lambda a, b: F.when(a >= 70, 1).otherwise(-1))  # no row test: whole zones or nothing
    assert sorted(r["id"] for r in zone_filtered(df, zone, whole).collect()) == list(range(70, 100))


def test_failed_block_writes_nothing(spark, tmp_path):
    with pytest.raises(KeyError), Writer(spark, str(tmp_path / "t"), [StoreColumn("a", Kind.I32)]) as w:
        w.put((1,))
        raise KeyError
    assert not (tmp_path / "t").exists()


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    with Writer(spark, path) as w:
        w.add_column(StoreColumn("a", Kind.I32))
        w.add_column(StoreColumn("b", Kind.STR))
    reader = open_table(spark, path)
    assert reader.row_count() == 0 and list(reader) == [] and reader.metadata is None and reader.column_count == 2
    assert tools.head_text(reader) == "a\tb"
    assert parallel_count(reader.frame).first()[0] == 0


def test_special_floats_round_trip(spark, tmp_path):
    import math

    path = str(tmp_path / "t")
    held = [math.nan, math.inf, -math.inf, -0.0, None, 1.5]
    with Writer(spark, path, [StoreColumn("f", Kind.FLT), StoreColumn("d", Kind.DBL)]) as w:
        for v in held:
            w.put((v, v))
    count = lambda q: open_matching(spark, path, q).row_count()
    assert (count(p.flt_gt(0, 1.0)), count(p.dbl_gt(1, 1.0)), count(~p.dbl_gt(1, 1.0))) == (2, 2, 4)
    assert (count(p.dbl_eq(1, 0.0)), count(p.is_null(1)), count(p.dbl_eq(1, math.nan)), count(~p.dbl_eq(1, math.nan))) == (2, 1, 0, 6)


def test_tools(spark, tmp_path):
    one, two, out = (str(tmp_path / n) for n in ("one", "two", "out"))
    hundred(spark, one, Codec.ZSTD)
    with Writer(spark, two, [StoreColumn(f"x{i}", k) for i, k in enumerate([Kind.I32, Kind.I64, Kind.BIT, Kind.STR, Kind.FLT, Kind.DBL])]) as w:
        w.put((None, None, None, None, None, None))
    tools.cat(spark, [one, two], out, 30)
    reader = open_table(spark, out, 30)
    assert reader.row_count() == 101 and reader.metadata is None and reader.column_compression(0) == (Codec.ZSTD, 5)
    about = tools.analyze(reader).orderBy("place").collect()
    assert (about[0]["rows"], about[0]["columns"], about[0]["type"], about[0]["compression"]) == (101, 6, "I32", "ZSTD (5)")
    text = tools.head_text(open_table(spark, one)).split("\n")
    assert len(text) == 21 and text[0].startswith("column 0\tcolumn 1") and text[1] == "0\t0\t1\t(null)\t0.000000\t0.000000"
    assert [r["value"] for r in tools.dump(open_table(spark, two), 3).collect()] == ["(null)"]
    assert list(tools.dumped(open_matching(spark, one, p.i32_lt(0, 4)), 3)) == ["(null)", "zf 1", "zf 2", "zf 3"]
    with Writer(spark, str(tmp_path / "three"), [StoreColumn("a", Kind.I32)]) as w:
        w.put((1,))
    with pytest.raises(ValueError):
        tools.cat(spark, [one, str(tmp_path / "three")], str(tmp_path / "bad"))
    with pytest.raises(TypeError):
        tools.concatenated([spark.range(1), spark.range(1).select(F.col("id").cast("int"))])


def test_incremental_zones(spark):
    from zoneframe.operators.zones import zone_map

    top = 2**31 - 1
    rows = [(10, "foo"), (20, "foobar"), (15, "yeah"), (top, "foobarbaz"), (0, ""), (-top - 1, "x")]
    df = spark.createDataFrame(rows, StoreSchema.build([StoreColumn("a", Kind.I32), StoreColumn("s", Kind.STR)]).struct())
    z = zone_map(df, F.lit(0)).first()
    assert (z["n"], z["0_min"], z["0_max"], z["1_min"], z["1_max"]) == (6, -top - 1, top, 0, 9)


def test_stream(spark, tmp_path):
    path = str(tmp_path / "t")
    hundred(spark, path, Codec.NONE)
    schema = open_table(spark, path).schema
    query = open_stream(spark, path, schema, p.i32_gt(0, 89)).writeStream.format("memory").queryName("kept").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("kept").count() == 10


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def comparable(rows):
    def plain(v):
        if v is None or v != v:
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else repr(v)

    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    df = library.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(library.oracle_sql()[name])
    place = [d[0] for d in want.description]
    assert sorted(place) == columns
    expected = [tuple(r[place.index(c)] for c in columns) for r in want.fetchall()]
    assert comparable(tuple(r[c] for c in columns) for r in df.collect()) == comparable(expected)


def test_queries_without_sql(spark):
    for name in set(library.queries()) - set(library.oracle_sql()):
        assert library.queries()[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == library.flagship(spark, SF).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


ALONE = """
import sys
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(found) and "flagship" in found
assert not [k for k in found if k[:2] == "op" and k[2].isdigit() or k == "pipeline"], sorted(found)
assert not any(m.startswith("zoneframe.llm") for m in sys.modules)
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_corpus_operators(tmp_path, pipeline):
    """A copy without the optional package, with and without the pipeline that needs it, has all other queries."""
    root, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    shutil.copytree(root / "zoneframe", copy / "zoneframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", copy)
    found = subprocess.run([sys.executable, "-B", "-c", ALONE], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr[-2000:]


def rows_scanned(df):
    """Output rows of the scans of a plan, once it has run."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_stored_zones_prune(spark, tmp_path):
    """Files without a zone that can match are not read, for plain predicates and for custom ones that no scan understands."""
    path = str(tmp_path / "t")
    df = spark.range(8000).select("id", F.concat(F.lit("x"), F.repeat(F.lit("y"), (F.col("id") / 2000).cast("int"))).alias("s"))
    write_frame(df.repartitionByRange(8, "id").sortWithinPartitions("id"), path, row_group_size=250)
    zones = open_table(spark, path, 250).zones()
    assert zones.count() == zones.select("file", "group").distinct().count() >= 32 and zones.agg(F.sum("n")).first()[0] == 8000
    band = p.custom("id", Kind.I64, rows=lambda c: (c >= 3000) & (c < 3100), zone=lambda low, high: F.when((high < 3000) | (low >= 3100), -1).otherwise(0))
    longest = p.str_has("s", "yyy")  # only a byte length of 4 can hold it
    for wanted, most in ((band, 3000), (p.i64_lt("id", 50), 2000), (longest, 4000), (band & p.i64_gt("id", 7000), 0), (~p.i64_lt("id", 7900), 2000)):
        reader = open_matching(spark, path, wanted, 250)
        assert sorted(map(tuple, reader.pruned().collect())) == sorted(map(tuple, reader.frame.collect()))
        assert rows_scanned(reader.pruned()) <= most + (reader.zones().count() if p.has_custom(wanted) else 0)
    whole = open_matching(spark, path, p.custom("id", Kind.I64, zone=lambda low, high: F.when(low >= 7500, 1).otherwise(-1)), 250)
    kept = [r["id"] for r in whole.pruned().collect()]  # no row test: whole zones or nothing
    assert kept and min(kept) >= 7500 and len(kept) >= 250
    assert rows_scanned(open_table(spark, path).frame) == 8000 and open_table(spark, path, 250).pruned().count() == 8000
    write_frame(df.limit(5), str(tmp_path / "u"), zones=False)
    bare = open_matching(spark, str(tmp_path / "u"), p.i64_lt("id", 3))
    assert bare.zones() is None and bare.pruned().count() == bare.row_count()


def test_writer_holds_little(spark, tmp_path, monkeypatch):
    """Full row groups go to files as they fill; order, groups and the last metadata are those of a single file."""
    from zoneframe.sources import writer

    monkeypatch.setattr(writer, "HELD", 4000)
    path, most = str(tmp_path / "t"), 0
    with Writer(spark, path, [StoreColumn("a", Kind.I64), StoreColumn("s", Kind.STR, codec=Codec.ZSTD)], 50) as w:
        w.set_metadata("early")
        for i in range(1030):
            w.put((i, f"text {i}"))
            most = max(most, sum(b.nbytes for b in w._batches))
        assert most < 6000 and w._files > 3 and not (tmp_path / "t").exists()
        w.set_metadata("late")
    reader = open_table(spark, path, 50)
    assert [r["a"] for r in reader.rows()] == list(range(1030)) and reader.metadata == "late"
    assert sorted(r["n"] for r in reader.row_group_counts().collect()) == [30] + [50] * 20
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ZeroDivisionError), Writer(spark, str(tmp_path / "u"), [StoreColumn("a", Kind.I64)], 50) as w:
        for i in range(2000):
            w.put((i,))
        assert w._files
        raise ZeroDivisionError
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    with pytest.raises(FileExistsError), Writer(spark, path, [StoreColumn("a", Kind.I64)]) as w:
        w.put((1,))
    assert [x.name for x in tmp_path.iterdir()] == ["t"]


def test_rows_of_many_files(spark, tmp_path):
    """Files in order of their names, however they are named, each in its own order."""
    path = str(tmp_path / "a b%é")
    write_frame(spark.range(300).repartitionByRange(5, "id").sortWithinPartitions(F.desc("id")), path, row_group_size=20)
    reader = open_matching(spark, path, p.i64_gt(0, 10))
    want = [r["id"] for r in reader.ordered().collect()]
    assert [r["id"] for r in reader.rows()] == want and sorted(want) == list(range(11, 300)) and want[:3] == sorted(want[:3], reverse=True)
    assert reader.pruned().count() == 289


def test_cursor(spark, tmp_path):
    path = str(tmp_path / "t")
    hundred(spark, path, Codec.NONE)
    at = open_matching(spark, path, p.i32_gt(0, 89)).cursor()
    with pytest.raises(IndexError):
        at.get_i32(0)
    seen = []
    while at.next():
        seen.append((at.get_i32(0), at.get_i64("column 1"), at.get_bit(2), at.get_null(3), at.get_str(3), at.get_str_length(3), at.get_str_bytes(3), at.get_dbl(5)))
    assert [s[0] for s in seen] == list(range(90, 100)) and seen[6] == (96, 960, True, True, "", 0, b"", 0.96)
    assert seen[1][3:7] == (False, "zf 91", 5, b"zf 91") and not at.next() and at.error is None
    assert at.rewind().next() and at.get_i32(0) == 90 and at.get_flt(4) == pytest.approx(9.0)
    with pytest.raises(TypeError):
        at.get_i64(0)


def test_count_reads_no_column(spark):
    """An unfiltered count takes its rows from the files' footers: the scan has an empty schema."""
    plan = open_table(spark, f"{SF}/customer.parquet").frame.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from zoneframe.sources import files

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        files.shared_folder(Elsewhere)
    assert files.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

"""The pipeline's stages, each on its own input, and run() over a small table, against plain versions."""

import random
import re

import pyarrow.dataset as ds
import pytest
from brute import WORD, check_packing, op5
from pyspark.sql import functions as F

import corpus_pipeline
from zoneframe.llm import pii

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOICES = {
    "en": "the of and to in that was with for which this from house garden mother father".split(),
    "de": "der die das und mit nicht für eine haus garten mutter vater straße über zwischen".split(),
}


def corpus():
    rng = random.Random(11)
    rows = []

    def add(text, lang="en"):
        rows.append((len(rows), text, lang, "s", None if text is None else len(text)))

    def prose(lang, n):
        return " ".join(rng.choice(VOICES[lang]) + str(rng.randrange(400)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))

    for k in range(60):
        lang = "en" if k % 2 else "de"
        add("\n".join(prose(lang, 12) for _ in range(6)), lang)
    for k in range(10):
        add(rows[k][1], rows[k][2])  # copies
        words = rows[20 + k][1].split(" ")
        words[7] = "changed"
        add(" ".join(words), rows[20 + k][2])  # near copies
    add("Mail me at someone@mail.example.org or 10.1.2.3, " + prose("en", 30))
    for odd in (None, "", "123 456", "??", "\n\n\n"):
        add(odd)
    add("one line", None)
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def shingles_of(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "personal_data", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, rows_of(docs)
    stage = dict(corpus_pipeline.STAGES)

    known = stage["language_id"](spark, docs, sf).cache()
    assert known.columns == columns
    assert set(before) - set(rows_of(known)) == {i for i, t in before.items() if not t or not any(c.isalpha() for c in t)}

    lines = stage["line_dedup"](spark, known, sf).cache()
    want = {i: t for i, _, _, t in op5(sorted(rows_of(known).items()))}
    assert lines.columns == columns and rows_of(lines) == want
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    single = stage["near_dedup"](spark, lines, sf).cache()
    left = rows_of(single)
    assert single.columns == columns and set(left.items()) <= set(want.items())
    group, shingles = {}, {i: shingles_of(t) for i, t in want.items()}
    for i in sorted(shingles):  # smallest doc_id that links lead to
        linked = {group[j] for j in group if shingles[i] == shingles[j] or 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])}
        top = min(linked, default=i)
        group = {j: top if g in linked else g for j, g in group.items()} | {i: top}
    assert set(left) == set(group.values()) and len(left) < len(want)

    masked = stage["personal_data"](spark, single, sf).cache()
    assert masked.columns == columns and rows_of(masked) == {i: pii.mask(t, pii.find(t)) for i, t in left.items()}
    assert any("[EMAIL]" in t and "[IP]" in t for t in rows_of(masked).values())

    pieces = [tuple(r) for r in stage["packing"](spark, masked, sf).collect()]
    check_packing(list(rows_of(masked).items()), pieces)

    last = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    check_packing(list(rows_of(masked).items()), last)


def test_empty_and_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "a b", None, None, None)] * 2, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, nulls, "")
        assert found.count() >= 0 and (name == "packing" or found.columns == nulls.columns), name
    wide = spark.createDataFrame(corpus()[:8], SCHEMA).select("*", F.lit(1).alias("k_id"), F.lit("x").alias("TEXT"), F.lit("y").alias("places"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, "").columns == wide.columns, name


def test_spent_stages_are_deleted(spark, sf):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = {p for p in ds.dataset(shared, format="parquet", exclude_invalid_files=True).files if "pipeline-" in p}
    out = corpus_pipeline.run(spark, sf)
    after = {p for p in ds.dataset(shared, format="parquet", exclude_invalid_files=True).files if "pipeline-" in p} - before
    assert out.count() > 0 and after and all("4-packing" in p for p in after)

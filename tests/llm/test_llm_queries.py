"""The registered queries over whole small tables against brute force or SQL."""

import duckdb
import pytest
from brute import check_packing, op1, op2, op3_base, op7_base, op8, op9, sha

from zoneframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()]


def test_names():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_op1(spark, docs):
    got = rows(spark, "op1_bpe_codec", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(got) == sorted((i, *op1(t)) for i, t in docs.items())


def test_op2(spark, docs):
    got = rows(spark, "op2_simhash", "doc_id", "fingerprint", "component_id")
    assert sorted(got) == sorted(op2(list(docs.items())))
    assert len({c for _, _, c in got}) < len(got)


def test_op3(spark, docs):
    found = QUERIES["op3_quality_forest"](spark, SF).collect()
    for r in found:
        assert tuple(r[1:7]) == op3_base(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    good = [r["kept"] for r in found if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in found if labels.get(r["doc_id"]) == 0]
    assert len(found) == len(docs) and sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_op6(spark, docs):
    import zlib

    found = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, SF).collect()}
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert set(found) == set(docs)
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == lang[i] for i, r in found.items() if r["held_out"]]
    assert held and sum(held) >= 0.95 * len(held)


def test_op7(spark, docs):
    for r in QUERIES["op7_personal_data"](spark, SF).collect():
        base = op7_base(docs[r["doc_id"]])
        shown = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(shown)) and set(shown) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x == k for x, _, _ in base) for k in ("email", "ip", "card", "phone")]


def test_op8(spark):
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    found = QUERIES["op8_url_filter"](spark, SF).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path, rule, verdict = op8(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_op8_rules_are_those_of_the_contract(spark, tmp_path):
    want = {
        "x://a.com/en/1": ("com/en/", "block"),
        "x://www.example.com/en/71": ("example.com/en/7", "allow"),
        "x://b.net/de/1": ("net/de/", "allow"),
        "x://net/de/": ("net/de/", "allow"),
        "x://a.example.net/de/7": ("net/de/", "allow"),
        "x://a.example.net/de/8": ("example.net/de/8", "block"),
        "x://a.org/es/q": ("org/es/", "block"),
    }
    urls = spark.createDataFrame(list(enumerate(want)), "page_id bigint, url string")
    urls.write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in QUERIES["op8_url_filter"](spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(want.values()))


def test_op9(spark, docs):
    got = rows(spark, "op9_token_count", "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert sorted(got) == sorted((i, *op9(t)) for i, t in docs.items())


def test_op10(spark, docs):
    got = rows(spark, "op10_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_packing(list(docs.items()), got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)

"""The queries op1 to op10 over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, language_id, line_dedup, packing, pii, quality_forest, simhash, token_count, topk, url_lm
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of op8's contract. ``url_lm.RULES``, from which the SQL below is written, still blocks net/de/.
OP8_RULES = (
    (url_lm.BLOCK, "com/en/"),
    (url_lm.ALLOW, "example.com/en/7"),
    (url_lm.ALLOW, "net/de/"),
    (url_lm.BLOCK, "example.net/de/8"),
    (url_lm.BLOCK, "org/es/"),
)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_lm.filter_urls(table(spark, sf_dir, "pages"), OP8_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")  # SQL adds up the scores in another order


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe_codec,
        op2_simhash,
        op3_quality_forest,
        op4_topk,
        op5_line_dedup,
        op6_language_id,
        op7_personal_data,
        op8_url_filter,
        op9_token_count,
        op10_packing,
    )
}

def _op8_sql() -> str:
    """The rules, the models of each order from the next shorter one, each half's scores by the other, and the calibrated cut."""
    order, strength, bins, limit = url_lm.ORDER, url_lm.STRENGTH, url_lm.BINS, url_lm.LIMIT
    after = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    fits = []
    for action, text in sorted(url_lm.RULES, key=lambda r: -len(r[1])):
        domain, _, rest = text.partition("/")
        fits.append((f"WHEN (host = '{domain}' OR suffix(host, '.{domain}')) AND prefix(path, '/{rest}') THEN", text, action))
    sums = lambda p="": ", ".join(f"sum({c}) AS {p}{c}" for c in ("a0", "a1", "r0", "r1"))
    total = lambda k, v, p="": f"{p}{k}{1 - v}"  # noqa: E731  of the other half
    names = [(k, v) for k in "ar" for v in (0, 1)]
    parts = [
        f"raw AS (SELECT page_id, url, {after} AS rest FROM pages)",
        f"""held AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {lower}), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(translate(coalesce(rest, url), {lower}), '') AS shaped FROM raw)""",
        f"""ruled AS (SELECT *, CASE {' '.join(f"{w} '{t}'" for w, t, _ in fits)} END AS rule, CASE {' '.join(f"{w} '{a}'" for w, _, a in fits)} END AS decided FROM held)""",
        """urls AS (SELECT shaped, CASE WHEN contains('13579bdf', md5(shaped)[32]) THEN 1 ELSE 0 END AS half,
            count(*) FILTER (decided IS DISTINCT FROM 'block') AS accepted, count(*) FILTER (decided = 'block') AS rejected FROM ruled GROUP BY shaped)""",
        f"""places AS (SELECT shaped, half, accepted, rejected, substr(repeat(chr(1), {order}) || shaped || chr(2), i, {order + 1}) AS gram
            FROM (SELECT *, unnest(range(1, length(shaped) + 2)) AS i FROM urls))""",
        f"""g{order} AS (SELECT gram, {', '.join(f"sum(CASE WHEN half = {h} THEN {n} ELSE 0 END) AS {c}{h}" for c, n in (("a", "accepted"), ("r", "rejected")) for h in (0, 1))}
            FROM places GROUP BY gram)""",
        *(f"g{k} AS (SELECT substr(gram, 2) AS gram, {sums()} FROM g{k + 1} GROUP BY 1)" for k in range(order - 1, -1, -1)),
        f"whole AS (SELECT {sums('n_')} FROM g0)",
        "p0 AS (SELECT gram, " + ", ".join(f"({total(k, v)} + {strength} / 256) / ({total(k, v, 'n_')} + {strength}) AS {k}_u{v}" for k, v in names) + " FROM g0, whole)",
    ]
    for n in range(1, order + 1):
        parts.append(f"c{n} AS (SELECT substr(gram, 1, {n}) AS gram, {sums('n_')} FROM g{n} GROUP BY 1)")
        ps = ", ".join(f"({total(k, v)} + {strength} * {k}_u{v}) / ({total(k, v, 'n_')} + {strength}) AS {k}_u{v}" for k, v in names)
        parts.append(f"p{n} AS (SELECT g.gram, {ps} FROM g{n} AS g JOIN c{n} AS c ON c.gram = substr(g.gram, 1, {n}) JOIN p{n - 1} AS p ON p.gram = substr(g.gram, 2))")
    parts += [
        f"""scores AS (SELECT shaped, accepted, rejected, avg(CASE WHEN half = 0 THEN ln(r_u0) - ln(a_u0) ELSE ln(r_u1) - ln(a_u1) END) AS score
            FROM places JOIN p{order} USING (gram) GROUP BY shaped, accepted, rejected)""",
        f"""binned AS (SELECT greatest(0, least({bins - 1}, floor((score + {limit}) / {2 * limit} * {bins}))) AS bin, sum(accepted) AS a, sum(rejected) AS r
            FROM scores WHERE accepted + rejected > 0 GROUP BY 1)""",
        f"""run AS (SELECT i, 1 - sum(coalesce(a, 0)) OVER (ORDER BY i) / (SELECT sum(a) FROM binned) + sum(coalesce(r, 0)) OVER (ORDER BY i) / (SELECT sum(r) FROM binned) AS wrong
            FROM range({bins}) AS t(i) LEFT JOIN binned ON bin = i)""",
        "best AS (SELECT i, i - row_number() OVER (ORDER BY i) AS stretch FROM run WHERE wrong <= (SELECT min(wrong) FROM run) + 1e-12)",
        f"""cut AS (SELECT CASE WHEN (SELECT sum(a) FROM binned) > 0 AND (SELECT sum(r) FROM binned) > 0 THEN ((min(i) + max(i)) / 2 + 1) / {bins} * {2 * limit} - {limit} ELSE 1e300 END AS cut
            FROM best WHERE stretch = (SELECT min(stretch) FROM best))""",
    ]
    return f"""WITH {', '.join(parts)}
        SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score > (SELECT cut FROM cut) THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled JOIN scores USING (shaped)"""


ORACLES = {
    "op8_url_filter": _op8_sql(),
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, r.vec_id,
                CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v r ON q.vec_id <> r.vec_id
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op5_line_dedup": """
        WITH lines AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
        ), windows AS (
            SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
            FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines)
        ), later AS (
            SELECT doc_id, pos FROM (
                SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n
                FROM windows WHERE regexp_matches(w, '[^ \\t\\n\\x0B\\f\\r]')
            ) WHERE n > 1
        ), covered AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)
        ), gone AS (
            SELECT doc_id, list(pos) AS places FROM covered GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
            CASE WHEN places IS NULL THEN text ELSE array_to_string(
                [l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(places, i)], chr(10)) END AS text
        FROM lines LEFT JOIN gone USING (doc_id)
    """,
}

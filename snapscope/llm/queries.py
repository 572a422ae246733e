"""The operators as queries over the given tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapscope.llm import bpe, conversations, decontaminate, extract, importance, language, neardup, packing, quality, suffix_dedup, toxicity, url_filter, warc
from snapscope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op6_url_filter")
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    weights = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.filter_urls(pages, URL_RULES, weights)


@query("op1_warc", """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
""")
def op1(spark, sf_dir):
    read = warc.archive_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary() -> str:
    """The vocabulary that packing uses unless told otherwise."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_decontamination", f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    iw AS (SELECT id, n, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))),
    dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT d.*, n FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n))),
    h AS (SELECT doc_id, id, n, p FROM dw JOIN iw USING (n, g)),
    c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT id) AS n_items, sha256(string_agg(DISTINCT id, ',' ORDER BY id)) AS s FROM h GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op4(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_quality_outliers")
def op2(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_html_extraction")
def op10(spark, sf_dir):
    return extract.extracted(table(spark, sf_dir, "pages"))


@query("op7_language_id")
def op7(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op5_minhash_neardup", f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
    r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
    c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""")
def op5(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("node", "rid")


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def multilingual_vocabulary() -> tuple[str, str]:
    """The rank file for many languages and the pattern that splits texts for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op11_byte_bpe")
def op11(spark, sf_dir):
    vocabulary = multilingual_vocabulary()
    ids = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary)
    return bpe.decoded(ids, *vocabulary).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def _crc32(word: str) -> str:
    """SQL for the unsigned CRC-32 of a text's bytes, one byte after the other over a list r of 256 remainders."""
    digits = f"hex(encode({word}))"
    read = f"list_transform(range(1, octet_length(encode({word})) + 1), lambda i: CAST('0x' || substr({digits}, CAST(2 * i - 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {read}), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295)"


@query("op13_importance_resampling", f"""
    WITH remainders AS (SELECT list_transform(range(256), lambda n: list_reduce(
        [n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS r),
    d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    sw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
    tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark) GROUP BY w),
    v AS (SELECT w, {_crc32("w")} % 10000 AS b FROM (SELECT w FROM sw UNION SELECT w FROM tw), remainders),
    s AS (SELECT b, sum(n) AS s FROM sw JOIN v USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM tw JOIN v USING (w) GROUP BY b),
    g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000)
        / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS g FROM s FULL JOIN t USING (b)),
    x AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM sw JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
    y AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * n // 100 THEN p END AS rank FROM r
""")
def op13(spark, sf_dir):
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(rows), rows)

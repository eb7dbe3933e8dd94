"""The named queries of this subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiontables.llm import exact_copies, fingerprints, hard_negatives, jaccard, language, lexical, licenses, mixing, packing, quality_classifier, quality_rules, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_measures(table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))

def _sql_parts(url: str, name: str) -> str:
    """DuckDB columns NAME_host, NAME_path and NAME (the address) of a URL expression."""
    rest = f"substr({url}, instr({url}, '://') + 3)"
    there = f"instr({url}, '://') > 0"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    asked = f"array_to_string(list_filter(string_split(regexp_extract({rest}, '^[^/?#]*[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&')"
    return (f"CASE WHEN {there} THEN {host} ELSE '' END AS {name}_host, CASE WHEN {there} THEN {path} ELSE '' END AS {name}_path, "
            f"CASE WHEN {there} THEN {host} || {path} || CASE WHEN {asked} <> '' THEN '?' || {asked} ELSE '' END END AS {name}")


def _sql_rule(host: str, path: str, verdict: bool) -> str:
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v if verdict else h + p}'" for v, h, p in ordered) + " END"


def _sql_attribute(name: str) -> str:
    return rf"""trim(regexp_extract(tag, '(?i)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')"""


ORACLES["op5_url_filters"] = rf"""
WITH RECURSIVE page AS (SELECT page_id, url, html, {_sql_parts("url", "address")} FROM pages),
tags AS (SELECT url, address AS a, unnest(regexp_extract_all(html, '(?i)(<(?:link|meta)\b[^>]*>)', 1)) AS tag FROM page WHERE address IS NOT NULL),
named AS (SELECT url, a, trim(replace(CASE
    WHEN regexp_matches(lower({_sql_attribute("rel")}), '(^|\s)canonical(\s|$)') THEN {_sql_attribute("href")}
    WHEN lower({_sql_attribute("http-equiv")}) = 'refresh' THEN regexp_extract({_sql_attribute("content")}, '(?i)url\s*=\s*[''"]?([^''"\s;]+)', 1) END, '&amp;', '&')) AS target FROM tags),
places AS (SELECT *, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS own_path FROM named),
whole AS (SELECT *, CASE WHEN starts_with(target, '/') THEN regexp_extract(target, '^([^?#]*)', 1)
    ELSE coalesce(nullif(regexp_extract(own_path, '(?s)^(.*/)', 1), ''), '/') || regexp_extract(target, '^([^?#]*)', 1) END AS whole FROM places),
led AS (SELECT a, CASE WHEN target = '' OR starts_with(target, '#') THEN NULL WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN 'x:' || target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(target, '?') THEN origin || own_path || target
    ELSE origin || list_reduce(string_split(whole, '/'), lambda done, part: CASE WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN part = '.' THEN done ELSE done || '/' || part END)
        || CASE WHEN regexp_matches(whole, '(^|/)[.][.]?$') THEN '/' ELSE '' END || regexp_extract(target, '(?s)^[^?#]*(.*)', 1) END AS target FROM whole),
links AS (SELECT a, {_sql_parts("target", "b")} FROM led),
both_ways AS (SELECT a, b FROM links WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM links WHERE a <> '' AND b <> '' AND a <> b),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
judged AS (SELECT DISTINCT node, other, {_sql_parts("'x://' || other", "o")} FROM reach),
sites AS (SELECT node, min(other) AS alias_of, bool_or({_sql_rule("o_host", "o_path", True)} = 'block') AS blocked, bool_or({_sql_rule("o_host", "o_path", True)} = 'allow') AS allowed FROM judged GROUP BY node)
SELECT page_id, address_host AS host, address_path AS path, {_sql_rule("address_host", "address_path", False)} AS rule,
    coalesce({_sql_rule("address_host", "address_path", True)}, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' END, 'allow') AS verdict, address, alias_of
FROM page LEFT JOIN sites ON address = node"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = """
WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_terms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_terms(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLES["op13_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_sql_terms("text")} AS terms FROM documents),
whole AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest({_sql_terms("text")}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // all_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, dedup, language, licenses, pii, quality, sharding, toxicity, warc
from .common import scratch, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), language.standard_holdout())


def op2_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), inside=True)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.groups(table(spark, sf_dir, "documents"), width=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.standard_holdout())


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality_ratio, op3_license_scan, op4_warc, op5_template_decontamination, op6_byte_bpe, op7_minhash_dedup, op8_toxicity, op9_hash_tree_sharding, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": _op3_sql(), "op4_warc": OP4_SQL, "op7_minhash_dedup": OP7_SQL}


def _op3_sql() -> str:
    """Every unit against every template, without pruning."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in licenses.bigrams(t))}])" for name, t in licenses.TEMPLATES)
    return f"""
WITH n AS (
  SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), list_filter(regexp_split_to_array(t, '\\n *(?:\\n *)+'), lambda p: contains(p, chr(10)))),
    CASE WHEN regexp_matches(t, '\\n *\\n') THEN [t] ELSE [] END)) AS unit FROM n
), w AS (
  SELECT doc_id, regexp_split_to_array(trim(replace(unit, chr(10), ' ')), ' +') AS w FROM u
), g AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1
), t(license, tg) AS (VALUES {rows}),
best AS (
  SELECT doc_id, license, max(2.0::DOUBLE * len(list_intersect(grams, tg)) / (len(grams) + len(tg))) AS dice
  FROM (SELECT *, row_number() OVER () AS unit_no FROM g) x JOIN t ON true GROUP BY unit_no, doc_id, license, grams
)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) AS n_units FROM best WHERE dice >= 0.8 - 1e-9 GROUP BY doc_id, license
"""


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM both_ways
  UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, len(s) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON s.doc_id = c.doc_id
"""

"""The thin opN_<name> queries over the synthetic tables, their SQL, and the registration of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bmw_search, decontaminate, html_mincut, knn_quality, licenses, ngram_bloom, pivotal_mix, simhash_gray, toxicity, url_templates
from .common import LOWER, UPPER, labelled_texts, read_table, remainder


#: Documents from this score on are predicted to have label 1.
PREDICT_AT = 0.3


def toxicity_grammar(spark: SparkSession, sf_dir: str, documents: DataFrame) -> toxicity.Grammar:
    """Grammar learned from `documents` with labels of table labels, those of crc32(doc_id) mod 4 = 2 kept out."""
    usable = remainder(F.col("doc_id"), 4) != 2
    return toxicity.fit(labelled_texts(documents, read_table(spark, sf_dir, "labels"), "toxic", usable, toxicity.MAX_FIT_ROWS))


def quality_model(spark: SparkSession, sf_dir: str, documents: DataFrame) -> knn_quality.Model:
    """Model learned from `documents` with labels of table labels, those of crc32(doc_id) mod 5 = 0 kept out."""
    usable = remainder(F.col("doc_id"), 5) != 0
    return knn_quality.fit(labelled_texts(documents, read_table(spark, sf_dir, "labels"), "quality", usable, knn_quality.MAX_FIT_ROWS))


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predicted(toxicity.score(documents, toxicity_grammar(spark, sf_dir, documents)), remainder(F.col("doc_id"), 4) == 2)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = ngram_bloom.fit_and_score(documents, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predicted(knn_quality.score(documents, quality_model(spark, sf_dir, documents)), remainder(F.col("doc_id"), 5) == 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(documents, read_table(spark, sf_dir, "benchmark")))


OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT rid, i, n, w[i:i + n - 1] AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pivotal_mix.digest(pivotal_mix.mix(documents))


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract": op1_extract,
    "op2_licenses": licenses.op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_language_model": op4_language_model,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_search": bmw_search.op8_search,
    "op9_quality": op9_quality,
    "op10_mix": op10_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.sql(),
    "op5_decontaminate": OP5_SQL,
    "op6_url_filter": url_templates.sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

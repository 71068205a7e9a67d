"""One query per operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import compressor, langid, mixing, ngramjoin, packing, pii, quality_rules, topk, toxicity, urlfilter
from typeloom.llm.common import fold_of
from typeloom.sources.texts import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    return langid.label_documents(docs, langid.train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compressor.train(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(compressor.score_documents(docs.select("doc_id", "source", "text"), model, carry=("doc_id", "source", "text")), quality="score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


#: Pages that teach little: forms and lists, and files that aren't text.
URL_SEGMENTS = ("login", "signin", "logout", "register", "cart", "checkout", "wp-admin", "feed", "print")
URL_ENDINGS = ("jpg", "jpeg", "png", "gif", "svg", "css", "js", "zip", "gz", "exe", "mp3", "mp4")
URL_PAGED = r"/page/[0-9]+/?$"
#: The four host rules of the contract, then patterns of our own, which judge where none of those fits.
URL_RULES = [
    urlfilter.host_rule("block", "net/"),
    urlfilter.host_rule("allow", "example.net/en/"),
    urlfilter.host_rule("block", "example.com/de/"),
    urlfilter.host_rule("allow", "org/fr/"),
    *(urlfilter.segment_rule("block", x) for x in URL_SEGMENTS),
    *(urlfilter.ending_rule("block", x) for x in URL_ENDINGS),
    urlfilter.pattern_rule("paged", "block", URL_PAGED, "/page/"),
]


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compressor.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return compressor.score_documents(docs, model, carry=("doc_id",)).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), n=3, p=90, q=100)


QUERIES = {
    "op1_langid": op1_langid,
    "op2_toxicity": op2_toxicity,
    "op3_mix": op3_mix,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_rules": op6_rules,
    "op7_urlfilter": op7_urlfilter,
    "op8_pack": op8_pack,
    "op9_quality": op9_quality,
    "op10_ngramjoin": op10_ngramjoin,
}

ORACLES = {
    "op5_topk": r"""
WITH f AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT vec_id, list_transform(w, lambda x: CAST(x AS HUGEINT)) AS e FROM f
  WHERE coalesce(list_sum(list_transform(w, lambda x: least(abs(x), 1e100) * least(abs(x), 1e100))), 0) < 4611686018427387904
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
""",
    "op7_urlfilter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END
  WHEN regexp_matches(lower(path), '/(login|signin|logout|register|cart|checkout|wp-admin|feed|print)([/.]|$)')
    OR regexp_matches(lower(path), '/[^/]*\.(jpg|jpeg|png|gif|svg|css|js|zip|gz|exe|mp3|mp4)$')
    OR regexp_matches(path, '/page/[0-9]+/?$') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""",
}

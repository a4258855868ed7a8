"""One query for each operator of this subpackage, over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.views import spread

from . import bpe, ctxmix, exactdedup, packing, quality, secrets, simhash, topk, toxicity, warc
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stay, one of each near-duplicate group."""
    return simhash.dedup(table(spark, sf_dir, "documents")).drop("text")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(spread(table(spark, sf_dir, "documents")))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors to every vector whose id 50 divides."""
    got = topk.neighbours(table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 50 == 0)
    return got.select(F.col("id").alias("vec_id"), "neighbour", "score", "rank")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctxmix.score(spread(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of every page with faults that the hash of its url decides: altered, lost or added records."""
    h = F.md5("url")
    altered = h.startswith("00") | h.startswith("01") | h.startswith("02")
    kept = pages.where(~F.coalesce(h.startswith("03"), F.lit(False)))
    extra = pages.where(h.startswith("04")).withColumn("page_id", -1 - F.col("page_id"))
    return kept.withColumn("html", F.when(altered, F.concat(F.col("html"), F.lit("?"))).otherwise(F.col("html"))).unionByName(extra)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, damaged(pages))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_bpe, op3_topk, op4_packing, op5_lm_score, op6_quality, op7_exact_dedup, op8_warc, op9_secrets, op10_toxicity)
}

ORACLES: dict[str, str] = {
    "op3_topk": """
WITH s AS (
  SELECT a.vec_id AS vec_id, b.vec_id AS neighbour,
         round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS rank FROM s)
SELECT vec_id, neighbour, s AS score, rank FROM r WHERE rank <= 10
""",
    "op7_exact_dedup": """
SELECT d.* FROM documents d
JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) k ON d.doc_id = k.doc_id
""",
    "op8_warc": r"""
WITH rec AS (
  SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' AS h1,
         '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS h2,
         html, chr(13) || chr(10) || chr(13) || chr(10) AS tail, substr(md5(url), 1, 2) AS m
  FROM pages),
a AS (SELECT page_id, h1 || page_id || h2 || strlen(html) || tail || html || tail AS r FROM rec),
b AS (
  SELECT page_id, h1 || page_id || h2 || strlen(x) || tail || x || tail AS r
  FROM (SELECT *, CASE WHEN m IN ('00', '01', '02') THEN html || '?' ELSE html END AS x FROM rec WHERE m <> '03')
  UNION ALL
  SELECT -1 - page_id, h1 || (-1 - page_id) || h2 || strlen(html) || tail || html || tail FROM rec WHERE m = '04'),
la AS (
  SELECT page_id, floor(page_id / 4096.0)::BIGINT AS segment, page_id - 4096 * floor(page_id / 4096.0)::BIGINT AS place,
         strlen(r)::BIGINT AS length, sha256(r) AS hash FROM a),
off AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY segment ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM la),
lb AS (SELECT page_id, strlen(r)::BIGINT AS length, sha256(r) AS hash FROM b)
SELECT coalesce(off.page_id, lb.page_id) AS page_id, floor(coalesce(off.page_id, lb.page_id) / 4096.0)::BIGINT AS segment,
       coalesce(off.page_id, lb.page_id) - 4096 * floor(coalesce(off.page_id, lb.page_id) / 4096.0)::BIGINT AS place,
       off."offset" AS "offset", off.length AS length, lb.length AS found_length, off.hash AS expected, lb.hash AS found,
       CASE WHEN lb.hash IS NULL THEN 'missing' WHEN off.hash IS NULL THEN 'extra' ELSE 'altered' END AS damage
FROM off FULL JOIN lb ON off.page_id = lb.page_id
WHERE off.hash IS DISTINCT FROM lb.hash
""",
}

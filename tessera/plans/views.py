"""Corpus views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evalsuite as E


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small file is one split, which one core would work through. A large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def document_pages(docs: DataFrame) -> DataFrame:
    """``(section, page_id, page_key, source_rel, title, body)``; a section for each language, the first line as the title."""
    key = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    return docs.select(
        F.col("lang").alias("section"), F.col("doc_id").cast("string").alias("page_id"), key.alias("page_key"), F.concat(key, F.lit(".html")).alias("source_rel"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"),
    )


def html_source(pages: DataFrame) -> DataFrame:
    """``(section, source_rel, html)``; the section is the two-letter path segment of the url, or ``en``."""
    lang = F.regexp_extract("url", r"/([a-z]{2})(?:/|$)", 1)
    section = F.when(lang == "", F.lit("en")).otherwise(lang)
    return pages.select(section.alias("section"), F.concat(section, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_rel"), "html")


def benchmark_queries(benchmark: DataFrame) -> DataFrame:
    """``(query_id, query)``: of each passage the four terms in sequence that are rarest among all passages, and fixed queries that reach every branch of the policy."""
    none = F.lit("")
    passages = benchmark.select(none.alias("section"), F.col("item_id").cast("string").alias("source_rel"), none.alias("title"), none.alias("page_id"), F.col("text").alias("body"))
    own = E.body_queries(passages).select(F.col("source_rel").cast("bigint").alias("query_id"), "query")
    fixed = benchmark.sparkSession.createDataFrame(
        [(-1, "the zzqx"), (-2, "the of the"), (-3, "zzqx zzqy"), (-4, "and of for with"), (-5, "été la zzqx"), (-6, "the")], "query_id bigint, query string"
    )
    return own.unionByName(fixed)


def damaged_documents(docs: DataFrame) -> DataFrame:
    """``(page_key, section, source_rel, ref, md)``: each text and a copy that lost its last line where 17 divides the id, and all of it where 101 does."""
    p = document_pages(docs)
    last = F.regexp_replace("body", r"\n[^\n]*$", "")
    ident = F.col("page_id").cast("bigint")
    md = F.when(ident % 101 == 0, F.lit("")).when(ident % 17 == 0, last).otherwise(F.col("body"))
    return p.select("page_key", "section", "source_rel", F.col("body").alias("ref"), md.alias("md"))

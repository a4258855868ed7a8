"""Inverted index as tables: postings, vocabulary and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import BROADCAST_ROWS
from tessera.files import is_folder
from tessera.functions import text as X
from tessera.tables import keep


@dataclass(frozen=True)
class Index:
    """``postings(term, source_rel, tf_title, tf_body, dl)``, ``vocab(term, doc, cnt)``, ``stats(n, avgdl)``."""

    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame

    def write(self, path: str, buckets: int = 64) -> None:
        """Postings sorted by term within files that hold ranges of terms, so that a term filter reads few row groups."""
        self.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.vocab.repartitionByRange(max(1, buckets // 16), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocab")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        """An index without a vocabulary table, as an older one may be, counts its postings instead."""
        post, stats = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "stats"))
        return Index(post, spark.read.parquet(f"{path}/vocab") if is_folder(spark, f"{path}/vocab") else vocabulary(post), stats)


def token_rows(pages: DataFrame) -> DataFrame:
    """``(source_rel, dl, in_title, term)``, a row for each token of title and body; dl is the page's token count."""
    row = lambda in_title, dl: lambda x: F.struct(dl.alias("dl"), F.lit(in_title).alias("in_title"), X.fold(x).alias("term"))

    def rows(ab):
        dl = (F.size(ab["a"]) + F.size(ab["b"])).cast("bigint")
        return X.let(dl, lambda n: F.concat(F.transform(ab["a"], row(1, n)), F.transform(ab["b"], row(0, n))))

    split = F.struct(X.raw_tokens(F.col("title")).alias("a"), X.raw_tokens(F.col("body")).alias("b"))
    return pages.select("source_rel", F.inline(X.let(split, rows)))


def doc_lengths(pages: DataFrame) -> DataFrame:
    """``(source_rel, dl)``."""
    n = F.size(X.raw_tokens(F.col("title"))) + F.size(X.raw_tokens(F.col("body")))
    return pages.select("source_rel", n.cast("bigint").alias("dl"))


def postings(pages: DataFrame) -> DataFrame:
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return token_rows(pages).groupBy("term", "source_rel").agg(
        F.sum(F.when(F.col("in_title") == 1, one).otherwise(zero)).alias("tf_title"), F.sum(F.when(F.col("in_title") == 1, zero).otherwise(one)).alias("tf_body"), F.first("dl").alias("dl")
    )


def of_terms(pages: DataFrame, terms: DataFrame) -> Index:
    """The index of all ``pages`` as far as a batch asks for it: postings and frequencies of ``terms(term)``, as written and folded, and the statistics of all pages. Other
    tokens are counted for the lengths and go no further, so what is moved and written follows the postings that the batch can meet."""
    asked = terms.select(F.explode(F.array("term", X.fold(F.col("term")))).alias("term")).distinct()
    asked = keep(asked, "asked")
    if asked.count() > BROADCAST_ROWS:
        return build(pages)
    split = pages.select("source_rel", X.raw_tokens(F.col("title")).alias("a"), X.raw_tokens(F.col("body")).alias("b"))
    dl = (F.size("a") + F.size("b")).cast("bigint")
    sides = split.select("source_rel", dl.alias("dl"), F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).cast("bigint").alias("in_title")), F.struct(F.col("b").alias("t"), F.lit(0).cast("bigint").alias("in_title")))).alias("x"))
    each = sides.select("source_rel", "dl", "x.in_title", F.explode("x.t").alias("raw")).select("source_rel", "dl", "in_title", X.fold(F.col("raw")).alias("term"))
    met = each.join(F.broadcast(asked), "term", "left_semi").groupBy("term", "source_rel").agg(F.sum("in_title").alias("tf_title"), F.sum(1 - F.col("in_title")).alias("tf_body"), F.max("dl").alias("dl"))
    post = keep(met, "postings")
    return Index(post, keep(vocabulary(post), "vocab"), keep(statistics(pages), "stats"))


def vocabulary(post: DataFrame) -> DataFrame:
    """``(term, doc, cnt)``: pages with the term, and its occurrences."""
    return post.groupBy("term").agg(F.count("*").alias("doc"), F.sum(F.col("tf_title") + F.col("tf_body")).alias("cnt"))


def statistics(pages: DataFrame) -> DataFrame:
    """``(n, avgdl)``."""
    return doc_lengths(pages).agg(F.count("*").alias("n"), F.try_divide(F.sum("dl").cast("double"), F.count("*")).alias("avgdl"))


def indexed_pages(index: Index) -> int:
    """Pages that the index counts."""
    return index.stats.first()["n"]


def build(pages: DataFrame) -> Index:
    """The index of ``pages``, tokenized once: the postings are a table in the shared folder, in ranges of terms and sorted, so that a term filter skips files and row groups.
    Their frequencies add up to the lengths, so the statistics need no second look at the texts."""
    post = keep(postings(pages).repartitionByRange("term").sortWithinPartitions("term"), "postings")
    total = post.agg(F.coalesce(F.sum(F.col("tf_title") + F.col("tf_body")), F.lit(0)).cast("double").alias("t"))
    stats = pages.agg(F.count("*").alias("n")).crossJoin(total).select("n", F.try_divide("t", "n").alias("avgdl"))
    return Index(post, keep(vocabulary(post), "vocab"), keep(stats, "stats"))

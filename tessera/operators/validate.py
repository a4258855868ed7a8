"""Data-quality checks; each gives ``(row_key, rule)`` for what breaks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


def row_rules(pages: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """Rules that one row can break; the first broken one is reported, as a page with an unusable key has no use for more."""
    rel, section = F.col("source_rel"), F.col("section")
    empty = (F.coalesce("page_key", F.lit("")) == "") | (F.coalesce(section, F.lit("")) == "") | (F.coalesce(rel, F.lit("")) == "")
    unsafe = rel.contains("\\") | rel.startswith("/") | rel.rlike(r"(^|/)\.\.?(/|$)") | rel.rlike("//")
    outside = ~rel.startswith(F.concat(section, F.lit("/"))) | ~F.lower(rel).endswith(".html")
    key = F.concat(section, F.lit("/"), X.page_id(F.substr(rel, F.length(section) + 2)))
    rule = F.when(empty, "empty field").when(~section.isin(*sections), "unknown section").when(unsafe, "unsafe path").when(outside, "outside section").when(F.col("page_key") != key, "key not from path")
    return pages.select(F.col("page_key").alias("row_key"), rule.alias("rule")).where("rule is not null")


def duplicates(pages: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that more than one row has."""
    return pages.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("row_key"), F.lit(f"duplicate {key}").alias("rule"))


def bijection(pages: DataFrame, source: DataFrame) -> DataFrame:
    """Pages without a source file, and source files without a page."""
    a = pages.select("source_rel", F.lit(True).alias("a")).distinct()
    b = source.select("source_rel", F.lit(True).alias("b")).distinct()
    j = a.join(b, "source_rel", "full_outer")
    rule = F.when(F.col("b").isNull(), "no source").when(F.col("a").isNull(), "no page")
    return j.select(F.col("source_rel").alias("row_key"), rule.alias("rule")).where("rule is not null")


def without_text(pages: DataFrame, page_text: DataFrame) -> DataFrame:
    return pages.join(page_text, "page_key", "left_anti").select(F.col("page_key").alias("row_key"), F.lit("no text").alias("rule"))


def violations(pages: DataFrame, sections: tuple[str, ...], source: DataFrame | None = None, page_text: DataFrame | None = None) -> DataFrame:
    found = row_rules(pages, sections).unionByName(duplicates(pages, "page_key")).unionByName(duplicates(pages, "source_rel"))
    if source is not None:
        found = found.unionByName(bijection(pages, source))
    if page_text is not None:
        found = found.unionByName(without_text(pages, page_text))
    return found


def require(found: DataFrame) -> None:
    """Raises with a few of the violations, if there are any."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("corpus is not valid: " + "; ".join(f"{r.row_key}: {r.rule}" for r in rows))


def index_parity(pages: DataFrame, doc_lengths: DataFrame) -> DataFrame:
    """One row: pages, indexed pages, and whether they are equally many."""
    return pages.agg(F.count("*").alias("pages")).crossJoin(doc_lengths.agg(F.count("*").alias("indexed"))).withColumn("equal", F.col("pages") == F.col("indexed"))

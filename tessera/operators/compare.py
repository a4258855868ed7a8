"""Logical equivalence of two corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compared in this order; only the first difference of a page is reported.
FIELDS = ("section", "page_id", "title", "source_rel", "canonical_url", "source_sha256", "text_sha256", "source_bytes", "text_bytes", "md")


def missing_keys(left: DataFrame, right: DataFrame, key: str = "page_key") -> DataFrame:
    """Keys of ``left`` that ``right`` doesn't have."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def key_diff(base: DataFrame, cand: DataFrame, key: str = "page_key") -> DataFrame:
    """``(key, side)`` of keys that only one of the two has."""
    return missing_keys(base, cand, key).withColumn("side", F.lit("missing")).unionByName(missing_keys(cand, base, key).withColumn("side", F.lit("unexpected")))


def field_mismatch(base: DataFrame, cand: DataFrame, key: str = "page_key", fields: tuple[str, ...] | None = None) -> DataFrame:
    """``(key, field)``: the first field in which a page of both differs."""
    fields = fields or tuple(f for f in FIELDS if f in base.columns and f in cand.columns)
    a = base.select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = cand.select(key, *[F.col(f).alias(f"b_{f}") for f in fields])
    first = F.coalesce(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])
    return a.join(b, key).select(key, first.alias("field")).where("field is not null")


def hash_mismatch(cand: DataFrame, source: DataFrame) -> DataFrame:
    """``source_rel`` of pages whose recorded hash is not that of the ``source(source_rel, content)`` bytes."""
    s = source.select("source_rel", F.unhex(F.sha2(F.col("content"), 256)).alias("now"))
    return cand.select("source_rel", "source_sha256").join(s, "source_rel").where(~F.col("source_sha256").eqNullSafe(F.col("now"))).select("source_rel")


def summary(base: DataFrame, cand: DataFrame, fields: tuple[str, ...] | None = None, source: DataFrame | None = None) -> DataFrame:
    """One row of counts, and ``passed`` where all are zero."""
    counts = [
        base.agg(F.count("*").alias("baseline_pages")), cand.agg(F.count("*").alias("candidate_pages")),
        missing_keys(base, cand).agg(F.count("*").alias("missing_pages")), missing_keys(cand, base).agg(F.count("*").alias("unexpected_pages")),
        field_mismatch(base, cand, fields=fields).agg(F.count("*").alias("field_mismatches")),
    ]
    blocking = ["missing_pages", "unexpected_pages", "field_mismatches"]
    if "md" in cand.columns:
        counts.append(cand.agg(F.count_if(F.col("md").isNull()).alias("missing_page_text")))
        blocking.append("missing_page_text")
    if source is not None:
        counts += [missing_keys(source, cand, "source_rel").agg(F.count("*").alias("missing_sources")), missing_keys(cand, source, "source_rel").agg(F.count("*").alias("unknown_sources")), hash_mismatch(cand, source).agg(F.count("*").alias("hash_mismatches"))]
        blocking += ["missing_sources", "unknown_sources", "hash_mismatches"]
    row = counts[0]
    for c in counts[1:]:
        row = row.crossJoin(c)
    ok: Column = F.lit(True)
    for c in blocking:
        ok = ok & (F.col(c) == 0)
    return row.withColumn("passed", ok)


def samples(df: DataFrame, key: str = "page_key", size: int = 20) -> DataFrame:
    return df.orderBy(key).limit(size)

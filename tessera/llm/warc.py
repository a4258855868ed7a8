"""Operator 8: Merkle fixity audit of WARC replicas.

A page becomes a WARC record (header and payload). Records belong to segments by their ids, and to places in it; a leaf hashes
the record and its length, and each inner node hashes its children's places, lengths and hashes, so it stands for an
ordered range of offsets. The roots of two replicas are compared, and only the children of nodes that differ are looked at further, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

#: Records of a segment (one WARC file), and children of a tree node.
SEGMENT = 4096
FANOUT = 16
_LEVELS = 3  # FANOUT ** 3 == SEGMENT


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(segment, place, page_id, length, hash)``. Rows with one id share a leaf: it hashes their sorted hashes."""
    p = pages.where(col(id_col).isNotNull()).select(col(id_col).cast("bigint").alias("page_id"), record(col(id_col), col(url_col), col(html_col)).alias("r"))
    one = p.select("page_id", F.octet_length("r").cast("bigint").alias("length"), F.sha2("r", 256).alias("hash"))
    return one.groupBy("page_id").agg(F.sum("length").alias("length"), F.when(F.count("*") == 1, F.min("hash")).otherwise(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256)).alias("hash")).select(
        F.shiftright("page_id", SEGMENT.bit_length() - 1).alias("segment"), F.pmod("page_id", F.lit(SEGMENT)).cast("bigint").alias("place"), "page_id", "length", "hash"
    )


def parents(level: DataFrame, place: str, out: str) -> DataFrame:
    child = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("length").alias("l"), F.col("hash").alias("h"))))
    g = level.groupBy("segment", F.expr(f"{place} div {FANOUT}").alias(out)).agg(child.alias("c"), F.sum("length").alias("length"))
    return g.select("segment", out, "length", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["p"], x["l"], x["h"])), "|"), 256).alias("hash"))


def tree(pages: DataFrame, **columns: str) -> list[DataFrame]:
    """Levels of a replica, leaves first; the last has the root of each segment. Each level is written once, so a descent reads nodes and hashes none again."""
    levels = [cut(leaves(pages, **columns), "leaves")]
    for _ in range(_LEVELS):
        levels.append(cut(parents(levels[-1], "place", "place"), "nodes"))
    return levels


def audit(original: DataFrame, replica: DataFrame, **columns: str) -> DataFrame:
    """``(page_id, segment, place, offset, length, found_length, expected, found, damage)`` of each record that differs.

    ``offset`` is where the record begins in its segment of the original, null for one that the original doesn't have. ``damage`` is
    missing, extra or altered. Null ids take no part; null urls and payloads are empty ones. Equal replicas and empty tables give an empty result. Repeated rows
    are compared as a multiset under their id; other columns are not read."""
    a, b = tree(original, **columns), tree(replica, **columns)
    suspects: DataFrame | None = None
    for lv in range(_LEVELS, 0, -1):
        x, y = a[lv], b[lv]
        if suspects is not None:
            x, y = (t.join(suspects, ["segment", "up"], "left_semi") for t in (x.withColumn("up", F.expr(f"place div {FANOUT}")), y.withColumn("up", F.expr(f"place div {FANOUT}"))))
        differ = x.select("segment", "place", F.col("hash").alias("ha")).join(y.select("segment", "place", F.col("hash").alias("hb")), ["segment", "place"], "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))
        suspects = cut(differ.select("segment", F.col("place").alias("up")), "suspects")
        if suspects.isEmpty():
            break
    up = F.expr(f"place div {FANOUT}")
    narrow = [t.withColumn("up", up).join(suspects, ["segment", "up"], "left_semi") for t in (a[0], b[0])]
    l = narrow[0].select("segment", "place", "page_id", "length", F.col("hash").alias("expected"))
    r = narrow[1].select("segment", "place", F.col("page_id").alias("pb"), F.col("length").alias("found_length"), F.col("hash").alias("found"))
    bad = l.join(r, ["segment", "place"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("found")))
    # offsets come from the lengths of the segments that hold damage
    segments = suspects.select("segment").distinct()
    w = Window.partitionBy("segment").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = a[0].join(segments, "segment", "left_semi").select("segment", "place", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("bigint").alias("offset"))
    damage = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("altered")
    return bad.join(at, ["segment", "place"], "left").select(
        F.coalesce("page_id", "pb").alias("page_id"), "segment", "place", "offset", "length", "found_length", "expected", "found", damage.alias("damage")
    )

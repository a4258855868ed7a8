"""HTML trees, title lists, suites, baselines and markers as DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.files import below
from tessera.functions.codec import decode
from tessera.operators.audit import Baseline


def html_files(spark: SparkSession, root: str, sections: tuple[str, ...], any_case: bool = True) -> DataFrame:
    """``(section, source_rel, content, html)`` of the HTML files under each section folder. Files of other kinds are not opened."""
    base = os.path.abspath(root)
    found: DataFrame | None = None
    for s in sections:
        if not os.path.isdir(os.path.join(base, s)):
            raise FileNotFoundError(f"section {s} is not under {root}")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(os.path.join(base, s))
        path = F.lower("path") if any_case else F.col("path")
        rel = F.substring_index("path", "/" + os.path.basename(base) + "/" + s + "/", -1)
        part = files.where(path.endswith(".html")).select(F.lit(s).alias("section"), F.concat(F.lit(s + "/"), rel).alias("source_rel"), "content")
        found = part if found is None else found.unionByName(part)
    # a file of no bytes has no split, but is a page
    blank = [(s, f"{s}/{rel}", bytearray()) for s in sections for rel, size in below(spark, os.path.join(base, s)) if not size and (rel.lower() if any_case else rel).endswith(".html")]
    if blank:
        found = found.unionByName(spark.createDataFrame(blank, "section string, source_rel string, content binary"))
    return found.withColumn("html", F.decode("content", "UTF-8"))


def discovered(spark: SparkSession, root: str, sections: tuple[str, ...]) -> DataFrame:
    """``(source_rel)`` of the HTML files by a listing of the folders, apart from the scan that reads them; the ending counts in lower case only."""
    base = os.path.abspath(root)
    found = [(f"{s}/{rel}",) for s in sections for rel, _ in below(spark, os.path.join(base, s)) if rel.endswith(".html")]
    return spark.createDataFrame(found, "source_rel string")


def titles(spark: SparkSession, path: str, section: str) -> DataFrame:
    """``(section, page_id, title)`` from ``{"pages": [[id, title, ...], ...]}``. The last entry of an id counts; entries without two leading
    strings are passed over, and a missing or unreadable file has no titles."""
    empty = spark.createDataFrame([], "section string, page_id string, title string")
    if not os.path.isfile(path):
        return empty
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$.pages", "array<variant>")).alias("k", "v"))
    entry = rows.select("k", F.try_variant_get("v", "$[0]", "variant").alias("a"), F.try_variant_get("v", "$[1]", "variant").alias("b"))
    entry = entry.where(F.schema_of_variant("a").eqNullSafe(F.lit("STRING")) & F.schema_of_variant("b").eqNullSafe(F.lit("STRING")))
    entry = entry.select("k", F.try_variant_get("a", "$", "string").alias("page_id"), F.try_variant_get("b", "$", "string").alias("title"))
    return entry.groupBy("page_id").agg(F.max_by("title", "k").alias("title")).select(F.lit(section).alias("section"), "page_id", "title")


def suite(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, query, gold)`` of a checked suite file."""
    data = json.loads(Path(path).read_text())
    if not data.get("corpus_version") or data.get("role") not in ("development", "held_out", "custom") or not data.get("method") or not data.get("cases"):
        raise ValueError("a suite needs corpus_version, a known role, method and cases")
    ids = [c.get("id") for c in data["cases"]]
    if len(set(ids)) != len(ids) or not all(ids):
        raise ValueError("case ids must be given and unique")
    for c in data["cases"]:
        if not c.get("query") or not c.get("gold"):
            raise ValueError(f"case {c['id']} needs a query and gold pages")
        if len({g.split("/", 1)[0] for g in c["gold"]}) != 1:
            raise ValueError(f"case {c['id']} mixes sections")
    return spark.createDataFrame([(c["id"], c["query"], c["gold"]) for c in data["cases"]], "query_id string, query string, gold array<string>")


def suite_facts(path: str) -> dict:
    """Version, role and method of a suite file."""
    data = json.loads(Path(path).read_text())
    return {k: data[k] for k in ("corpus_version", "role", "method")}


_BASE = "page_key string, missing_spans bigint, missing_shingles bigint, md_tokens bigint"


def audit_baseline(spark: SparkSession, path: str) -> Baseline:
    """A recorded baseline, of the present form or the older one that only lists pages."""
    data = json.loads(Path(path).read_text())
    if data.get("page_keys"):
        keys = data["page_keys"]
        if len(data.keys() - {"page_keys", "description"}):
            raise ValueError("baseline mixes both forms")
        if len(set(keys)) != len(keys) or not all(keys):
            raise ValueError("baseline lists a page twice, or an empty one")
        return Baseline(spark.createDataFrame([(k, None, None, None) for k in keys], _BASE))
    if data.get("schema_version") != 2 or not data.get("page_count", 0) > 0 or "pages" not in data:
        raise ValueError("baseline is incomplete")
    rows = [(p.get("page_key"), p.get("missing_spans", 0), p.get("missing_shingles", 0), p.get("md_tokens", 0)) for p in data["pages"]]
    if len({r[0] for r in rows}) != len(rows) or any(not r[0] or min(r[1:]) < 0 for r in rows):
        raise ValueError("baseline lists a page twice, an empty one or a negative number")
    need = ("shingle_n", "max_shingle_df", "content_min_df", "min_run", "ratio_gate_factor", "ratio_min_tokens")
    if any(k not in data for k in need):
        raise ValueError("baseline names no thresholds")
    return Baseline(spark.createDataFrame(rows, _BASE), data["page_count"], *(data[k] for k in need))


def shared_manifest(path: str) -> tuple[dict, list[int]]:
    """Settings and pinned fingerprints of a manifest of shared content."""
    data = json.loads(Path(path).read_text())
    if "fingerprints_delta_varint_b64" not in data:
        raise ValueError("manifest has no fingerprints")
    got = decode(data["fingerprints_delta_varint_b64"])
    if not got or len(got) != data.get("shingle_count"):
        raise ValueError("manifest declares another number of fingerprints")
    return data, got


_HASH = re.compile(r"[0-9a-f]{64}")
_VERSION = re.compile(r"\d+\.\d+")
_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)")


def check_marker(marker: dict, url_prefixes: tuple[str, ...]) -> None:
    """Raises unless the marker of a fetched archive is whole: version, pinned url, hash, time and a plain archive name."""
    if not _VERSION.fullmatch(str(marker.get("version", ""))):
        raise ValueError("marker: version")
    if not any(str(marker.get("zip_url", "")).startswith(p) for p in url_prefixes) or ".." in marker["zip_url"]:
        raise ValueError("marker: url")
    if not _HASH.fullmatch(str(marker.get("zip_sha256", ""))):
        raise ValueError("marker: hash")
    at = str(marker.get("fetched_at_utc", ""))
    if not _TIME.fullmatch(at):
        raise ValueError("marker: time")
    datetime.fromisoformat(at)  # a day or an hour that isn't one raises too
    name = marker.get("zip_name", "")
    if name and (os.path.basename(name) != name or name in (".", "..") or "\\" in name):
        raise ValueError("marker: archive name")


def check_cached(path: str, info: dict | None, url: str) -> str:
    """Hash of a cached archive whose recorded url and hash are right; raises otherwise and leaves the file."""
    if info is None or info.get("zip_url") != url:
        raise ValueError("cached archive has no fitting record")
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    if h.hexdigest() != info.get("zip_sha256"):
        raise ValueError("cached archive has another hash")
    return h.hexdigest()


def retained_archive(root: str, name: str | None) -> str | None:
    """The archive that the marker names, else the only one under ``root``."""
    if name and os.path.isfile(os.path.join(root, name)):
        return os.path.join(root, name)
    found = sorted(Path(root).glob("*.zip"))
    return str(found[0]) if len(found) == 1 else None

"""Reports and recorded states: dictionaries for JSON, and texts. What they list is ordered; only samples are cut."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import AuditConfig
from tessera.functions import text as X
from tessera.functions.codec import encode, fingerprint
from tessera.functions.visible import extract_udf
from tessera.operators import audit as A
from tessera.operators import compare as C
from tessera.operators import evalsuite as E
from tessera.operators import index as I
from tessera.operators import retrieval as R
from tessera.operators import shingles as S
from tessera.operators import validate as V
from tessera.plans.corpus import Corpus
from tessera.tables import keep

#: Generated cases of each tier of the benchmark.
TITLE_CASES = 1000
BODY_CASES = 10_000


def save(path: str, report: dict) -> None:
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


# audit


def thresholds(cfg: AuditConfig) -> dict:
    return {
        "shingle_n": cfg.n, "max_shingle_df": cfg.max_df, "content_min_df": cfg.content_min_df, "min_run": cfg.run, "ratio_factor": cfg.ratio_factor,
        "ratio_gate_factor": cfg.ratio_gate_factor, "ratio_min_tokens": cfg.ratio_min_tokens,
    }


def skipped_words(source: DataFrame, anchor: str = "", anchor_tag: str = "article") -> dict[str, int]:
    """Words of skipped subtrees by class, over ``source(html)``."""
    each = source.select(F.explode(extract_udf(anchor, anchor_tag)(F.col("html")).getField("skipped")).alias("class", "words"))
    return {r["class"]: r["words"] for r in each.groupBy("class").agg(F.sum("words").alias("words")).orderBy("class").collect()}


def audit_report(audit: A.Audit, cfg: AuditConfig, skipped: dict[str, int] | None = None, with_baseline: bool = False, pinned: int | None = None, seconds: float = 0.0) -> dict:
    """Everything an audit found. ``pinned`` is the number of pinned shared shingles, where there are any."""
    v = audit.verdict.first()
    flagged = [r.asDict() for r in audit.flags.orderBy(F.desc("gates"), F.desc("missing_shingle_count"), "page_key").collect()]
    out = {
        "page_count": audit.page_count, "content_loss": sum(f["gates"] for f in flagged), "ratio_outliers": v["ratio_only"], "skipped_words": skipped or {},
        "thresholds": thresholds(cfg), "seconds": round(seconds, 3), "flagged": flagged, "failed": v["failed"],
    }
    if with_baseline:
        out |= {"baselined": v["baselined"], "new_flags": v["new_flags"], "stale": audit.stale.count(), "page_shrink": audit.shrunk}
    if pinned is not None:
        out |= {"shared_pinned": pinned, "shared_loss": v["shared_loss"], "shared_loss_samples": [r["quote"] for r in audit.quotes.select("quote").distinct().orderBy("quote").limit(cfg.max_quotes).collect()]}
    return out


def audit_text(report: dict) -> str:
    t = report["thresholds"]
    lines = [
        f"{report['page_count']} pages audited in {report['seconds']:.1f} s: {report['content_loss']} lost content, {report['ratio_outliers']} are ratio outliers only.",
        "Thresholds: " + ", ".join(f"{k} {v}" for k, v in t.items()) + ".",
        "Words of skipped subtrees: " + (", ".join(f"{k} {v}" for k, v in sorted(report["skipped_words"].items(), key=lambda x: (-x[1], x[0]))) or "none") + ".",
    ]
    if "baselined" in report:
        lines.append(f"Baseline: {report['baselined']} known, {report['new_flags']} new, {report['stale']} stale; {report['page_shrink']} pages fewer than recorded.")
    if "shared_pinned" in report:
        lines.append(f"Shared content: {report['shared_pinned']} shingles pinned, {report['shared_loss']} lost.")
        lines += [f"  lost everywhere: {q}" for q in report["shared_loss_samples"]]
    hidden = 0
    for f in report["flagged"]:
        if f["baselined"]:
            hidden += 1
            continue
        kind = "content" if f["missing_span_count"] else "collapse" if f["ratio_gated"] else "ratio"
        ratio = f["derived_to_ref_token_ratio"]
        lines.append(f"[{kind}] {f['page_key']} ({f['source_rel']}): {f['md_tokens']} of {f['ref_tokens']} words" + (f", ratio {ratio:.3f}" if ratio is not None else "") + f", {f['missing_span_count']} spans, {f['missing_shingle_count']} windows missing")
        lines += [f"  missing: {q}" for q in f["missing_text_samples"]]
    if hidden:
        lines.append(f"{hidden} baselined pages are not listed.")
    return "\n".join(lines) + "\n"


def baseline_report(audit: A.Audit, cfg: AuditConfig) -> dict:
    """The gating flags as a baseline: what ``sources.files.audit_baseline`` reads."""
    pages = [r.asDict() for r in A.baseline_of(audit.flags).orderBy("page_key").collect()]
    t = thresholds(cfg)
    return {"schema_version": 2, "page_count": audit.page_count, **{k: t[k] for k in ("shingle_n", "max_shingle_df", "content_min_df", "min_run", "ratio_gate_factor", "ratio_min_tokens")}, "pages": pages}


def shared_report(audit: A.Audit, cfg: AuditConfig) -> dict:
    """The shared content of a run as pinned fingerprints: what ``sources.files.shared_manifest`` reads. A run without shared content is refused."""
    shared = S.texts(audit.tokens, S.content(audit.frequencies, cfg), cfg.n)
    values = [r["f"] for r in shared.select(fingerprint(F.col("shingle")).alias("f")).distinct().collect()]
    if not values:
        raise ValueError("no shingle is shared content; an empty manifest would pin nothing")
    return {"shingle_n": cfg.n, "max_shingle_df": cfg.max_df, "content_min_df": cfg.content_min_df, "shingle_count": len(values), "fingerprints_delta_varint_b64": encode(values)}


# retrieval


def policy_cost(stats: DataFrame, policy: str, seconds: float) -> dict:
    """Totals and means of a search's cost. Queries run as one batch, so a query's time is the batch's share."""
    s = stats.agg(F.count("*").alias("n"), F.coalesce(F.sum("query_count"), F.lit(0)).alias("q"), F.coalesce(F.sum("vocabulary_lookups"), F.lit(0)).alias("v")).first()
    n = max(s["n"], 1)
    return {"policy": policy, "queries": s["q"], "queries_per_case": s["q"] / n, "vocabulary_lookups": s["v"], "vocabulary_lookups_per_case": s["v"] / n, "batch_seconds": round(seconds, 3), "ms_per_case": round(1000 * seconds / n, 3)}


def benchmark(corpus: Corpus, policy: str = "safe-fill", extended: bool = False, source: DataFrame | None = None, curated: list[tuple[str, str, str]] = (), limit: int | None = None) -> dict:
    """Recall in the first ten of curated and generated cases: by titles, or by body texts if ``extended``. With ``source(section, source_rel, html)`` four lanes
    are compared: scans of raw and derived texts, and the index of raw and derived ones. ``curated`` has (name, query, expected source_rel)."""
    spark, began = corpus.spark, time.time()
    pages = corpus.whole_pages
    body = pages.withColumn("body", X.markdown_body(F.col("md")))
    size = limit or (BODY_CASES if extended else TITLE_CASES)
    made = E.body_cases(body, size) if extended else E.title_cases(pages, size)
    cases = spark.createDataFrame(list(curated), "name string, query string, expected string").unionByName(made)
    cases = keep(cases.where(F.size(X.terms(F.col("query"))) > 0).withColumn("section", F.substring_index("expected", "/", 1)).withColumn("query_id", F.xxhash64("name")), "cases")
    asked = cases.select("query_id", "query")
    t = time.time()
    found = R.search(corpus.index, asked, 10, policy)
    lanes = {"index": keep(found.hits, "hits")}
    took = {"index": time.time() - t}
    if source is not None:
        raw = source.select("section", "source_rel", E.raw_title(F.col("html")).alias("title"), F.col("html").alias("body"))
        terms, rows = R.measured(R.query_terms(asked))
        for name, make in (
            ("raw scan", lambda: R.naive_scan(raw_scan(source).select("source_rel", "text"), asked)),
            ("derived scan", lambda: R.naive_scan(pages.select("source_rel", F.lower("md").alias("text")), asked)),
            ("raw index", lambda: R.exact_top(terms, rows, I.of_terms(raw, terms), 10)),
        ):
            t = time.time()
            lanes[name] = keep(make(), "lane")
            took[name] = time.time() - t
    recall = E.lane_recall(lanes, cases.select("query_id", "section", "expected")).orderBy("lane", "section").collect()
    hit = {n: h.select("query_id", F.col("source_rel").alias("expected"), F.lit(True).alias(n)).distinct() for n, h in lanes.items()}
    each = cases
    for n, h in hit.items():
        each = each.join(h, ["query_id", "expected"], "left").fillna(False, [n])
    every = each.withColumn("passed", E.all_true(list(hit)))
    misses = [r.asDict() for r in E.first_misses(every.select(F.col("name").alias("query_id"), "expected", "passed", *[F.col(f"`{n}`") for n in hit])).collect()]
    out = {
        "mode": "comparison" if source is not None else "recall", "distribution": "body" if extended else "title", "cases": cases.count(), "curated_cases": len(curated),
        "recall": [r.asDict() for r in recall], "cost": policy_cost(found.stats, policy, took["index"]), "lane_seconds": {k: round(v, 3) for k, v in took.items()}, "misses": misses,
    }
    if source is not None:
        b = raw_scan(source).agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
        d = corpus.pages.agg(F.count("*").alias("n"), F.sum("text_bytes").alias("b")).first()
        out |= {"source_files": b["n"], "derived_files": d["n"], "source_bytes": b["b"], "derived_bytes": d["b"], "ratio": d["b"] / b["b"] if b["b"] else None}
    return out | {"seconds": round(time.time() - began, 3)}


def raw_scan(source: DataFrame) -> DataFrame:
    """``(source_rel, text, bytes)``: lower-cased raw pages, for the scan lane."""
    return source.select("source_rel", F.lower("html").alias("text"), F.octet_length("html").cast("bigint").alias("bytes"))


def concept_report(corpus: Corpus, suite: DataFrame, facts: dict, limit: int = 10, policy: str = "safe-fill") -> dict:
    """Recall of a suite, by section, with each case's hits. ``facts`` are the suite's version, role and method."""
    began = time.time()
    results = keep(E.concept(corpus.index, suite, corpus.pages, limit, policy), "concept")
    stats = R.search(corpus.index, suite.select("query_id", "query"), limit, policy).stats
    per = results.groupBy("section").agg(F.count("*").alias("cases"), F.count_if("passed").alias("found")).orderBy("section").collect()
    n, found = sum(r["cases"] for r in per), sum(r["found"] for r in per)
    return {
        **facts, "limit": limit, "cases": n, "found": found, "recall": found / n if n else None, "leaks": [r.asDict() for r in E.suite_leaks(suite).orderBy("query_id", "bigram").collect()],
        "sections": [r.asDict() | {"recall": r["found"] / r["cases"]} for r in per], "cost": policy_cost(stats, policy, time.time() - began),
        "misses": [r["query_id"] for r in E.first_misses(results).collect()], "results": [r.asDict() for r in results.orderBy("query_id").collect()],
    }


def concept_text(report: dict) -> str:
    lines = [f"{'found ' if r['passed'] else 'missed'} {r['query_id']}: gold {', '.join(r['gold'])}; hits {', '.join(r['hits']) or 'none'}" for r in report["results"]]
    lines.append(f"recall in {report['limit']}: {report['found']} of {report['cases']}")
    lines += [f"  {s['section']}: {s['found']} of {s['cases']}" for s in report["sections"]]
    c = report["cost"]
    return "\n".join([*lines, f"{c['policy']}: {c['queries']} queries, {c['vocabulary_lookups']} vocabulary lookups, {c['ms_per_case']} ms a case of the batch"]) + "\n"


# comparison


def compare_report(base: Corpus, cand: Corpus, source: DataFrame | None = None, size: int = 20) -> dict:
    """Counts and samples of all differences of two corpora; ``passed`` where there is none. ``source(source_rel, content)`` are the original files."""
    a, b = base.whole_pages, cand.whole_pages
    row = C.summary(a, b, source=source).first().asDict()
    indexed = {n: I.indexed_pages(c.index) if c.info.get("full_text") else None for n, c in (("baseline", base), ("candidate", cand))}
    parity = indexed["baseline"] == indexed["candidate"] and all(v in (None, row[f"{k}_pages"]) for k, v in indexed.items())
    text = lambda c: V.without_text(c.pages, c.page_text)
    lost = text(base).count()
    sample = lambda df, key: [r[0] if len(r) == 1 else r.asDict() for r in C.samples(df, key, size).collect()]
    samples = {
        "missing_pages": sample(C.missing_keys(a, b), "page_key"), "unexpected_pages": sample(C.missing_keys(b, a), "page_key"), "field_mismatches": sample(C.field_mismatch(a, b), "page_key"),
        "without_text": sample(text(base).unionByName(text(cand)).select("row_key"), "row_key"),
    }
    if source is not None:
        samples |= {
            "missing_sources": sample(C.missing_keys(source, cand.pages, "source_rel"), "source_rel"), "unknown_sources": sample(C.missing_keys(cand.pages, source, "source_rel"), "source_rel"),
            "hash_mismatches": sample(C.hash_mismatch(cand.pages, source), "source_rel"),
        }
    passed = row.pop("passed") and parity and lost == 0
    return {**row, "baseline_without_text": lost, "indexed": indexed, "index_parity": parity, "samples": samples, "passed": passed}

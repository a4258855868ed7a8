"""Command line: ``python -m tessera VERB``. Exit codes: 0 done or passed, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from tessera.config import AUDIT, AuditConfig


class _Usage(Exception):
    pass


def session():
    from pyspark.sql import SparkSession

    if (active := SparkSession.getActiveSession()) is not None:
        return active
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sections_of(args, root: str) -> tuple[str, ...]:
    """The named sections, else every folder under the root that doesn't begin with a dot or an underscore."""
    if args.sections:
        return tuple(args.sections.split(","))
    found = tuple(sorted(n for n in os.listdir(root) if os.path.isdir(os.path.join(root, n)) and n[0] not in "._")) if os.path.isdir(root) else ()
    if not found:
        raise FileNotFoundError(f"{root} has no sections; is it fetched?")
    return found


def profile_of(args):
    from tessera.functions.htmlpage import ARTICLE, Profile

    if not args.profile:
        return ARTICLE
    with open(args.profile) as f:
        return Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items()})


def site_of(args):
    from tessera.sources.fetch import Site

    with open(args.site) as f:
        return Site(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items()})


def run_fetch(args) -> int:
    from tessera.sources import fetch as S

    site = site_of(args)
    if args.resolve_only:
        print(S.resolve(site, args.version))
        return 0
    print(json.dumps(S.fetch(site, args.version, args.destination, args.cache_root or os.path.join(args.destination + ".cache"), args.workers, args.force, args.delete_zip), indent=2))
    return 0


def run_build(args) -> int:
    from tessera.plans import corpus as B
    from tessera.sources import fetch as S
    from tessera.sources import files as L

    if args.site:
        S.restore(args.source, site_of(args), args.workers)
    spark, sections = session(), sections_of(args, args.source)
    source = L.html_files(spark, args.source, sections)
    titles = None
    for s in sections:
        t = L.titles(spark, os.path.join(args.source, s, args.titles), s)
        titles = t if titles is None else titles.unionByName(t)
    built = B.build(source.select("section", "source_rel", "html"), args.output, titles, profile_of(args), not args.no_index)
    if args.site and not args.keep_source:
        S.prune(args.source, sections, site_of(args))
    print(json.dumps(built.info, indent=2))
    return 0


def run_search(args) -> int:
    from tessera.plans.corpus import Corpus

    words = " ".join(args.query).strip()
    if not words:
        raise _Usage("search needs a query")
    hits = Corpus(session(), args.corpus).search(words, args.limit, args.policy).collect()
    if not hits:
        print(f"nothing matches {words!r}", file=sys.stderr)
    for h in hits:
        print(f"{h['rank']:>3} {h['section']}: {h['title']}\n      {h['page_key']}")
    return 0


def run_page(args) -> int:
    from tessera.plans.corpus import Corpus

    try:
        print(Corpus(session(), args.corpus).page(args.page_key), end="")
    except KeyError:
        print(f"no page {args.page_key}", file=sys.stderr)
        return 1
    return 0


def run_source(args) -> int:
    from tessera.sources import archive as Z
    from tessera.sources import files as L

    Z.check_relative(args.source_rel)
    path = os.path.join(args.source, *args.source_rel.split("/"))
    if os.path.isfile(path):
        with open(path, "rb") as f:
            data = f.read()
    else:
        kept = L.retained_archive(args.source, None)
        if kept is None:
            raise FileNotFoundError(f"{args.source_rel} is not extracted and no archive is kept")
        data = Z.read_member(kept, sections_of(args, args.source) if args.sections else (args.source_rel.split("/", 1)[0],), args.source_rel)
    sys.stdout.buffer.write(data)
    sys.stdout.flush()
    return 0


def run_audit(args) -> int:
    from tessera import reports as P
    from tessera.functions.htmlpage import ARTICLE
    from tessera.operators import audit as A
    from tessera.operators import validate as V
    from tessera.plans.corpus import Corpus
    from tessera.sources import files as L

    try:
        cfg = AuditConfig(args.shingle_n, args.max_shingle_df, args.content_min_df, args.min_run, args.ratio_factor, args.ratio_gate_factor, args.ratio_min_tokens, args.max_quotes)
    except ValueError as e:
        raise _Usage(str(e)) from e
    spark, began = session(), time.time()
    sections = sections_of(args, args.source)
    corpus = Corpus(spark, args.corpus)
    baseline = L.audit_baseline(spark, args.baseline) if args.baseline else None
    pinned, count = None, None
    if args.shared_baseline:
        facts, values = L.shared_manifest(args.shared_baseline)
        for name, now in (("shingle_n", cfg.n), ("max_shingle_df", cfg.max_df), ("content_min_df", cfg.content_min_df)):
            if facts.get(name) != now:
                raise ValueError(f"shared content was pinned with {name} {facts.get(name)}, this run has {now}")
        count = len(values)
        pinned = spark.createDataFrame([((v ^ (1 << 63)) - (1 << 63),) for v in values], "fingerprint bigint")
    corpus.require_valid(sections)
    V.require(V.bijection(corpus.pages, L.discovered(spark, args.source, sections)))
    profile = profile_of(args) if args.profile else ARTICLE
    source = L.html_files(spark, args.source, sections)
    found = A.run(corpus.audit_pages(source, profile.anchor, profile.anchor_tag), cfg, baseline, pinned)
    report = P.audit_report(found, cfg, P.skipped_words(source, profile.anchor, profile.anchor_tag), baseline is not None, count, time.time() - began)
    print(P.audit_text(report), end="")
    if args.output:
        P.save(args.output, report)
    if args.write_baseline:
        P.save(args.write_baseline, P.baseline_report(found, cfg))
    if args.write_shared_baseline:
        P.save(args.write_shared_baseline, P.shared_report(found, cfg))
    if args.write_baseline or args.write_shared_baseline:
        return 0  # writing it accepts the present state
    return int(report["failed"])


def run_benchmark(args) -> int:
    from tessera import reports as P
    from tessera.operators.retrieval import parse_policy
    from tessera.plans.corpus import Corpus
    from tessera.sources import files as L

    if args.extended and args.comparison:
        raise _Usage("--extended and --comparison exclude one another")
    if args.comparison and not args.source:
        raise _Usage("--comparison needs --source")
    parse_policy(args.policy)
    spark = session()
    source = L.html_files(spark, args.source, sections_of(args, args.source)) if args.comparison else None
    curated = []
    if args.cases:
        with open(args.cases) as f:
            curated = [(c["name"], c["query"], c["expected"]) for c in json.load(f)]
    report = P.benchmark(Corpus(spark, args.corpus), args.policy, args.extended, source, curated)
    if args.output:
        P.save(args.output, report)
    print(json.dumps(report, indent=2, ensure_ascii=False))
    return 0


def run_concept(args) -> int:
    from tessera import reports as P
    from tessera.plans.corpus import Corpus
    from tessera.sources import files as L

    if args.limit < 1:
        raise _Usage("--limit must be 1 or more")
    spark = session()
    report = P.concept_report(Corpus(spark, args.corpus), L.suite(spark, args.eval), L.suite_facts(args.eval), args.limit, args.policy)
    print(json.dumps(report, indent=2, ensure_ascii=False) if args.json else P.concept_text(report), end="\n" if args.json else "")
    return 0


def run_compare(args) -> int:
    from tessera import reports as P
    from tessera.plans.corpus import Corpus
    from tessera.sources import files as L

    spark = session()
    source = L.html_files(spark, args.source, sections_of(args, args.source)) if args.source else None
    report = P.compare_report(Corpus(spark, args.baseline), Corpus(spark, args.candidate), source, args.sample_limit)
    if args.output:
        P.save(args.output, report)
    print(json.dumps(report, indent=2, ensure_ascii=False))
    return int(not report["passed"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *options: tuple) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        for flag, kind in options:
            if kind is bool:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, **kind)
        return p

    text, need = dict(default=None), dict(required=True)
    policy = ("--policy", dict(default="safe-fill", choices=("exact", "safe-fill", "fused")))
    workers = ("--workers", dict(type=int, default=4))
    place = (("--sections", text), ("--profile", text))
    verb("fetch", run_fetch, ("--site", need), ("--version", need), ("--destination", need), ("--cache-root", text), workers, ("--force", bool), ("--delete-zip", bool), ("--resolve-only", bool))
    verb("build", run_build, ("--source", need), ("--output", need), ("--titles", dict(default="titles.json")), ("--site", text), workers, ("--keep-source", bool), ("--no-index", bool), *place)
    verb("search", run_search, ("--corpus", need), ("--limit", dict(type=int, default=10)), policy, ("query", dict(nargs="*")))
    verb("page", run_page, ("--corpus", need), ("page_key", {}))
    verb("source", run_source, ("--source", need), ("--sections", text), ("source_rel", {}))
    whole = lambda x: dict(type=int, default=x)
    real = lambda x: dict(type=float, default=x)
    verb(
        "audit", run_audit, ("--source", need), ("--corpus", need), ("--output", text), ("--shingle-n", whole(AUDIT.n)), ("--max-shingle-df", whole(AUDIT.max_df)), ("--content-min-df", whole(AUDIT.content_min_df)),
        ("--min-run", whole(AUDIT.min_run)), ("--ratio-factor", real(AUDIT.ratio_factor)), ("--ratio-gate-factor", real(AUDIT.ratio_gate_factor)), ("--ratio-min-tokens", whole(AUDIT.ratio_min_tokens)), ("--max-quotes", whole(AUDIT.max_quotes)),
        ("--baseline", text), ("--write-baseline", text), ("--shared-baseline", text), ("--write-shared-baseline", text), *place,
    )
    verb("benchmark", run_benchmark, ("--corpus", need), ("--source", text), ("--output", text), ("--extended", bool), ("--comparison", bool), ("--cases", text), policy, *place)
    verb("concept-eval", run_concept, ("--corpus", need), ("--eval", need), ("--limit", whole(10)), policy, ("--json", bool))
    verb("compare", run_compare, ("--baseline", need), ("--candidate", need), ("--source", text), ("--output", text), ("--sample-limit", whole(20)), *place)
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return args.run(args)
    except _Usage as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except (OSError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1

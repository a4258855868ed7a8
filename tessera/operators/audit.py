"""Content-loss audit: which pages lost text between a source and its derived copy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import AUDIT, QUOTE_BYTES, AuditConfig
from tessera.functions import text as X
from tessera.functions.codec import fingerprint
from tessera.operators import shingles as S
from tessera.tables import keep


def clip(text: Column, most: int = QUOTE_BYTES) -> Column:
    """``text`` cut to at most ``most`` bytes between characters, with three dots where anything went."""
    chars = F.sequence(F.lit(most), F.lit(most // 4), F.lit(-1))
    fit = F.filter(F.transform(chars, lambda k: F.left(text, k)), lambda t: F.octet_length(t) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.element_at(fit, 1), F.lit("...")))


def split(pages: DataFrame, *more: str) -> DataFrame:
    """``pages(page_key, section, source_rel, ref, md)`` and other text columns ``more``, each text as its tokens; ``md`` is null where it has those of ``ref``, and a
    text like the source's is not split again. The whole Markdown counts. Whoever reads it splits the texts: that costs less than to write and read the tokens."""
    own = F.when(F.col("md").eqNullSafe(F.col("ref")), F.lit(None)).otherwise(X.words(F.col("md")))
    t = pages.select("page_key", "section", "source_rel", X.words(F.col("ref")).alias("ref"), own.alias("md"), *[X.words(F.col(c)).alias(c) for c in more])
    return t.withColumn("md", F.nullif("md", "ref"))


def tokenized(pages: DataFrame) -> DataFrame:
    """``split`` as a table of its own, for pages whose texts cost much to make."""
    return keep(split(pages), "tokens")


def counted(tokens: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """``shingles.frequencies`` as a table of its own."""
    return keep(S.frequencies(tokens, n=cfg.n), "frequencies")


def lost(tokens: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """What ``counted`` has of the shingles that any page's copy lacks and that are no furniture: all that the flags ask for."""
    return keep(S.frequencies(tokens, n=cfg.n).where((F.col("lost_df") > 0) & checkable(cfg)), "lost")


def changed(tokens: DataFrame) -> DataFrame:
    """Pages whose copy has other tokens than the source, as a table of its own; no other page lacks anything."""
    return keep(tokens.where(F.col("md").isNotNull()), "changed")


def checkable(cfg: AuditConfig) -> Column:
    """Whether a shingle is no page furniture."""
    return (F.col("ref_df") <= cfg.max_df) | (F.col("md_df") >= cfg.content_min_df)


def missing_windows(pages: DataFrame, df: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """``(page_key, pos, h)``: windows of the source that are no page furniture and that the page's copy doesn't have. ``pages`` are tokens, at least the changed ones.

    What a page's copy lacks is found inside its row, so only pages that lack something are exploded, and only their distinct
    missing windows meet the frequencies."""
    both = pages.where(F.col("md").isNotNull() & (F.size("ref") >= cfg.n)).select("page_key", X.shingle_hashes(F.col("ref"), cfg.n).alias("all"), X.shingle_hashes(F.col("md"), cfg.n).alias("own"))
    lacking = keep(both.select("page_key", "all", F.array_except("all", "own").alias("gone")).where(F.size("gone") > 0), "lacking")
    gone = lacking.select("page_key", F.explode("gone").alias("h")).join(df.where(checkable(cfg)).select("h"), "h", "left_semi")
    each = lacking.select("page_key", F.posexplode("all").alias("p", "h")).select("page_key", F.col("p").cast("bigint").alias("pos"), "h")
    return each.join(gone, ["page_key", "h"], "left_semi").select("page_key", "pos", "h")


def missing_runs(missing: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """``(page_key, start, windows)``: runs of at least ``min_run`` consecutive missing windows."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy("page_key").orderBy("pos"))
    r = missing.withColumn("island", island).groupBy("page_key", "island").agg(F.min("pos").alias("start"), F.count("*").alias("windows"))
    return r.where(F.col("windows") >= cfg.run).select("page_key", "start", "windows")


def short_pages(pages: DataFrame, df: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """``(page_key, quote)`` of non-empty pages under ``n`` tokens, no furniture, whose tokens the copy doesn't have in sequence. ``pages`` are tokens, at least the changed ones."""
    s = pages.where(F.col("md").isNotNull() & (F.size("ref") > 0) & (F.size("ref") < cfg.n)).where(~X.contains_run(F.col("md"), F.col("ref")))
    s = s.select("page_key", "ref", X.shingle_hashes(F.col("ref"), cfg.n)[0].alias("h")).join(df.where(checkable(cfg)).select("h"), "h", "left_semi")
    return s.select("page_key", clip(F.array_join("ref", " ")).alias("quote"))


def quotes(runs: DataFrame, pages: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """``(page_key, start, quote)`` of each page's first ``max_quotes`` runs: the source tokens that the run's windows cover. ``pages`` are tokens, at least the changed ones."""
    w = Window.partitionBy("page_key").orderBy("start")
    first = runs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cfg.max_quotes)
    j = first.join(pages.where(F.col("md").isNotNull()).select("page_key", "ref"), "page_key")
    span = F.slice("ref", F.col("start").cast("int") + 1, F.col("windows").cast("int") + cfg.n - 1)
    return j.select("page_key", "start", clip(F.array_join(span, " ")).alias("quote"))


def sizes(tokens: DataFrame) -> DataFrame:
    """``(page_key, section, source_rel, ref_tokens, md_tokens)``, the last two as numbers, as a table of its own: none of the texts goes further."""
    md = F.size(F.coalesce("md", "ref")).cast("bigint")
    return keep(tokens.select("page_key", "section", "source_rel", F.size("ref").cast("bigint").alias("ref_tokens"), md.alias("md_tokens")), "sizes")


def section_medians(size: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """``(section, median_ratio)``: exact median of copy to source tokens over pages long enough."""
    ratio = F.col("md_tokens") / F.col("ref_tokens")
    return size.where(F.col("ref_tokens") >= F.greatest(F.lit(cfg.ratio_min_tokens), F.lit(1))).groupBy("section").agg(F.median(ratio).alias("median_ratio"))


def ratio_outliers(size: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """``(page_key, section, ref_tokens, md_tokens, ratio, ratio_outlier, ratio_gated)`` of pages far under their section's median."""
    r = size.where((F.col("ref_tokens") > 0) & (F.col("ref_tokens") >= cfg.ratio_min_tokens)).withColumn("ratio", F.col("md_tokens") / F.col("ref_tokens"))
    j = r.join(F.broadcast(section_medians(size, cfg)), "section").where("median_ratio > 0")  # one row for each section
    j = j.withColumn("ratio_outlier", F.col("ratio") < F.lit(cfg.ratio_factor) * F.col("median_ratio")).withColumn("ratio_gated", F.col("ratio") < F.lit(cfg.ratio_gate_factor) * F.col("median_ratio"))
    return j.where("ratio_outlier").select("page_key", "section", "ref_tokens", "md_tokens", "ratio", "ratio_outlier", "ratio_gated")


def flags(tokens: DataFrame, df: DataFrame, cfg: AuditConfig = AUDIT) -> DataFrame:
    """A row for each suspicious page: spans and windows that are missing, samples of them, and the ratio tiers.

    ``missing_shingle_count`` counts every missing window of a page with a run, runs too short to count included."""
    pages = changed(tokens)
    gone = keep(missing_windows(pages, df, cfg), "missing")
    runs = missing_runs(gone, cfg)
    spans = runs.groupBy("page_key").agg(F.count("*").alias("missing_span_count"))
    total = gone.groupBy("page_key").agg(F.count("*").alias("missing_shingle_count"))
    samples = quotes(runs, pages, cfg).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("start", "quote"))).alias("q"))
    lost = spans.join(total, "page_key").join(samples, "page_key", "left").select("page_key", "missing_span_count", "missing_shingle_count", F.col("q.quote").alias("missing_text_samples"))
    one = F.lit(1).cast("bigint")
    brief = short_pages(pages, df, cfg).select("page_key", one.alias("missing_span_count"), one.alias("missing_shingle_count"), F.array("quote").alias("missing_text_samples"))
    size = sizes(tokens)
    ratio = ratio_outliers(size, cfg).select("page_key", "ratio_outlier", "ratio_gated")
    hit = lost.unionByName(brief).join(ratio, "page_key", "full_outer")
    zero = F.lit(0).cast("bigint")
    return hit.join(size, "page_key").select(
        "page_key", "section", "source_rel", "ref_tokens", "md_tokens", F.try_divide("md_tokens", "ref_tokens").alias("derived_to_ref_token_ratio"),
        F.coalesce("missing_shingle_count", zero).alias("missing_shingle_count"), F.coalesce("missing_span_count", zero).alias("missing_span_count"),
        F.coalesce("missing_text_samples", F.array().cast("array<string>")).alias("missing_text_samples"),
        F.coalesce("ratio_outlier", F.lit(False)).alias("ratio_outlier"), F.coalesce("ratio_gated", F.lit(False)).alias("ratio_gated"),
    )


def gates(f: DataFrame) -> Column:
    return (f["missing_span_count"] > 0) | f["ratio_gated"]


def apply_baseline(found: DataFrame, base: DataFrame) -> DataFrame:
    """``found`` with ``gates`` and ``baselined``: a gating flag is covered where its page is listed with at least its spans and windows and at most its
    copied tokens. ``base(page_key, missing_spans, missing_shingles, md_tokens)``; a listing without numbers (older form) covers anything."""
    b = base.select("page_key", F.lit(True).alias("listed"), F.col("missing_spans").alias("bs"), F.col("missing_shingles").alias("bw"), F.col("md_tokens").alias("bt"))
    j = found.withColumn("gates", gates(found)).join(b, "page_key", "left")
    covered = F.col("listed") & (F.col("bs").isNull() | ((F.col("missing_span_count") <= F.col("bs")) & (F.col("missing_shingle_count") <= F.col("bw")) & (F.col("md_tokens") >= F.col("bt"))))
    return j.withColumn("baselined", F.col("gates") & F.coalesce(covered, F.lit(False))).drop("listed", "bs", "bw", "bt")


def stale(found: DataFrame, base: DataFrame) -> DataFrame:
    """Listed pages that no longer gate."""
    return base.select("page_key").join(found.where(gates(found)).select("page_key"), "page_key", "left_anti")


def baseline_of(found: DataFrame) -> DataFrame:
    """What ``apply_baseline`` takes, from the gating flags."""
    return found.where(gates(found)).select("page_key", F.col("missing_span_count").alias("missing_spans"), F.col("missing_shingle_count").alias("missing_shingles"), "md_tokens")


def page_shrink(recorded: int | None, now: int) -> int:
    """Pages lost since the baseline; 0 without a baseline or a recorded count."""
    return max(0, recorded - now) if recorded else 0


def verdict(found: DataFrame, shrunk: int = 0, shared_loss: DataFrame | None = None) -> DataFrame:
    """One row: ``new_flags``, ``baselined``, ``content_loss``, ``ratio_only``, ``page_shrink``, ``shared_loss``, ``failed``. ``found`` comes from ``apply_baseline``."""
    sums = found.agg(
        F.count_if(F.col("gates") & ~F.col("baselined")).alias("new_flags"), F.count_if("baselined").alias("baselined"),
        F.count_if(F.col("missing_span_count") > 0).alias("content_loss"), F.count_if((F.col("missing_span_count") == 0) & F.col("ratio_outlier")).alias("ratio_only"),
    )
    loss = shared_loss.agg(F.count("*").alias("shared_loss")) if shared_loss is not None else found.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("shared_loss"))
    one = sums.crossJoin(loss).withColumn("page_shrink", F.lit(shrunk).cast("bigint"))
    return one.withColumn("failed", (F.col("new_flags") > 0) | (F.col("page_shrink") > 0) | (F.col("shared_loss") > 0))


@dataclass(frozen=True)
class Baseline:
    """Recorded settings and pages of an earlier run."""

    pages: DataFrame
    page_count: int | None = None
    n: int | None = None
    max_df: int | None = None
    content_min_df: int | None = None
    min_run: int | None = None
    ratio_gate_factor: float | None = None
    ratio_min_tokens: int | None = None

    def mismatch(self, cfg: AuditConfig) -> str:
        """Name of the first recorded threshold that differs, or an empty string; older baselines record none."""
        for name, now in (("n", cfg.n), ("max_df", cfg.max_df), ("content_min_df", cfg.content_min_df), ("min_run", cfg.run), ("ratio_gate_factor", cfg.ratio_gate_factor), ("ratio_min_tokens", cfg.ratio_min_tokens)):
            was = getattr(self, name)
            if was is not None and was != now:
                return f"{name}: baseline {was}, run {now}"
        return ""


@dataclass(frozen=True)
class Audit:
    """``quotes`` has a source text of each collapsed shingle; ``page_count`` and ``shrunk`` are numbers of pages."""

    tokens: DataFrame
    flags: DataFrame
    stale: DataFrame
    frequencies: DataFrame
    collapsed: DataFrame
    quotes: DataFrame
    verdict: DataFrame
    page_count: int
    shrunk: int


def run(pages: DataFrame, cfg: AuditConfig = AUDIT, baseline: Baseline | None = None, pinned: DataFrame | None = None) -> Audit:
    """The whole audit of ``pages(page_key, section, source_rel, ref, md)``. ``pinned(fingerprint)`` are ``codec.fingerprint`` numbers of shared shingles."""
    spark = pages.sparkSession
    if baseline is not None and (why := baseline.mismatch(cfg)):
        raise ValueError(f"baseline was made with other thresholds: {why}")
    base = baseline.pages if baseline is not None else spark.createDataFrame([], "page_key string, missing_spans bigint, missing_shingles bigint, md_tokens bigint")
    tokens = tokenized(pages)
    df = counted(tokens, cfg)
    found = keep(apply_baseline(flags(tokens, df, cfg), base), "flags")
    count = tokens.count()
    shrunk = page_shrink(baseline.page_count, count) if baseline is not None else 0
    gone = df.limit(0)
    if pinned is not None:
        # only shared shingles can collapse: theirs are the texts that are put together and fingerprinted
        shared = S.texts(tokens, df.where((F.col("ref_df") > cfg.max_df) & (F.col("md_df") <= cfg.max_df)).withColumn("k", F.col("h")), cfg.n).withColumnRenamed("k", "h")
        gone = keep(shared.withColumn("fingerprint", fingerprint(F.col("shingle"))).join(pinned.select("fingerprint").distinct(), "fingerprint", "left_semi"), "collapsed")
    return Audit(tokens, found, stale(found, base), df, gone, S.first_quotes(tokens, gone, cfg.n), verdict(found, shrunk, gone), count, shrunk)

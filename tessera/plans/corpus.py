"""Build of a derived corpus: HTML to Markdown, index, list and manifest, published as one folder."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import files
from tessera.config import BROADCAST_ROWS
from tessera.functions import text as X
from tessera.functions.htmlpage import ARTICLE, Profile, parse_udf
from tessera.functions.visible import extract_udf
from tessera.operators import index as I
from tessera.operators import retrieval as R
from tessera.operators import validate as V

MARKER = "corpus-manifest.json"
PAGE_COLUMNS = ("page_key", "section", "page_id", "title", "source_rel", "canonical_url", "source_sha256", "text_sha256", "source_bytes", "text_bytes")


def json_inner(value: Column) -> Column:
    """``value`` as inside a JSON string, with <, > and & escaped too; quotes at the ends are trimmed."""
    x = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":"?|"?\}$', "")
    for c, u in (("<", r"\\u003c"), (">", r"\\u003e"), ("&", r"\\u0026")):
        x = F.regexp_replace(x, c, u)
    return F.regexp_replace(x, '^"+|"+$', "")


def content_links(links: Column, source_rel: Column) -> Column:
    """Links that lead off the page: the first of each target, fragments and links to the page itself dropped."""
    own = F.substring_index(source_rel, "/", -1)
    target = lambda l: F.substring_index(l["href"], "#", 1)
    away = F.filter(links, lambda l: (target(l) != "") & (target(l) != own))
    hrefs = F.transform(away, lambda l: l["href"])
    return F.filter(away, lambda l, i: F.array_position(hrefs, l["href"]) == i + 1)


def markdown(section: Column, page_id: Column, title: Column, source_rel: Column, source_hash: Column, canonical: Column, body: Column, links: Column) -> Column:
    head = F.concat(
        F.lit("---\nsection: "), section, F.lit("\npage_id: "), json_inner(page_id), F.lit("\ntitle: "), json_inner(title), F.lit("\nsource_rel: "), source_rel,
        F.lit("\nsource_sha256: "), source_hash, F.lit("\ncanonical_url: "), canonical, F.lit("\n---\n\n"),
    )
    text = F.when(body == "", F.lit("[No extracted content]")).otherwise(body)
    lines = F.array_join(F.transform(content_links(links, source_rel), lambda l: F.concat(F.lit("- "), l["text"], F.lit(" -> "), l["href"])), "\n")
    tail = F.when(lines == "", F.lit("")).otherwise(F.concat(F.lit("\n\n## Content Links\n"), lines))
    return F.concat(F.regexp_replace(F.concat(head, text, tail), r"[ \n]+$", ""), F.lit("\n"))


def derive(source: DataFrame, titles: DataFrame | None = None, profile: Profile = ARTICLE) -> DataFrame:
    """Derived pages of ``source(section, source_rel, html)``: page columns, ``body`` and ``md``."""
    # the parse has one result for each row: without the mark the optimizer would repeat it for each field
    parsed = source.withColumn("p", parse_udf(profile).asNondeterministic()(F.col("html")))
    page_id = X.page_id(F.substr("source_rel", F.length("section") + 2))
    d = parsed.withColumn("page_id", page_id)
    if titles is not None:
        t = titles.select("section", "page_id", F.col("title").alias("listed"))
        d = d.join(F.broadcast(t) if titles.count() <= BROADCAST_ROWS else t, ["section", "page_id"], "left")
    else:
        d = d.withColumn("listed", F.lit(None).cast("string"))
    title = X.page_title(F.col("listed"), F.col("p.title"), F.col("page_id"))
    md = markdown(F.col("section"), F.col("page_id"), F.col("title"), F.col("source_rel"), F.sha2("html", 256), F.col("p.canonical"), F.col("p.body"), F.col("p.links"))
    d = d.withColumn("title", title).withColumn("md", md)
    return d.select(
        F.concat_ws("/", "section", "page_id").alias("page_key"), "section", "page_id", "title", "source_rel", F.col("p.canonical").alias("canonical_url"),
        F.unhex(F.sha2("html", 256)).alias("source_sha256"), F.unhex(F.sha2("md", 256)).alias("text_sha256"), F.octet_length("html").cast("bigint").alias("source_bytes"),
        F.octet_length("md").cast("bigint").alias("text_bytes"), F.col("p.headings").alias("headings"), F.col("p.links").alias("links"), F.col("p.body").alias("body"), "md",
    )


def manifest(pages: DataFrame) -> DataFrame:
    """One row: ``page_count``, ``source_bytes``, ``text_bytes``, ``ratio``."""
    s = pages.agg(F.count("*").alias("page_count"), F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum("text_bytes"), F.lit(0)).alias("text_bytes"))
    return s.withColumn("ratio", F.try_divide(F.col("text_bytes").cast("double"), F.col("source_bytes").cast("double")))


def search_index(pages: DataFrame) -> DataFrame:
    """Rows of the tab-separated list; tabs in titles become blanks."""
    return pages.select("page_key", "section", "page_id", F.translate("title", "\t", " ").alias("title"), "source_rel", "canonical_url")


def prepare_output(spark: SparkSession, path: str) -> None:
    """Refuses a folder that holds something other than a corpus."""
    if files.names(spark, path) and not files.is_file(spark, f"{path}/{MARKER}"):
        raise ValueError(f"{path} is not empty and has no {MARKER}")


@dataclass(frozen=True)
class Corpus:
    """A built corpus in a folder of any file system that Spark reaches."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        if not files.is_file(self.spark, f"{self.path}/{MARKER}"):
            raise FileNotFoundError(f"{self.path} holds no corpus; is it built?")

    @property
    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/pages")

    @property
    def page_text(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/page_text")

    @property
    def whole_pages(self) -> DataFrame:
        """Pages with ``md``, null where a page has no text."""
        return self.pages.join(self.page_text, "page_key", "left")

    @property
    def index(self) -> I.Index:
        if not self.info.get("full_text"):
            raise ValueError(f"{self.path} was built without an index and can't be searched")
        return I.Index.read(self.spark, f"{self.path}/index")

    @property
    def info(self) -> dict:
        return json.loads(files.read(self.spark, f"{self.path}/{MARKER}"))

    def require_valid(self, sections: tuple[str, ...], source: DataFrame | None = None) -> None:
        """Raises where a page row breaks a rule, a page has no text, or pages and ``source(source_rel)`` are not one to one."""
        V.require(V.violations(self.pages, sections, source, self.page_text))

    def page(self, page_key: str) -> str:
        """Markdown of one page; files are sorted by key, so the filter reads few row groups."""
        row = self.page_text.where(F.col("page_key") == page_key).first()
        if row is None:
            raise KeyError(page_key)
        return row["md"]

    def search(self, query: str, limit: int = 10, policy: str = "safe-fill") -> DataFrame:
        """``(rank, section, title, page_key, source_rel)`` for one query."""
        q = self.spark.createDataFrame([(0, query)], "query_id bigint, query string")
        return R.search(self.index, q, limit, policy).hits.join(self.pages, "source_rel").select("rank", "section", "title", "page_key", "source_rel").orderBy("rank")

    def audit_pages(self, source: DataFrame, anchor: str = "", anchor_tag: str = "article") -> DataFrame:
        """``(page_key, section, source_rel, ref, md)``: each page's own text against the words of ``source(source_rel, html)``, which are extracted apart from the derivation."""
        ref = source.select("source_rel", F.array_join(extract_udf(anchor, anchor_tag)(F.col("html")).getField("tokens"), " ").alias("ref"))
        return self.pages.select("page_key", "section", "source_rel").join(ref, "source_rel").join(self.page_text, "page_key").select("page_key", "section", "source_rel", "ref", "md")


def build(source: DataFrame, output: str, titles: DataFrame | None = None, profile: Profile = ARTICLE, full_text: bool = True) -> Corpus:
    """Derives ``source`` into ``output`` by way of a staging folder, which takes the place of an older corpus only when all of it is written. Without
    ``full_text`` no index is built, and the manifest says so."""
    spark = source.sparkSession
    prepare_output(spark, output)
    stage = f"{output.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        derive(source, titles, profile).write.parquet(f"{stage}/derived")  # each page is parsed once
        d = spark.read.parquet(f"{stage}/derived")
        V.require(V.duplicates(d, "page_key").unionByName(V.duplicates(d, "source_rel")))
        d.select(*PAGE_COLUMNS).repartitionByRange("page_key").sortWithinPartitions("page_key").write.parquet(f"{stage}/pages")
        d.select("page_key", "md").repartitionByRange("page_key").sortWithinPartitions("page_key").write.parquet(f"{stage}/page_text")
        if full_text:
            I.build(d.select("source_rel", "title", "body")).write(f"{stage}/index")
        search_index(d).orderBy("section", "source_rel").write.csv(f"{stage}/search_index", sep="\t", header=True, quote="", escape="")
        info = manifest(d).first().asDict() | {"full_text": full_text}
        files.write(spark, f"{stage}/index.md", f"# Corpus\n\n{info['page_count']} pages, {info['source_bytes']} source bytes, {info['text_bytes']} text bytes.\n\nTables: pages, page_text, index, search_index.\n")
        files.delete(spark, f"{stage}/derived")
        files.write(spark, f"{stage}/{MARKER}", json.dumps(info, indent=1) + "\n")
        files.delete(spark, output)
        files.rename(spark, stage, output)
    finally:
        files.delete(spark, stage)
    return Corpus(spark, output)

"""HTML pages against a second derivation by the standard library's parser, and the examples that define the parser's rules."""

import hashlib
import json
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from tessera.functions import codec, htmlpage, visible
from tessera.functions.htmlpage import ARTICLE, Profile, compact_text, parse

DATA = "/root/testdata/sf0.001"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"blockquote", "pre", "li", "ol", "ul", "th", "td", "tr", "table", "section", "div", "p"}


class Second(HTMLParser):
    """Body of the article by depth, without navigation, footers, advertisements and raw text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.hidden = 0
        self.title, self.body, self.head, self.in_title = "", "", None, False

    def handle_starttag(self, tag, attrs):
        self.in_title = self.in_title or tag == "title"
        if self.hidden or tag in ("nav", "footer", "script", "style") or ("class", "ad") in attrs:
            self.hidden += tag not in VOID
            return
        if tag not in VOID and (self.inside or tag == "article"):
            self.inside += 1
        if self.inside:
            if tag in BLOCK or tag == "br":
                self.body += "\n"
            elif tag in ("h1", "h2", "h3", "h4"):
                self.body += "\n\n"
                self.head = ""

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if self.hidden:
            self.hidden -= 1
        elif self.inside:
            if self.head is not None and tag in ("h1", "h2", "h3", "h4"):
                self.body += " ".join(self.head.split()) + "\n"
                self.head = None
            if tag in BLOCK:
                self.body += "\n"
            self.inside -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.inside and not self.hidden:
            if self.head is None:
                self.body += data
            else:
                self.head += data


def second(text):
    p = Second()
    p.feed(text)
    p.close()
    lines = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", p.body))
    return " ".join(p.title.split()), re.sub(r"\n{3,}", "\n\n", lines).strip()


@pytest.fixture(scope="module")
def source(spark):
    from tessera.queries import html

    return {r.source_rel: r.html for r in html(spark, DATA).collect()}


def test_derived_pages_against_a_second_parser(spark, source):
    from tessera import queries

    rows = queries.derived_markdown(spark, DATA).collect()
    assert len(rows) == len(source) > 0
    for r in rows:
        raw = source[r.page_key + ".html"]
        title, body = second(raw)
        section, page_id = r.page_key.split("/")
        inner = lambda x: json.dumps(x, ensure_ascii=False)[1:-1].replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").strip('"')
        md = f"---\nsection: {section}\npage_id: {inner(page_id)}\ntitle: {inner(title)}\nsource_rel: {r.page_key}.html\nsource_sha256: {hashlib.sha256(raw.encode()).hexdigest()}\ncanonical_url: \n---\n\n{body or '[No extracted content]'}"
        assert r.md == md.rstrip() + "\n"
        assert (r.title, r.source_bytes, r.text_bytes) == (title, len(raw.encode()), len(r.md.encode()))
        assert (r.source_sha256, r.text_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest().upper() for x in (raw, r.md))
    total = queries.manifest_totals(spark, DATA).first()
    assert (total.page_count, total.source_bytes, total.text_bytes) == (len(rows), sum(r.source_bytes for r in rows), sum(r.text_bytes for r in rows))
    assert total.ratio == round(total.text_bytes / total.source_bytes, 9)


class Words(HTMLParser):
    """Visible words by the depth of the anchor; words of skipped subtrees by their kind."""

    SPLIT = {"p", "br", "h1", "div", "article", "footer", "nav", "ul", "li"}

    def __init__(self, anchor):
        super().__init__(convert_charrefs=True)
        self.on, self.depth, self.anchor = not anchor, 0, anchor
        self.skip, self.text, self.dropped = [], "", Counter()

    def handle_starttag(self, tag, attrs):
        if tag in self.SPLIT and self.on and not self.skip:
            self.text += " "
        if tag in VOID:
            return
        if not self.on:
            if tag == self.anchor:
                self.on, self.depth = True, 0
            return
        self.depth += 1
        if tag in ("head", "script", "style"):
            self.skip.append((self.depth, tag))

    def handle_endtag(self, tag):
        if tag in self.SPLIT and self.on and not self.skip:
            self.text += " "
        if not self.on:
            return
        if self.skip and self.skip[-1][0] == self.depth:
            self.skip.pop()
        self.depth -= 1
        self.on = self.depth >= 0

    def handle_data(self, data):
        if self.on and not self.skip:
            self.text += data
        elif self.on:
            self.dropped[self.skip[0][1]] += len(re.findall(r"[^\W_]+", data))


def seen(text, anchor="article"):
    p = Words(anchor)
    p.feed(text)
    p.close()
    return re.findall(r"[^\W_]+", p.text), p.dropped


def test_audit_words_against_a_second_extractor(spark, source):
    from tessera import queries

    for r in queries.audit_tokens(spark, DATA).collect():
        want, _ = seen(source[r.source_rel])
        assert r.tokens.split() == want and r.n == len(want)
    # a script's string that looks like an end tag closes a level for the extractor, which has no raw-text mode
    plain = {k: v.replace('"</p>"', '""') for k, v in source.items()}
    dropped = Counter()
    for text in plain.values():
        dropped += Counter(visible.extract(text, "", "")[1])
    want = Counter()
    for text in plain.values():
        want += seen(text, "")[1]
    assert dropped == want
    got = {r["class"]: r["words"] for r in queries.skipped_chrome(spark, DATA).collect()}
    total = Counter()
    for text in source.values():
        total += Counter(visible.extract(text, "", "")[1])
    assert got == dict(total)


def test_html_audit_flags_by_brute_force(spark, source):
    from tessera import queries

    md = {r.page_key: r.md for r in queries.derived_markdown(spark, DATA).collect()}
    word = re.compile(r"[^\W_]+")
    ref = {k: [w.lower() for w in seen(source[k + ".html"])[0]] for k in md}
    have = {k: [w.lower() for w in word.findall(v)] for k, v in md.items()}
    windows = lambda t: [tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))] if t else []
    rdf, mdf = Counter(), Counter()
    for k in md:
        rdf.update(set(windows(ref[k])))
        mdf.update(set(windows(have[k])))
    want = {}
    for k in md:
        if len(ref[k]) < 5:
            continue
        own = set(windows(have[k]))
        gone = [i for i, w in enumerate(windows(ref[k])) if (rdf[w] <= 4 or mdf[w] >= 5) and w not in own]
        spans, run = 0, 0
        for i in range(len(gone)):
            run = run + 1 if i and gone[i] == gone[i - 1] + 1 else 1
            spans += run == 5
        if spans:
            want[k] = (spans, len(gone))
    got = {r.page_key: (r.missing_span_count, r.missing_shingle_count) for r in queries.html_audit_flags(spark, DATA).collect() if r.missing_span_count}
    assert got == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a  b\t c", "a b c"), (" x \n\n\n\n y ", "x\n\ny"), ("a\r\nb\rc", "a\nb\nc"), ("&lt;b&gt; &amp;amp;", "<b> &amp;"), ("", ""), ("\n \n", ""), ("a b", "a b")],
)
def test_compaction(raw, want):
    assert compact_text(raw) == want


def test_parser_rules():
    p = parse(
        '<html><head><title> A &amp; B </title><link rel="canonical" href="u"></head><body><div class="x content-body"><h2>Head <b>bold</b></h2><p>one<br>two</p>'
        '<div class="toolbar">gone <i>too</i></div><a href="p.html">link <b>text</b></a><script>if (a < b) "</div>"</script><img src=x>three</div>outside</body></html>',
        Profile(),
    )
    assert (p.title, p.canonical, p.headings, p.links) == ("A & B", "u", ["Head bold"], [("link text", "p.html")])
    assert "gone" not in p.body and "outside" not in p.body and p.body.startswith("Head bold\n\none\ntwo") and p.body.endswith("three")
    assert parse("<article>never closed <p", ARTICLE).body == "never closed"
    assert parse("<article>a<!-- <p>no</p> -->b<!-- open", ARTICLE).body == "ab"
    assert parse('<article a=">">in</article>', ARTICLE).body == "in"
    assert parse("<article>x<p/>y</article>z", ARTICLE).body == "x\n\ny"
    assert parse("", ARTICLE).body == "" and parse("no tags", ARTICLE).body == ""
    assert htmlpage.attributes("a HREF='x&amp;y' b=1 c checked d=\"q\"/") == {"href": "x&y", "b": "1", "c": "", "checked": "", "d": "q"}
    assert htmlpage.tag_end('a b="x>y">', 0) == 9 and htmlpage.tag_end("a b", 0) == -1
    assert parse("<title>Doc: x</title>", Profile(title_prefixes=("Doc: ",))).title == "x"


def test_long_pages_parse_in_linear_time():
    import time

    for text in ("<article>" + "<p>word " * 200_000, "<" * 300_000, "<article>" + "a" * 2_000_000, "<p a='" * 100_000):
        began = time.time()
        parse(text)
        visible.extract(text)
        assert time.time() - began < 30


def test_visible_words():
    assert visible.extract("<article>one<p>two</p><script>no</script>b<b>old</b></article>four") == (["one", "two", "bold"], {"script": 1})
    assert visible.extract("no article here") == (["no", "article", "here"], {})
    assert visible.words("a1_b-c é٣ x²") == ["a1", "b", "c", "é٣", "x"]


def test_fingerprint_codec():
    values = [0, 1, 127, 128, 2**63, 2**64 - 1]
    assert codec.decode(codec.encode(values)) == values and codec.decode(codec.encode([])) == []
    assert codec.fnv1a("a") == 0xAF63DC4C8601EC8C
    for bad in ("***", "gA==", "AQA=", codec.encode([1])[:-4] + "!!!!"):
        with pytest.raises(ValueError):
            codec.decode(bad)


def test_fingerprints_of_columns(spark):
    from pyspark.sql import functions as F

    texts = ["a", "one two three", "", None, "é ü x", "one two three four five", "a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1).select(codec.fingerprint(F.col("s"))).collect()]
    assert [None if g is None else g & (2**64 - 1) for g in got] == [None if t is None else codec.fnv1a(t) for t in texts]


def test_markdown_body_is_recovered(spark):
    from pyspark.sql import functions as F

    from tessera.functions.text import markdown_body

    md = "---\nsection: a\n---\n\nthe body\n\nmore\n\n## Content Links\n- x -> y\n"
    assert spark.createDataFrame([(md,)], "m string").select(markdown_body(F.col("m"))).first()[0] == "the body\n\nmore"

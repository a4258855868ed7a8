"""HTML page to title, canonical link, headings, links and body text.

Depth is a counter, not a tree: any end tag closes one level, whatever its name. What counts as content and what
as page furniture is a ``Profile``.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrow import in_slices

RAW = frozenset(("script", "style", "template", "noscript", "svg"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("blockquote pre li ol ul th td tr table section div p".split())
HEAD = frozenset(("h1", "h2", "h3", "h4"))
_SPACE = " \t\n\v\f\r\x85\xa0"


@dataclass(frozen=True)
class Profile:
    """Where the content of a site's pages is. ``anchor`` is an id or a part of a class, ``anchor_tag`` an element name;
    ``chrome`` are parts, and ``chrome_classes`` whole words, of id, class and role."""

    anchor: str = "content-body"
    anchor_tag: str = ""
    chrome: tuple[str, ...] = ("breadcrumb", "feedback", "footer", "header", "navigation", "prev-next", "search-form", "sidebar", "toolbar", "tooltip")
    chrome_classes: tuple[str, ...] = ()
    chrome_tags: tuple[str, ...] = ()
    title_prefixes: tuple[str, ...] = ()


#: The pages of the given tables.
ARTICLE = Profile(anchor="", anchor_tag="article", chrome=(), chrome_classes=("ad",), chrome_tags=("nav", "footer"))


def compact_text(value: str) -> str:
    value = html.unescape(value).replace("\r\n", "\n").replace("\r", "\n")
    value = re.sub(r"[ \t\f\v]+", " ", value)
    value = re.sub(r" *\n *", "\n", value)
    return re.sub(r"\n{3,}", "\n\n", value).strip(" \n")


def tag_end(text: str, start: int) -> int:
    """Index of the ``>`` that ends a tag, quoted ones passed over; -1 without one."""
    m = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*>""").match(text, start)
    return m.end() - 1 if m else -1


def tag_name(content: str, closing: bool) -> str:
    rest = content[1:] if closing else content
    rest = rest.lstrip(_SPACE)
    k = 0
    while k < len(rest) and (rest[k].isalpha() or rest[k].isdecimal() or rest[k] in "-:"):
        k += 1
    return rest[:k].lower()


def attributes(content: str) -> dict[str, str]:
    """Attributes of a start tag; the last of a name wins, and an unquoted value ends at white space or a slash."""
    out: dict[str, str] = {}
    n, i = len(content), 0

    def skip(k: int, blank: bool) -> int:
        while k < n and (content[k] in _SPACE) == blank:
            k += 1
        return k

    i = skip(0, False)
    while True:
        i = skip(i, True)
        if i >= n or content[i] == "/":
            return out
        a = i
        while i < n and content[i] not in _SPACE and content[i] not in "=/":
            i += 1
        name = content[a:i].lower()
        i = skip(i, True)
        value = ""
        if i < n and content[i] == "=":
            i = skip(i + 1, True)
            if i < n and content[i] in "\"'":
                close = content.find(content[i], i + 1)
                close = n if close < 0 else close
                value, i = content[i + 1 : close], min(n, close + 1)
            else:
                a = i
                while i < n and content[i] not in _SPACE and content[i] != "/":
                    i += 1
                value = content[a:i]
        if name:
            out[name] = html.unescape(value)


@dataclass
class Page:
    title: str = ""
    canonical: str = ""
    headings: list[str] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    body: str = ""


class _Reader:
    def __init__(self, profile: Profile):
        self.profile, self.page = profile, Page()
        self.in_title, self.title = False, []
        self.inside = self.hidden = 0
        self.out: list[str] = []
        self.heading: list[str] | None = None
        self.link: tuple[str, list[str]] | None = None

    def furniture(self, tag: str, a: dict[str, str]) -> bool:
        p = self.profile
        if tag in p.chrome_tags:
            return True
        ident = " ".join((a.get("id", ""), a.get("class", ""), a.get("role", ""))).lower()
        return any(t in ident for t in p.chrome) or any(c in ident.split() for c in p.chrome_classes)

    def anchors(self, tag: str, a: dict[str, str]) -> bool:
        p = self.profile
        if p.anchor_tag and tag == p.anchor_tag:
            return True
        return bool(p.anchor) and (a.get("id", "").lower() == p.anchor or p.anchor in a.get("class", "").lower())

    def open(self, tag: str, a: dict[str, str]) -> None:
        if tag == "title":
            self.in_title = True
        if tag == "link" and a.get("rel", "").lower() == "canonical":
            self.page.canonical = a.get("href", "")
        if self.hidden or tag in RAW or self.furniture(tag, a):
            self.hidden += tag not in VOID
            return
        if tag not in VOID and (self.inside or self.anchors(tag, a)):
            self.inside += 1
        if not self.inside:
            return
        if tag in BLOCK or tag == "br":
            self.out.append("\n")
        elif tag in HEAD:
            self.out.append("\n\n")
            self.heading = []
        elif tag == "a":
            self.link = (a.get("href", ""), [])

    def close(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag == "title":
            self.in_title = False
            self.page.title = compact_text("".join(self.title))
        if self.hidden:
            self.hidden -= 1
            return
        if not self.inside:
            return
        if tag in HEAD and self.heading is not None:
            text = compact_text("".join(self.heading))
            if text:
                self.page.headings.append(text)
                self.out += (text, "\n")
            self.heading = None
        if tag == "a" and self.link is not None and self.link[0]:
            text = compact_text("".join(self.link[1]))
            if text:
                self.page.links.append((text, self.link[0]))
            self.link = None
        if tag in BLOCK:
            self.out.append("\n")
        self.inside -= 1

    def text(self, value: str) -> None:
        if self.in_title:
            self.title.append(value)
        elif not self.hidden and self.inside:
            (self.out if self.heading is None else self.heading).append(value)
            if self.link is not None:
                self.link[1].append(value)

    def done(self) -> Page:
        self.page.body = compact_text("".join(self.out))
        for prefix in self.profile.title_prefixes:
            if self.page.title.startswith(prefix):
                self.page.title = compact_text(self.page.title[len(prefix) :])
        return self.page


def parse(text: str, profile: Profile = ARTICLE) -> Page:
    """Total: malformed input ends the parse and keeps what came before."""
    reader, i, low = _Reader(profile), 0, None
    while i < len(text):
        lt = text.find("<", i)
        if lt < 0:
            reader.text(text[i:])
            break
        if lt > i:
            reader.text(text[i:lt])
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            if end < 0:
                break
            i = end + 3
            continue
        gt = tag_end(text, lt + 1)
        if gt < 0:
            break
        content, i = text[lt + 1 : gt], gt + 1
        if content[:1] in ("!", "?"):
            continue
        closing = content[:1] == "/"
        tag = tag_name(content, closing)
        if not tag:
            continue
        if closing:
            reader.close(tag)
            continue
        reader.open(tag, attributes(content))
        if tag in RAW:
            low = text.lower() if low is None else low
            at = low.find("</" + tag, i) if len(low) == len(text) else text.lower().find("</" + tag, i)
            if at >= 0:
                end = tag_end(text, at + 2)
                reader.close(tag)
                if end < 0:
                    break
                i = end + 1
                continue
        if content.strip(_SPACE).endswith("/"):
            reader.close(tag)
    return reader.done()


LINK = T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])
PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())),
    T.StructField("links", T.ArrayType(LINK)), T.StructField("body", T.StringType()),
])
_ARROW_PAGE = pa.struct([("title", pa.string()), ("canonical", pa.string()), ("headings", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))), ("body", pa.string())])


def parse_udf(profile: Profile = ARTICLE):
    """Arrow UDF from HTML to a ``PAGE`` struct; null for null."""

    @F.arrow_udf(PAGE)
    def run(column: pa.Array) -> pa.Array:
        def one(t: str | None) -> dict | None:
            if t is None:
                return None
            p = parse(t, profile)
            return {"title": p.title, "canonical": p.canonical, "headings": p.headings, "links": [{"text": a, "href": b} for a, b in p.links], "body": p.body}

        return in_slices(column, one, _ARROW_PAGE)

    return run


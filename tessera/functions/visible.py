"""Visible words of an HTML page, for the audit.

Written apart from the page parser and sharing nothing with it, so that one's mistakes are not the other's. Skipped
subtrees close where their depth is reached again; there is no raw-text mode for scripts.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrow import in_slices

INVISIBLE = {"head", "script", "style", "svg", "template", "noscript"}
EMPTY = set("wbr track source param meta link input img hr embed col br base area".split())
SEPARATING = set(
    "summary details legend fieldset form br hr h6 h5 h4 h3 h2 h1 address blockquote pre dd dt dl li ol ul colgroup caption th td tr tfoot tbody thead table"
    " figcaption figure main footer header nav aside article section div p".split()
)
#: Page-local navigation: its text differs from page to page, so frequencies cannot tell it from content.
LOCAL_CHROME = ("breadcrumb", "prev-next", "tooltip", "switch-link")

_TAG = re.compile(r"""<(?P<in>(?:[^<>"']|"[^"]*"|'[^']*'|<)*)>""")
_NAME = re.compile(r"[^\W_][\w:\-]*|[\-:][\w:\-]*")
_ATTR = re.compile(r"""(?:^|(?<=[\s"']))(id|class|role|aria-label)[ \t\n]*=[ \t\n]*(?:"([^"]*)"|'([^']*)'|([^ \t\n/]*))""", re.I)
_RUN = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and decimal digits, as written."""
    out, run = [], []
    for m in _RUN.finditer(text):
        w = m.group()
        if w.isascii() or all(c.isalpha() or c.isdecimal() for c in w):
            out.append(w)
            continue
        run = []
        for c in w:
            if c.isalpha() or c.isdecimal():
                run.append(c)
            elif run:
                out.append("".join(run))
                run = []
        if run:
            out.append("".join(run))
    return out


def identity(inner: str) -> str:
    first: dict[str, str] = {}
    for m in _ATTR.finditer(inner):
        first.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return " ".join(v.lower() for v in first.values())


def _collect(page: str, anchor: str, anchor_tag: str) -> tuple[str, Counter]:
    kept: list[str] = []
    dropped: Counter = Counter()
    on = not (anchor or anchor_tag)
    depth, skips = 0, []  # skips: (depth, label) of open skipped subtrees
    at = 0

    def put(piece: str) -> None:
        if not on or not piece:
            return
        piece = unescape(piece)
        if skips:
            dropped[skips[0][1]] += len(words(piece))
        else:
            kept.append(piece)

    while at < len(page):
        lt = page.find("<", at)
        put(page[at:] if lt < 0 else page[at:lt])
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            if stop < 0:
                break
            at = stop + 3
            continue
        m = _TAG.match(page, lt)
        if m is None:
            break
        inner, at = m["in"], m.end()
        if not inner or inner[0] in "!?":
            continue
        ends = inner[0] == "/"
        name = _NAME.match(inner[ends:].lstrip())
        if name is None:
            continue
        name = name.group().lower()
        if name in SEPARATING and on and not skips:
            kept.append(" ")
        if ends:
            if not on or name in EMPTY:
                continue
            if skips and skips[-1][0] == depth:
                skips.pop()
            depth -= 1
            on = depth >= 0
            continue
        if name in EMPTY or inner.rstrip().endswith("/"):
            continue
        who = identity(inner)
        if not on:
            if (anchor and anchor in who) or (anchor_tag and name == anchor_tag):
                on, depth = True, 0
            continue
        depth += 1
        label = next((t for t in LOCAL_CHROME if t in who), name if name in INVISIBLE else "")
        if label:
            skips.append((depth, label))
    return "".join(kept), dropped


def extract(page: str, anchor: str = "", anchor_tag: str = "article") -> tuple[list[str], dict[str, int]]:
    """``(words, skipped words by class)`` inside the anchor, or of the whole page where the anchor has none."""
    text, dropped = _collect(page, anchor, anchor_tag)
    got = words(text)
    if not got and (anchor or anchor_tag):
        text, dropped = _collect(page, "", "")
        got = words(text)
    return got, {k: v for k, v in dropped.items() if v}


VISIBLE = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("skipped", T.MapType(T.StringType(), T.LongType()))])


def extract_udf(anchor: str = "", anchor_tag: str = "article"):
    kind = pa.struct([("tokens", pa.list_(pa.string())), ("skipped", pa.map_(pa.string(), pa.int64()))])

    @F.arrow_udf(VISIBLE)
    def run(column: pa.Array) -> pa.Array:
        def one(t: str | None) -> dict:
            tokens, skipped = extract(t or "", anchor, anchor_tag)
            return {"tokens": tokens, "skipped": sorted(skipped.items())}

        return in_slices(column, one, kind)

    return run

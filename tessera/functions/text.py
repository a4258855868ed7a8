"""Tokenizers and text expressions, all built-in and evaluated in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"
PLAIN = r"[\p{L}\p{Nd}_.\-]+"
#: Letters, numbers and private characters; combining marks go on with a token but don't begin one.
INDEXED = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{0300}-\x{036F}]*"

#: Lower-case letters that are an ASCII letter and one mark, by the character database; letters with more marks or other bases stay as they are.
_MARKED = [(c, d[0]) for c in map(chr, range(0xC0, 0x1F00)) if c.islower() and len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii()]
#: What ``fold`` turns into what; the combining marks at the end turn into nothing.
FOLD_FROM = "".join(c for c, _ in _MARKED) + "".join(map(chr, range(0x300, 0x370)))
FOLD_TO = "".join(d for _, d in _MARKED)


def words(text: Column) -> Column:
    """Runs of letters and digits, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def terms(query: Column) -> Column:
    """Lower-cased query terms of more than one byte, in order, repeats kept."""
    low = F.transform(words(query), lambda x: F.lower(x))
    return F.filter(low, lambda x: F.octet_length(x) > 1)


def plain_terms(query: Column) -> Column:
    """Terms of the plain scan: underscores, dots and hyphens stay inside."""
    low = F.transform(F.regexp_extract_all(query, F.lit(PLAIN), F.lit(0)), lambda x: F.lower(x))
    return F.filter(low, lambda x: F.octet_length(x) > 1)


def fold(term: Column) -> Column:
    low = F.lower(term)
    return F.when(F.octet_length(term) == F.length(term), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))  # ASCII has nothing to translate


def raw_tokens(text: Column) -> Column:
    """Tokens of the index as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(INDEXED), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens of the index: lower case, combining marks of decomposable letters dropped."""
    return F.transform(raw_tokens(text), fold)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda's variable is not written out anew at each place that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(tokens: Column, n: int, put, none: str) -> Column:
    """``put`` of each window of ``n`` lower-cased tokens, in order, each from its own slice. A shorter, non-empty stream is one window; an empty one has none."""

    def of(low: Column) -> Column:
        size = F.size(low)
        each = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: put(F.slice(low, i, n)))
        return F.when(size == 0, F.array().cast(none)).when(size < n, F.array(put(low))).otherwise(each)

    return let(F.transform(tokens, lambda x: F.lower(x)), of)


def shingles(tokens: Column, n: int) -> Column:
    """The windows' tokens joined by blanks."""
    return _windows(tokens, n, lambda w: F.array_join(w, " "), "array<string>")


def shingle_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit number for each of ``shingles``, in order; no window's text is put together."""
    return _windows(tokens, n, lambda w: F.xxhash64(w), "array<bigint>")


def compact(decoded: Column) -> Column:
    """White space compaction of text whose entities are decoded already."""
    x = F.regexp_replace(decoded, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t\f\x0B]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text`` without overlap."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def scan_score(text: Column, wanted: Column) -> Column:
    """Sum of the occurrences of all terms, 0 unless each occurs."""
    every = F.forall(wanted, lambda t: F.contains(text, t))
    total = F.aggregate(wanted, F.lit(0).cast("bigint"), lambda a, t: a + occurrences(text, t))
    return F.when((F.size(wanted) > 0) & every, total).otherwise(F.lit(0).cast("bigint"))


def contains_run(hay: Column, needle: Column) -> Column:
    """Whether the lower-cased ``needle`` stands contiguously in the lower-cased ``hay``; an empty needle always does."""
    h, m = (F.concat(F.lit(" "), F.lower(F.array_join(x, " ")), F.lit(" ")) for x in (hay, needle))
    return (F.size(needle) == 0) | F.contains(h, m)  # tokens hold no blanks


def page_id(rel: Column) -> Column:
    """Path without a lower-case ``.html`` ending."""
    return F.regexp_replace(rel, r"\.html$", "")


def page_title(wanted: Column, parsed: Column, ident: Column) -> Column:
    """First non-empty of the listed title, the parsed title and the page id."""
    return F.coalesce(F.nullif(wanted, F.lit("")), F.nullif(parsed, F.lit("")), ident)


def markdown_body(md: Column) -> Column:
    """Markdown without front matter and link appendix."""
    x = F.regexp_replace(md, r"(?s)^---\n.*?\n---\n", "")
    return F.regexp_replace(F.regexp_replace(x, r"(?s)\n\n## Content Links\n.*$", ""), r"^\s+|\s+$", "")

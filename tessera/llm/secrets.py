"""Operator 9: secret scan by assignment-aware lexing.

Source and configuration syntax in a text is lexed into (name, expression) pairs: ``name = "x"``,
``name := 'x'``, ``"name": "x"``, ``name: x``, ``export NAME=x``, ``obj["name"] = x``. Names that stand for constants are resolved, through
chains, concatenations and ``${NAME}`` references, so a literal is judged by every name that it reaches. Its score is the sensitivity of the most
sensitive of these names times how much the literal looks like a secret rather than a placeholder.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

#: Score from which a literal is reported.
THRESHOLD = 0.5
MASK = "[SECRET]"

#: Sensitivity of a name by the words in it; pairs of neighbouring words count too.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "passcode": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "api key": 1.0,
    "access key": 1.0, "secret key": 1.0, "private key": 1.0, "encryption key": 1.0, "signing key": 1.0, "account key": 0.9, "auth key": 0.9, "master key": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "authtoken": 1.0,
    "connection string": 0.8, "dsn": 0.6, "salt": 0.6, "signature": 0.5, "jwt": 0.8, "session key": 0.8, "webhook": 0.5, "pin": 0.5, "key": 0.6,
}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\[.*\]|\{\{.*\}\}|your.*|my.*here|example.*|sample.*|change.?me.*|placeholder.*|dummy.*|redacted.*|todo.*|none|null|nil|true|false|undefined|test|string|password|secret|token|required|optional|default|env|bearer|basic|\d{1,4})$")
_NAME = r"[A-Za-z_][\w\-]*(?:\.[A-Za-z_][\w\-]*)*"
_STRING = r'"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`\n]*`'
_OP = re.compile(r":=|=>|=(?![=~])|:(?![:/=])")
_ASSIGN = re.compile(  # only matched at a place, never searched: it would try every start within a long word
    rf'(?:(?P<path>{_NAME})?\[\s*["\'](?P<index>[\w.\-]+)["\']\s*\]|["\'](?P<quoted>[\w.\- ]{{1,80}})["\']|(?P<plain>{_NAME}))'
    rf"[ \t]*(?P<op>{_OP.pattern})"
)
_TYPE = re.compile(rf"\s*[A-Za-z_][\w.\[\]]*[ \t]*(?P<op>=>|=(?![=~]))")  # a type between name and value
_INDEX = re.compile(r"""\[\s*["']([\w.\-]+)["']\s*\]""")
_QUOTED = re.compile(r"[\w.\- ]{1,80}")
_WORD = re.compile(r"[\w.\-]")
_START = re.compile(r"[A-Za-z_]")
_BLANKS = re.compile(r"[ \t]*")
_ITEM = re.compile(rf"(?P<string>[A-Za-z]{{0,2}}(?:{_STRING}))|(?P<ref>\$\{{?(?P<var>[A-Za-z_]\w*)\}}?)|(?P<bare>[^\s,;\"'`()\[\]{{}}<>]+)")
_PLUS = re.compile(r"\s*\+\s*|[ \t]*\.\.[ \t]*")
_INNER = re.compile(r"\$\{([A-Za-z_]\w*)\}")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_JOINED = re.compile(r"(password|passwd|passphrase|passcode|secret|token|apikey|secretkey|accesskey|privatekey|credential)s?$")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token|digest|apikey|negotiate)$")
_AFTER_SCHEME = re.compile(r"[ \t]+(?P<bare>[^\s,;\"'`()\[\]{}<>]+)")
#: Callees whose first argument names what they look up.
_LOOKUP = re.compile(r"(?i)(?:^|[._])(?:get|getenv|env|environ|fetch|lookup|getproperty)$")
_INSIDE = re.compile(rf"(?P<string>{_STRING})|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<comma>,)|(?P<word>{_NAME})")
_NEXT_PARAMETER = re.compile(r"&[\w.\-%]+=")
_KEY_ENDS = re.compile(r"\s*(?::|=>)")
_PASS = re.compile(r"(?i)pass(?:word|wd|phrase|code)|pwd")
_SENTENCE = frozenset("a an the is are be to of in or and for must should please enter your you this that with at not no".split())
_IDENT = re.compile(_NAME)


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _CAMEL.findall(name)]
    best = 0.0
    for k, w in enumerate(words):
        for x in (w, " ".join(words[k : k + 2])):
            best = max(best, SENSITIVE.get(x, 0.0), SENSITIVE.get(x.removesuffix("s"), 0.0))
        if m := _JOINED.search(w):  # dbpassword
            best = max(best, SENSITIVE[m[1]])
    return best


def strength(literal: str) -> float:
    """0..1: long, varied literals score high, placeholders and plain words 0 or low."""
    s = literal.strip()
    if len(s) < 6 or _PLACEHOLDER.match(s) or s.startswith(("$", "%(", "{{")):
        return 0.0
    n = len(s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    kinds = sum((any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s), any(not c.isalnum() for c in s)))
    if " " in s and kinds < 3:
        return 0.2
    score = min(1.0, entropy / 3.2) * min(1.0, 0.55 + 0.15 * kinds)
    return score if n >= 8 else 0.75 * score


def is_passphrase(name: str, literal: str) -> bool:
    """Three words or more, no sentence, under a name for passwords."""
    words = literal.lower().split()
    return len(words) >= 3 and len(literal) >= 12 and bool(_PASS.search(name)) and not _SENTENCE.intersection(words)


#: Assignments within one another whose brackets are read to their ends; further in, only what stands before the next bracket counts.
NESTED = 8
#: Equals signs in one unbroken word from which it is a chain of assignments rather than a literal that has such signs.
CHAIN = 8


class Literal:
    """A place in a text; ``value`` is cut out when it is asked for."""

    __slots__ = ("start", "end", "text")

    def __init__(self, start: int, end: int, text: str):
        self.start, self.end, self.text = start, end, text

    @property
    def value(self) -> str:
        return self.text[self.start : self.end]


class _Lexer:
    """One pass over the operators of a text. Each looks for its name between the last operator and itself and for its value behind itself, so
    every character is read a bounded number of times, however long a word, line or text is."""

    def __init__(self, text: str):
        self.text = text
        self.ops = [(m.start(), m.end(), m.group()) for m in _OP.finditer(text)]
        self.at = [a for a, _, _ in self.ops]
        self.open_ended: set[int] = set()  # brackets that are known never to close
        self.inside: list[int] = []  # ends of the bracketed values that are open here
        self.line_end = -1
        self.word = (0, 0, False)  # the last unbroken word: where it begins and ends, and whether it is a chain

    def name(self, low: int, high: int) -> str | None:
        """The name that ends at ``high``, none of it before ``low``."""
        text = self.text
        while high > low and text[high - 1] in " \t":
            high -= 1
        if high <= low:
            return None
        last = text[high - 1]
        if last == "]":
            a = text.rfind("[", low, high)
            m = _INDEX.fullmatch(text, a, high) if a >= 0 else None
            if m is None:
                return None
            path = self.plain(low, a)
            return f"{path}.{m[1]}" if path else m[1]
        if last in "\"'":
            a = high - 1
            while a > low and high - a <= 81 and text[a - 1] not in "\"'":
                a -= 1
            return text[a : high - 1] if a > low and text[a - 1] in "\"'" and _QUOTED.fullmatch(text, a, high - 1) else None
        return self.plain(low, high)

    def plain(self, low: int, high: int) -> str | None:
        text, a = self.text, high
        while a > low and _WORD.match(text, a - 1):
            a -= 1
        parts = text[a:high].split(".")
        begin, at = None, high + 1
        for p in reversed(parts):  # a part that begins like a name may have another before it
            at -= len(p) + 1
            m = _START.search(p)
            if m is None:
                break
            begin = at + m.start()
            if m.start():
                break
        return None if begin is None else text[begin:high]

    def bracketed(self, at: int, callee: str) -> tuple[int, list]:
        """The end of the bracket that opens at ``at``, and the items in it: strings and names that are no keys, callees or names to look up. Of a map
        within, only its keys' own assignments count. One that never closes counts up to the line's end or the next operator."""
        text = self.text
        while self.inside and self.inside[-1] <= at:
            self.inside.pop()
        flat = len(self.inside) >= NESTED
        stop = len(text) if at not in self.open_ended else self.short(at)
        items: list = []
        ends: list[int] = []
        stack: list[tuple[str, bool, int]] = []  # bracket, whether its next string is looked up, place
        maps = 0  # braces open within the outermost bracket
        pos, word = at, callee
        while m := _INSIDE.search(text, pos, stop):
            pos = m.end()
            if m["open"]:
                if flat and stack:
                    return m.start(), items
                index = m["open"] == "[" and bool(word)
                maps += bool(stack) and m["open"] == "{"
                stack.append((m["open"], index or m["open"] == "(" and bool(_LOOKUP.search(word)), m.start()))
                word = ""
            elif m["close"]:
                closed = stack.pop()
                maps -= bool(stack) and closed[0] == "{"
                if not stack:
                    self.inside.append(pos)
                    return pos, items
            elif m["string"] is not None:
                d = 3 if m["string"][:3] == '"""' and len(m["string"]) >= 6 else 1
                lookup = stack[-1][1]
                stack[-1] = (stack[-1][0], False, stack[-1][2])
                if not lookup and not maps and not _KEY_ENDS.match(text, pos):
                    more = [Literal(m.start() + d, pos - d, text), *_INNER.findall(text, m.start() + d, pos - d)]
                    items += more
                    ends += [pos] * len(more)
                word = ""
            elif m["word"]:
                word = m["word"] if text[pos : pos + 1] in ("(", "[") else ""
                if not word and not _KEY_ENDS.match(text, pos):
                    items.append(m["word"])
                    ends.append(pos)
            else:
                stack[-1] = (stack[-1][0], False, stack[-1][2])
        if stop == len(text):
            self.open_ended.update(p for _, _, p in stack)
        end = self.short(at)
        return end, [x for x, e in zip(items, ends) if e <= end]

    def short(self, at: int) -> int:
        """Where a bracket ends that never closes."""
        if at > self.line_end:
            end = self.text.find("\n", at)
            self.line_end = len(self.text) if end < 0 else end
        end = self.line_end
        k = bisect_left(self.at, at)
        return min(end, self.at[k]) if k < len(self.at) else end

    def bare(self, a: int) -> int:
        """The end of the literal that begins at ``a`` in the last unbroken word."""
        _, b, chain = self.word
        if chain:
            k = bisect_left(self.at, a)
            b = min(b, self.at[k]) if k < len(self.at) else b
            amp = self.text.find("&", a, b)
            return b if amp < 0 else amp
        m = _NEXT_PARAMETER.search(self.text, a, b)
        return m.start() if m else b

    def pairs(self) -> list[tuple[str, list]]:
        text, out, pos, last = self.text, [], 0, 0
        for start, end, op in self.ops:
            low, last = max(pos, last), end
            if start < pos or (name := self.name(low, start)) is None:
                continue
            if op == ":" and (t := _TYPE.match(text, end)):
                op, end = t["op"], t.end()
            at, items, quoted = _BLANKS.match(text, end).end(), [], False
            while True:
                i = None
                if not (self.word[0] <= at < self.word[1] - 2 and text[at] != "$"):  # else within a word that is known already
                    i = _ITEM.match(text, at)
                    if i is None:
                        if text[at : at + 1] not in ("(", "[", "{") or not text[at : at + 1]:
                            break
                        at, more = self.bracketed(at, "")
                        items += more
                    elif i["bare"] is not None:
                        self.word = (at, i.end(), text.count("=", at, i.end()) > CHAIN)
                if i is not None and i["string"] is not None:
                    quoted = True
                    raw = i["string"]
                    q = len(raw) - len(raw.lstrip("abfrtuABFRTU")) if raw[0] not in "\"'`" else 0
                    d = 3 if raw[q : q + 3] == '"""' and len(raw) - q >= 6 else 1
                    a, b = i.start("string") + q + d, i.end("string") - d
                    items.append(Literal(a, b, text))
                    items += _INNER.findall(text, a, b)
                    at = i.end()
                elif i is not None and i["var"] is not None:
                    items.append(i["var"])
                    at = i.end()
                elif self.word[0] <= at < self.word[1]:
                    a, word_end = at, self.word[1]
                    if text[word_end : word_end + 1] in ("(", "[") and text[word_end : word_end + 1] and _IDENT.fullmatch(text, a, word_end):
                        at, more = self.bracketed(word_end, text[a:word_end])  # a call's or an index's name is no literal
                        items += more
                    else:
                        at = b = self.bare(a)
                        while b > a and text[b - 1] in ".:!?":
                            b -= 1
                        if b > a and not (op == ":" and _ASSIGN.match(text, a)):
                            items.append(Literal(a, b, text))
                            if _IDENT.fullmatch(text, a, b):
                                items.append(text[a:b])
                            if _SCHEME.fullmatch(text, a, b) and (t := _AFTER_SCHEME.match(text, at)):
                                items.append(Literal(t.start("bare"), t.end("bare"), text))
                plus = _PLUS.match(text, at)
                if not plus:
                    break
                at = plus.end()
            out.append((name, items))
            # a bare value may itself hold an assignment, as in "conf: password=x"
            pos = at if quoted else end
        return out


def lex(text: str) -> list[tuple[str, list]]:
    """``(name, items)`` of each assignment, in order; an item is a ``Literal`` or the name of another."""
    return _Lexer(text).pairs()


def findings(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """``(start, end, name, score)`` of the secret literals of a text (character offsets), by offset, one for each literal."""
    pairs = lex(text)
    if not pairs:
        return []
    holders: dict[str, list[int]] = {}  # constants: pairs that mention a name use what it was given
    for k, (name, _) in enumerate(pairs):
        for alias in {name, name.rsplit(".", 1)[-1]}:
            holders.setdefault(alias, []).append(k)
    # how sensitive each pair is, by its own name or by a pair that takes its value from it; the most sensitive first, so each name is passed on once
    known = {n: sensitivity(n) for n in {n for n, _ in pairs}}
    level = [known[n] for n, _ in pairs]
    reason = [n for n, _ in pairs]
    todo = [(-x, k) for k, x in enumerate(level) if x > 0]
    heapify(todo)
    passed: set[str] = set()
    while todo:
        x, k = heappop(todo)
        if -x < level[k]:
            continue
        for item in pairs[k][1]:
            if isinstance(item, str) and item not in passed and item in holders:
                passed.add(item)
                for src in holders[item]:
                    if level[src] < level[k]:
                        level[src], reason[src] = level[k], reason[k]
                        heappush(todo, (-level[k], src))
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for k, (_, items) in enumerate(pairs):
        if level[k] <= 0:
            continue
        for item in items:
            if isinstance(item, Literal) and (value := item.value) not in holders:
                s = round(level[k] * max(strength(value), 0.6 * is_passphrase(reason[k], value)), 4)
                if s >= threshold and s > best.get((item.start, item.end), ("", 0.0))[1]:
                    best[item.start, item.end] = (reason[k], s)
    out, last = [], -1
    for (a, b), (n, s) in sorted(best.items()):
        if a >= last:
            out.append((a, b, n, s))
            last = b
    return out


def may_assign(column: pa.Array) -> list[bool]:
    """False for a text without '=' and ':', in which nothing can be assigned."""
    return pc.or_(pc.match_substring(column, "="), pc.match_substring(column, ":")).fill_null(False).to_pylist()


_FINDING = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("literal", T.StringType()),
])


@F.arrow_udf(T.ArrayType(_FINDING))
def find_udf(text: pa.Array) -> pa.Array:
    out = []
    for t, maybe in zip(text, may_assign(text)):
        s = t.as_py() if maybe else ""
        out.append([{"start": a, "end": b, "name": n, "score": x, "literal": s[a:b]} for a, b, n, x in findings(s)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64()), ("literal", pa.string())]))
    return pa.array(out, kind)


@F.arrow_udf(T.StringType())
def redact_udf(text: pa.Array) -> pa.Array:
    maybe = may_assign(text)
    changed: dict[int, str] = {}
    for k, yes in enumerate(maybe):
        if yes:
            s = text[k].as_py()
            found = findings(s)
            if found:
                parts, at = [], 0
                for a, b, _, _ in found:
                    parts += [s[at:a], MASK]
                    at = b
                changed[k] = "".join([*parts, s[at:]])
    if not changed:
        return text
    mask = pa.array([k in changed for k in range(len(text))])
    return pc.replace_with_mask(text, mask, pa.array([changed[k] for k in sorted(changed)], text.type))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, end, name, score, literal_sha256, literal_length)``: a row for each secret literal of each row.

    The literal itself is not shown, only its hash. Offsets are characters of the whole text, from 0. A null or empty text has no findings; the row of
    a repeated document repeats its findings; an empty table gives an empty result; other columns are not read."""
    got = docs.select(col(id_col).alias(id_col), F.explode(find_udf(col(text_col))).alias("f"))
    return got.select(
        id_col, F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.name").alias("name"), F.col("f.score").alias("score"),
        F.sha2("f.literal", 256).alias("literal_sha256"), F.length("f.literal").cast("bigint").alias("literal_length"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with each secret literal replaced by ``MASK`` and ``length_col``, if there is one, set anew where the text changed. All rows
    stay, null and empty texts as they are."""
    new = redact_udf(col(text_col))
    names = docs.columns
    got = docs.select(*[new.alias(c) if c == text_col else col(c) for c in names])
    if length_col not in names:
        return got
    kind = docs.schema[length_col].dataType
    n = F.length(col(text_col)).cast(kind)
    return got.withColumn(length_col, F.when(F.contains(col(text_col), F.lit(MASK)), n).otherwise(col(length_col)))

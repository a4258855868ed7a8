"""Operator 5: bits per byte of each document by online logistic context mixing.

Each byte is predicted bit by bit by one predictor for each context order (the last 1, 2 and 4 bytes).
A predictor looks its context and the bits of the byte so far up in exact corpus-wide counts, which grow with the corpus,
and gives the log odds of a one, scaled by a gate that opens with the number of observations. The log odds
are added under a weight set that the bit's position and the number of orders that know the context select; every block of ``BLOCK`` bytes starts from the same
weights and each coded bit refines the set that predicted it. Counts are gathered from all documents, and a document's own are taken out before it is predicted.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import col, cut, shared_dir

#: Bytes of context that an n-gram has.
ORDERS = 4
#: Bytes of context of each predictor, from the nearest.
USED = (1, 2, 4)
#: Step by which a bit's coding error moves the weights that predicted it.
RATE = np.float32(0.02)
#: Bytes after which a text's weights start anew, so that the blocks of a long text are coded side by side. Contexts go on across blocks.
BLOCK = 4096
#: Bytes whose log odds are computed at once; what they need stays in the processor's cache.
CHUNK = 1 << 15
#: Weight sets of each bit position: one for each number of orders that know the context.
SETS = len(USED) + 1
#: Weights of each set against what comes, by (order, bit), before the first byte.
START = np.full((len(USED), 8), -0.33, np.float32)
_CLIP = 8.0
_ONE = np.float32(1)
#: Mixed log odds are held within this; eight factors 1 + e^10 fit a float32.
_LIMIT = np.float32(10)
_LN2 = float(np.log(2))
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def ngram_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte, in 40 bits from the top: the byte itself, then the four bytes before it in its row, the
    nearest first (0 before the row's start)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[7:-1] = data
    key = np.ndarray((len(data),), "<u8", padded, 0, (1,)) >> np.uint64(24)
    start, end = off[:-1], off[1:]
    for j in range(ORDERS):
        at = start + j
        key[at[at < end]] &= np.uint64(((1 << 40) - 1) ^ ((1 << (8 * (ORDERS - j))) - 1))
    return key


class Grams:
    """Numbers distinct keys in the order in which they come. Two hash tables and a sorted overflow; nothing is ever moved."""

    BITS = 20

    def __init__(self):
        self.keys = np.zeros(1 << 16, np.uint64)
        self.n = 0
        self.tab = [np.full(1 << self.BITS, 2**64 - 1, np.uint64) for _ in range(2)]
        self.num = [np.zeros(1 << self.BITS, np.int32) for _ in range(2)]
        self.over = np.zeros(0, np.uint64)
        self.over_num = np.zeros(0, np.int32)

    def _slot(self, k: np.ndarray, t: int) -> np.ndarray:
        return (k * _MULT[t]) >> np.uint64(64 - self.BITS)

    def _known(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self._slot(k, 0)
        out = self.num[0][h]
        rest = np.flatnonzero(self.tab[0][h] != k)
        if len(rest):
            kr = k[rest]
            h = self._slot(kr, 1)
            out[rest] = self.num[1][h]
            miss = self.tab[1][h] != kr
            rest, kr = rest[miss], kr[miss]
        if len(rest) and len(self.over):
            at = np.minimum(np.searchsorted(self.over, kr), len(self.over) - 1)
            hit = self.over[at] == kr
            out[rest[hit]] = self.over_num[at[hit]]
            rest = rest[~hit]
        return out, rest

    def number(self, k: np.ndarray) -> np.ndarray:
        out, rest = self._known(k)
        if len(rest):
            new = np.unique(k[rest])
            num = np.arange(self.n, self.n + len(new), dtype=np.int32)
            while self.n + len(new) > len(self.keys):
                self.keys = np.concatenate([self.keys, np.zeros(len(self.keys), np.uint64)])
            self.keys[self.n : self.n + len(new)] = new
            self.n += len(new)
            for t in range(2):
                h = self._slot(new, t)
                free = self.tab[t][h] == np.uint64(2**64 - 1)
                _, one = np.unique(h, return_index=True)
                first = np.zeros(len(h), bool)
                first[one] = True
                free &= first
                self.tab[t][h[free]] = new[free]
                self.num[t][h[free]] = num[free]
                new, num = new[~free], num[~free]
            if len(new):
                order = np.argsort(over := np.concatenate([self.over, new]))
                self.over, self.over_num = over[order], np.concatenate([self.over_num, num])[order]
            out[rest] = self._known(k[rest])[0]
        return out


#: Distinct n-grams that a worker holds before it passes its counts on, or forgets its log odds.
HELD = 1 << 19


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, counts = Grams(), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams.keys[: grams.n].astype(np.int64)), pa.array(counts)], ["key", "n"])

    for batch in batches:
        data, off = tn.flat(batch.column(0))
        for i, j in tn.slices(off, 1 << 20):
            if off[i] == off[j]:
                continue
            which = grams.number(ngram_keys(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            more = np.bincount(which, minlength=grams.n)
            more[: len(counts)] += counts
            counts = more
            if grams.n > HELD:
                yield out()
                grams, counts = Grams(), np.zeros(0, np.int64)
    if grams.n:
        yield out()


def context_bytes(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes, the nearest first, and then the byte itself, of each key."""
    return ((keys & np.uint64(2**32 - 1)) >> np.uint64(8 * (ORDERS - order)) << np.uint64(8)) | (keys >> np.uint64(32))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n[order], head) if len(head) else np.zeros(0, np.int64)


#: Distinct n-grams in one part of the written table, about.
PART = 1 << 20


def _write_parts(folder: str):
    """Writes a part's counts of the orders over 1; gives its first two context bytes and its counts of order 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        key, n = (np.concatenate(x) for x in zip(*held))
        del held
        first = int((key >> np.uint64(16) & np.uint64(0xFFFF)).min())
        for o in USED[1:]:
            k, c = _summed(context_bytes(key, o), n)
            for what, x in (("key", k), ("sum", np.append(0, np.cumsum(c)))):
                draft = f"{folder}/{uuid.uuid4().hex}.tmp"
                with open(draft, "wb") as f:
                    np.save(f, x)
                os.replace(draft, f"{folder}/{first}-{o}-{what}.npy")
        k, c = _summed(context_bytes(key, 1), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), first, np.int32)), pa.array(k.astype(np.int64)), pa.array(c)], ["first", "key", "n"])

    return run


class Counts:
    """Exact counts of the n-grams of a corpus: sorted tables in files that all workers map, which grow with the distinct n-grams, in parts by
    the two nearest context bytes. Order 1 has 2^16 n-grams at most and is held."""

    def __init__(self, folder: str, first: np.ndarray, one: np.ndarray):
        self.folder, self.first = folder, first
        self.one = np.append(0, np.cumsum(one))
        self.open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _part(self, part: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        if (part, order) not in self.open:
            name = f"{self.folder}/{self.first[part]}-{order}"
            self.open[part, order] = np.load(f"{name}-key.npy", mmap_mode="r"), np.load(f"{name}-sum.npy", mmap_mode="r")
        return self.open[part, order]

    def totals(self, keys: np.ndarray) -> np.ndarray:
        """``(len(keys), len(USED), 9)``: how often the context came with the first 0 to 8 bits of the key's byte."""
        out = np.zeros((len(keys), len(USED), 9), np.float32)
        if not len(self.first):
            return out
        by = np.argsort(context_bytes(keys, ORDERS))
        keys = keys[by]
        part = np.searchsorted(self.first, (keys >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64), side="right") - 1
        got = np.zeros_like(out)
        for place, o in enumerate(USED):
            k = context_bytes(keys, o)
            if o == 1:
                spans = [(0, len(k), None, self.one)]
            else:
                head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
                spans = [(a, b, *self._part(int(part[a]), o)) for a, b in zip(head, np.append(head[1:], len(part))) if part[a] >= 0]
            for a, b, known, sums in spans:
                for i in range(9):
                    low = k[a:b] >> np.uint64(8 - i) << np.uint64(8 - i)
                    high = low + np.uint64(1 << (8 - i))
                    if known is not None:
                        low, high = np.searchsorted(known, low), np.searchsorted(known, high)
                    got[a:b, place, i] = sums[high] - sums[low]
        out[by] = got
        return out


def stretch(total: np.ndarray) -> np.ndarray:
    """From ``totals``, of each bit: log odds of what came, clipped, times the gate n / (n + 0.5)."""
    n, came = total[..., :-1], total[..., 1:]
    odds = came + np.float32(0.02)
    other = n - came
    other += np.float32(0.02)
    odds /= other
    np.log(odds, out=odds)
    np.clip(odds, -_CLIP, _CLIP, out=odds)
    np.add(n, np.float32(0.5), out=other)
    np.divide(n, other, out=other)
    odds *= other
    return odds


def fit(docs: DataFrame, text_col: str = "text") -> Counts:
    """The counts of the n-grams of every text of ``docs``. They are written to the shared folder, which must be mounted where workers run."""
    spark = docs.sparkSession
    grams = docs.select(col(text_col).alias("t")).mapInArrow(_count, "key bigint, n bigint")
    total = cut(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    base = shared_dir(spark)
    if "://" in base and not base.startswith("file://"):
        raise ValueError("spark.checkpoint.dir must be a folder that is mounted on every worker (file://): the n-gram counts are mapped from it")
    folder = f"{base.removeprefix('file://').removeprefix('file:')}/tessera-{spark.sparkContext.applicationId}/counts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    parts = max(1, -(-total.count() // PART))
    near = F.shiftright("key", 16).bitwiseAND(0xFFFF)
    got = total.repartitionByRange(parts, near).mapInArrow(_write_parts(folder), "first int, key bigint, n bigint")
    got = got.groupBy("key").agg(F.sum("n").alias("n"), F.collect_set("first").alias("first")).toArrow()
    one = np.zeros(1 << 16, np.int64)
    one[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return Counts(folder, np.unique(got.column("first").combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0, np.int64)), one)


#: By the exclusive or of two bytes, how many of their first bits agree; -1 for more than a byte.
_AGREE = np.array([8 - x.bit_length() for x in range(256)] + [-1], np.int8)


def _levels(k: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """``(len(k), 9)``: how often each context came with the first 0 to 8 bits of the key's byte. ``k`` are distinct keys in order, context before byte; the first i of them
    came ``upto[i]`` times."""
    agree = _AGREE[np.minimum(k[1:] ^ k[:-1], np.uint64(256)).astype(np.intp)]
    level = np.empty((len(k), 9), np.float32)
    level[:, 8] = upto[1:] - upto[:-1]
    for i in range(8):  # the n-grams that share their context and first i bits lie side by side
        at = np.flatnonzero(agree < i) + 1
        a, b = np.append(0, at), np.append(at, len(k))
        level[:, i] = np.repeat((upto[b] - upto[a]).astype(np.float32), b - a)
    return level


def own_totals(row: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What ``Counts.totals`` would give for each row's n-grams if only that row were counted. ``keys`` came ``n`` times in ``row`` (below 2^24)."""
    out = np.empty((len(keys), len(USED), 9), np.float32)
    if not len(keys):
        return out
    for place, o in enumerate(USED):
        k = row.astype(np.uint64) << np.uint64(40) | context_bytes(keys, o)
        by = np.argsort(k)
        k = k[by]
        ends = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        out[by, place] = np.repeat(_levels(k[ends[:-1]], np.append(0, np.cumsum(n[by]))[ends]), np.diff(ends), axis=0)
    return out


class Coder:
    """Costs of texts under one table. It remembers the totals of the n-grams it met. With ``within``, the texts are among those counted, and each
    is predicted from the counts of all the others."""

    def __init__(self, table: Counts, within: bool):
        self.table, self.within = table, within
        self._forget()

    def _forget(self) -> None:
        self.grams = Grams()
        self.totals = np.zeros((1 << 16, len(USED), 9), np.float32)
        self.done = 0

    def _numbers(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams of each byte; ``totals`` then holds their counts."""
        if self.grams.n > HELD:
            self._forget()
        which = self.grams.number(ngram_keys(data, off))
        if self.grams.n > len(self.totals):
            more = np.zeros((self.grams.n * 5 // 4, len(USED), 9), np.float32)
            more[: self.done] = self.totals[: self.done]
            self.totals = more
        for a in range(self.done, self.grams.n, 1 << 16):
            b = min(self.grams.n, a + (1 << 16))
            self.totals[a:b] = self.table.totals(self.grams.keys[a:b])
        self.done = self.grams.n
        return which

    def _signed(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(at, x, seen)``: for each byte and predictor its place in ``x``, the log odds of the bits that came, and in ``seen``, how many predictors know the byte's
        context. What a row repeats of a predictor's contexts and bytes is computed once."""
        which = self._numbers(data, off)
        at, seen = np.empty((len(data), len(USED)), np.int32), np.zeros(len(data), np.int64)
        xs, base = [], 0
        for i, j in tn.slices(off, CHUNK):
            a, b = off[i], off[j]
            if a == b:
                continue
            keys = self.grams.keys[which[a:b]]
            row = np.repeat(np.arange(j - i, dtype=np.uint64) << np.uint64(40), np.diff(off[i : j + 1]))
            for place, o in enumerate(USED):
                k = row | context_bytes(keys, o)
                by = np.argsort(k)
                k = k[by]
                new = np.append(True, k[1:] != k[:-1])
                head = np.flatnonzero(new)
                inverse = np.empty(b - a, np.int64)
                inverse[by] = np.cumsum(new) - 1
                total = self.totals[which[a:b][by[head]], place]
                if self.within:
                    total -= _levels(k[head], np.append(head, b - a))
                at[a:b, place] = inverse + base
                base += len(head)
                seen[a:b] += (total[:, 0] > 0)[inverse]
                xs.append(stretch(total))
        return at, np.concatenate(xs), seen

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits that each row's bytes cost. All blocks of all rows go on a byte at a time; each has weights of its own, which every bit that came moves."""
        cost = np.zeros(len(off) - 1)
        if not len(data):
            return cost
        at, x_of, seen_of = self._signed(data, off)
        blocks = -(-np.diff(off) // BLOCK)
        owner = np.repeat(np.arange(len(blocks)), blocks)
        begin = off[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        size = np.minimum(off[1:][owner] - begin, BLOCK)
        rows = np.argsort(-size, kind="stable")
        start, size = begin[rows], size[rows]
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left").tolist()  # rows longer than t
        weights = np.repeat(START[None], len(rows) * SETS, axis=0)
        base = np.arange(len(rows)) * SETS
        total = np.zeros(len(rows))
        for t, n in enumerate(live):
            here = start[:n] + t
            x = x_of.take(at.take(here, axis=0), axis=0)
            sets = base[:n] + seen_of.take(here)
            w = weights.take(sets, axis=0)
            z = np.einsum("noi,noi->ni", w, x)  # of each bit: log odds against what came
            np.minimum(z, _LIMIT, out=z)
            np.exp(z, out=z)
            one = z + _ONE
            total[:n] += np.log(np.multiply.reduce(one, axis=1))
            z /= one  # the coding error of each bit
            z *= RATE
            x *= z[:, None]
            w -= x
            weights[sets] = w
        return np.bincount(owner[rows], total / _LN2, minlength=len(cost))


_CODERS: dict[str, Coder] = {}


def _coder(name: str, sent, within: bool) -> Coder:
    """One coder for each Python worker, kept from task to task."""
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(sent.value, within)
    return _CODERS[name]


def score(docs: DataFrame, table: Counts | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, total_bits, bits_per_byte)`` for each row. The table is fitted on ``docs`` itself if none is given, and each row's own counts are then taken out
    before it is predicted; a given table is used as it is.

    A null text has null results; an empty one costs 0 bits and has a null rate. Every byte of a text is coded. Rows repeat as in the input and
    equal texts cost alike, wherever they stand; an empty table gives an empty result. Other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col) if table is None else table)  # names of files, and order 1

    name, within = uuid.uuid4().hex, table is None

    @F.arrow_udf(T.DoubleType())
    def run(text: pa.Array) -> pa.Array:
        coder = _coder(name, sent, within)
        # rows of like length are coded together, so that few steps have few rows
        order = np.argsort(np.diff(tn.flat(text)[1]), kind="stable")
        data, off = tn.flat(text.take(pa.array(order)))
        out = np.zeros(len(order))
        for i, j in tn.slices(off, 3 << 18):
            out[order[i:j]] = coder.bits(data[off[i] : off[j]], off[i : j + 1] - off[i])
        return pa.array(out, mask=np.asarray(text.is_null()))

    got = docs.select(col(id_col).alias(id_col), F.octet_length(col(text_col)).cast("bigint").alias("n_bytes"), F.round(run(col(text_col)), 2).alias("total_bits"))
    return got.withColumn("bits_per_byte", F.round(F.try_divide("total_bits", "n_bytes"), 4))

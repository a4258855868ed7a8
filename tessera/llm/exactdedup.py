"""Operator 7: exact deduplication with two Bloom passes.

Pass one sends the 8-byte hash of each text, with the number of the file it stands in, to the shard that the hash's upper bits name; repeats
inside a task go before that, so a hot text sends one hash a task. A shard keeps two Bloom filters: a hash whose bits are all set in the first already is set
in the second, "possibly repeated". The shard then tells each file which of its hashes are in the second filter. Pass two tests every row against the
filter of its own file: a row that is not in it is surely the only one of its kind and passes straight through; only the others are shuffled by
text, and the first of each text stays. A false positive only shuffles a row in vain, so the result is exact. No text moves but theirs, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import col, cut, fresh

#: Bits of a filter for each hash, and bits set for each hash.
BITS_PER_ROW = 16
PROBES = 4
#: Hashes of a shard; its filters take 16 MB each while it works.
SHARD_ROWS = 1 << 20
#: Most bytes of file filters that one broadcast holds. Files are divided into so many groups that none needs more, and each group has its own.
BROADCAST_BYTES = 64 << 20
#: Rows among which a task drops repeated hashes before they are shuffled.
HELD = 1 << 18


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """``(n, PROBES)`` bit positions by double hashing."""
    a, b = tn.mix64(h, 1), tn.mix64(h, 2) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class Bloom:
    """A filter that is being built, a byte for each bit."""

    def __init__(self, bits: int):
        self.bits = bits
        self.on = np.zeros(bits, bool)

    def add(self, h: np.ndarray) -> None:
        self.on[probes(h, self.bits).ravel()] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.on[probes(h, self.bits)].all(axis=1)

    def raw(self) -> bytes:
        return np.packbits(self.on, bitorder="little").tobytes()


def packed_has(raw: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a finished filter has; it stays packed."""
    at = probes(h, 8 * len(raw))
    return (raw[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).all(axis=1)


def feed(first: Bloom, second: Bloom, h: np.ndarray) -> None:
    """Hashes into the pair of filters, as if one by one."""
    seen = first.has(h)
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    second.add(h[seen | again])
    first.add(h)


def _distinct(shards: int):
    """``(shard, h, file, many)``: each hash once for each file and HELD rows; many says that it came more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> pa.RecordBatch:
            h, f = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((f, h))
            h, f = h[order], f[order]
            head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])))
            many = np.diff(np.append(head, len(h))) > 1
            shard = ((h[head].view(np.uint64) >> np.uint64(7)) % np.uint64(shards)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h[head]), pa.array(f[head]), pa.array(many)], ["shard", "h", "file", "many"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                n += b.num_rows
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def _shard_filters(bits: int):
    """``(file, h)`` of the hashes that are possibly repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            shard = batch.column(0).to_numpy()
            h, f, many = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for s in np.unique(shard):
                k = shard == s
                by.setdefault(int(s), []).append((h[k].view(np.uint64), f[k], many[k]))
        for parts in by.values():
            first, second = Bloom(bits), Bloom(bits)
            for h, _, many in parts:
                feed(first, second, h)
                second.add(h[many])
            for h, f, _ in parts:
                k = second.has(h)
                yield pa.RecordBatch.from_arrays([pa.array(f[k]), pa.array(h[k].view(np.int64))], ["file", "h"])

    return run


def _file_filter(t: pa.Table) -> pa.Table:
    h = np.unique(t.column("h").to_numpy()).view(np.uint64)
    own = Bloom(-(-max(1 << 10, BITS_PER_ROW * len(h)) // 8) * 8)
    own.add(h)
    return pa.table({"file": t.column("file").slice(0, 1), "raw": pa.array([own.raw()], pa.binary())})


def possibly_repeated(hashes: DataFrame, rows: int) -> DataFrame:
    """``(file, h)``: the hashes of each file that may come again, in it or in another, from one row ``(h, file)`` for each text; surely all that do."""
    shards = max(-(-rows // SHARD_ROWS), min(16, rows // 2000 + 1))
    bits = max(1 << 10, BITS_PER_ROW * -(-rows // shards))
    routed = hashes.mapInArrow(_distinct(shards), "shard int, h bigint, file bigint, many boolean")
    return routed.repartition(shards, "shard").mapInArrow(_shard_filters(bits), "file bigint, h bigint")


def _file_of(docs: DataFrame):
    """A number for the file that each row stands in, by its path; None where ``docs`` is not a table of files."""
    try:
        path = docs.metadataColumn("_metadata").getField("file_path")
        docs.select(path)
        return F.xxhash64(path)
    except AnalysisException:
        return None


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each text; all columns stay.

    Texts are compared byte by byte, over their whole length; the empty text is a text like any other. A null text has nothing to compare: its rows all
    stay. A null id counts as the largest. Among rows with one text and id, repeated rows become one and of unlike ones the
    first in the order of their JSON stays. An empty table stays as it is. Working columns take names that ``docs`` does not have. A table that is not
    read from files is written to the shared folder first."""
    spark = docs.sparkSession
    file = _file_of(docs)
    if file is None:
        docs = cut(docs, "docs")
        file = _file_of(docs)
    rows = docs.count()
    if rows == 0:
        return docs
    hash_name, file_name = fresh(docs, "_hash", "_file")
    hashed = F.xxhash64(col(text_col))
    pairs = docs.where(col(text_col).isNotNull()).select(hashed.alias("h"), file.alias("file"))
    marks = cut(possibly_repeated(pairs, rows), "marks")
    filters = cut(marks.groupBy("file").applyInArrow(_file_filter, "file bigint, raw binary"), "bloom")
    size = filters.agg(F.sum(F.octet_length("raw")), F.max(F.octet_length("raw"))).first()
    # groups of files by their numbers, so many that a group's filters stay under the limit with room for chance
    groups = 1 if (size[0] or 0) <= BROADCAST_BYTES else -(-2 * size[0] // BROADCAST_BYTES)
    names = docs.columns
    once = maybe = None
    for g in range(groups):
        of = lambda f: F.pmod(f, F.lit(groups)) == g  # noqa: B023, E731
        own = filters if groups == 1 else filters.where(of(F.col("file")))
        sent = spark.sparkContext.broadcast({r["file"]: bytes(r["raw"]) for r in own.collect()})
        part = docs if groups == 1 else docs.where(of(file))
        part = part.withColumn(hash_name, hashed).withColumn(file_name, file)
        flag = F.coalesce(_tester(sent)(col(hash_name), col(file_name)), F.lit(False)) & col(text_col).isNotNull()
        a, b = (part.where(x).select(*map(col, names)) for x in (~flag, flag))
        once, maybe = (a, b) if once is None else (once.unionByName(a), maybe.unionByName(b))
    row = F.struct(*map(col, names))
    rest = [c for c in names if c != text_col]
    order = F.struct(col(id_col).isNull(), col(id_col), F.to_json(F.struct(*map(col, rest))) if rest else F.lit(""))
    best = maybe.groupBy(col(text_col).alias("_t")).agg(F.min_by(row, order).alias("_r"))
    kept = best.select(*[F.col("_r").getField(c).alias(c) for c in names])
    return once.unionByName(kept)


def _tester(sent):
    @F.arrow_udf(T.BooleanType())
    def maybe(h: pa.Array, file: pa.Array) -> pa.Array:
        blooms = sent.value
        x, f = h.fill_null(0).to_numpy(zero_copy_only=False), file.to_numpy(zero_copy_only=False)
        out = np.zeros(len(x), bool)
        for one in np.unique(f):
            if (raw := blooms.get(int(one))) is not None:
                k = np.flatnonzero(f == one)
                out[k] = packed_has(np.frombuffer(raw, np.uint8), x[k].view(np.uint64))
        return pa.array(out)

    return maybe

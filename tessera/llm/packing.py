"""Operator 4: best-fit packing of documents into training sequences, with certified bin counts.

A document longer than the capacity is cut, between characters, into pieces that fill a bin each, but for at most three bytes, and a remainder. Whole
documents and all pieces that leave room are packed by best-fit decreasing in each partition. Dual feasible functions give a lower bound
on the bins of any packing of a partition; where best fit meets it, the count is certified as optimal. Partitions with a
gap give up the documents of their worst filled bins and exchange them, eight partitions in a group; a group packs them anew, and its new bins stand where they are
fewer. Exchanges go on, with other groups each time, until none saves a bin or no two partitions have a gap.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import col, cut

#: Units (UTF-8 bytes of text) of a sequence.
CAPACITY = 8192
#: Pieces that one partition packs; the number of partitions follows from it.
PER_PARTITION = 20_000
#: Partitions with a gap that exchange documents with one another.
GROUP = 8
#: Bins filled less than this share of the capacity give up their documents.
LOOSE = 0.97


def best_fit_decreasing(size: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece; every size is in 0..capacity. Ties keep the given order."""
    order = np.argsort(-size, kind="stable")
    out = np.zeros(len(size), np.int64)
    open_at: dict[int, list[int]] = {}  # free space -> bins, the last opened on top
    spaces: list[int] = []
    bins = 0
    for k, s in zip(order.tolist(), size[order].tolist()):
        i = bisect_left(spaces, s)
        if i < len(spaces):
            free = spaces[i]
            held = open_at[free]
            b = held.pop()
            if not held:
                del open_at[free]
                spaces.pop(i)
        else:
            b, free = bins, capacity
            bins += 1
        out[k] = b
        left = free - s
        if left in open_at:
            open_at[left].append(b)
        else:
            open_at[left] = [b]
            insort(spaces, left)
    return out


def lower_bound(size: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual feasible functions.

    A dual feasible function f maps sizes so that no set that fits a bin sums to more than f(capacity);
    then the sum of f over f(capacity) bounds the count. u_e: sizes over C - e count whole, sizes under e count nothing. f_k: floor((k + 1) s / C)
    rounds down unless (k + 1) s / C is an integer."""
    size = size[size > 0].astype(np.int64)
    if not len(size):
        return 0
    best = -(-int(size.sum()) // capacity)
    s = np.sort(size)
    cum = np.concatenate([[0], np.cumsum(s)])
    eps = np.unique(np.concatenate([[1], s[s <= capacity // 2]]))
    big = len(s) - np.searchsorted(s, capacity - eps, side="right")
    mid = cum[len(s) - big] - cum[np.searchsorted(s, eps, side="left")]
    best = max(best, int((big + -(-mid // capacity)).max()))
    for k in range(1, 21):
        x = (k + 1) * s
        whole = x % capacity == 0
        f = np.where(whole, s * k, (x // capacity) * capacity)
        best = max(best, -(-int(f.sum()) // (k * capacity)))
    return best


_PIECES = "part bigint, id bigint, piece bigint, start bigint, size bigint"
_PACKED = "part bigint, id bigint, piece bigint, start bigint, size bigint, bin bigint, fill bigint, gap bigint"


def _packed(t: pa.Table, capacity: int, part: int) -> pa.Table:
    keys = [t.column(c).fill_null(-(2**63)).to_numpy() for c in ("start", "piece", "id")]
    t = t.take(pa.array(np.lexsort(keys)))
    size = t.column("size").to_numpy()
    b = best_fit_decreasing(size, capacity)
    bins = int(b.max()) + 1 if len(b) else 0
    fill = np.bincount(b, size, minlength=bins).astype(np.int64)
    gap = max(0, bins - max(1, lower_bound(size, capacity)))
    same = lambda x: pa.array(np.full(len(b), x, np.int64))
    return pa.table({"part": same(part), **{c: t.column(c) for c in ("id", "piece", "start", "size")}, "bin": pa.array(b), "fill": pa.array(fill[b]), "gap": same(gap)})


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        return _packed(t, capacity, t.column("part")[0].as_py())

    return run


def _exchange(capacity: int, turn: int):
    """A group's documents packed anew, as a partition of its own, if that saves bins, or as they were; ``saved`` says how many."""

    def run(t: pa.Table) -> pa.Table:
        old = t.group_by(["part", "bin"]).aggregate([]).num_rows
        new = _packed(t, capacity, turn << 40 | t.column("club")[0].as_py())
        saved = max(0, old - (int(new.column("bin").to_numpy().max()) + 1))
        out = new if saved else t.select(new.column_names)
        return out.append_column("saved", pa.array(np.full(len(out), saved, np.int64)))

    return run


@F.arrow_udf(T.ArrayType(T.LongType()))
def _character_cuts(text: pa.Array, capacity: pa.Array) -> pa.Array:
    """Where the pieces of each text begin, in bytes; null for null."""
    room = capacity[0].as_py() if len(capacity) else 1
    data, off = tn.flat(text)
    out: list[list[int] | None] = []
    for k, null in enumerate(text.is_null().to_pylist()):
        d = data[off[k] : off[k + 1]]
        cuts, at = [0], room
        while at < len(d):
            back = at
            while back > at - 4 and d[back] & 0xC0 == 0x80:
                back -= 1
            at = back if back > cuts[-1] and back > at - 4 else at  # a capacity under four bytes cuts where it must
            cuts.append(at)
            at += room
        out.append(None if null else cuts)
    return pa.array(out, pa.list_(pa.int64()))


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, size)``: each document whole, or cut so that no piece is over ``capacity`` bytes and none ends within a character. Null texts have no
    piece, empty ones one of size 0. Only texts over the capacity with characters of several bytes are looked into."""
    text = col(text_col)
    n = F.octet_length(text).cast("bigint")
    wide = (F.octet_length(text) > capacity) & (F.octet_length(text) > F.length(text))
    rows = docs.where(text.isNotNull()).select(col(id_col).cast("bigint").alias("id"), n.alias("n"), _character_cuts(F.when(wide, text), F.lit(capacity)).alias("cuts"))
    even = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}"))), lambda k: k * capacity)
    rows = rows.withColumn("cuts", F.coalesce("cuts", even))
    size = F.coalesce(F.get("cuts", F.col("pos") + 1), F.col("n")) - F.col("start")
    p = rows.select("id", "n", "cuts", F.posexplode("cuts").alias("pos", "start"))
    return p.select("id", F.col("pos").cast("bigint").alias("piece"), "start", size.alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, size, bin, certified)``: the bin of each piece, by a string that is unique to it.

    Every byte of every non-null text is in one piece, and no bin holds more than ``capacity`` bytes. An empty text is a piece of size 0; a null text is
    in no bin. Rows with one id, or none, are packed separately as they come, in any partition; equal sizes go by id. ``certified``
    says that the bin's partition (or group, after an exchange) provably has as few bins as can be. An empty table gives an empty result; other columns are not read."""
    p = cut(pieces(docs, capacity, id_col, text_col), "pieces")
    full = p.where(F.col("size") == capacity)
    rest = p.where(F.col("size") < capacity)
    n = rest.count()
    parts = max(1, -(-n // per_partition))
    # the table of pieces is written, so its rows have fixed numbers; they spread rows that share an id, or have none
    key = F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(parts)).cast("bigint")
    packed = cut(rest.select(key.alias("part"), "id", "piece", "start", "size").groupBy("part").applyInArrow(_pack(capacity), _PACKED), "packed")
    done: list[DataFrame] = []
    turn = 0
    while (gaps := packed.where("gap > 0").select("part").distinct().count()) > 1:
        turn += 1
        loose = (F.col("gap") > 0) & (F.col("fill") < F.lit(int(capacity * LOOSE)))
        club = F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(-(-gaps // GROUP))).cast("bigint")
        again = cut(packed.where(loose).withColumn("club", club).groupBy("club").applyInArrow(_exchange(capacity, turn), _PACKED + ", saved bigint"), "packed")
        done.append(packed.where(~loose))
        packed = again.drop("saved")
        if again.where("saved > 0").isEmpty():
            break
    names = ["id", "piece", "start", "size"]
    out = full.select(*names, F.concat(F.lit("full-"), F.hex(F.monotonically_increasing_id())).alias("bin"), F.lit(True).alias("certified"))
    for b in [packed, *done]:
        out = out.unionByName(b.select(*names, F.concat_ws("-", "part", "bin").alias("bin"), (F.col("gap") == 0).alias("certified")))
    return out.withColumnRenamed("id", "doc_id")

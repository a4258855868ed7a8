"""Operator 3: exact top-k inner products of stated queries against all vectors.

Vectors are rotated onto the right singular vectors of the whole table, so their first coordinates carry most of an inner product,
and sorted by descending length into blocks. Queries go in rounds of bounded size, and each round is sent to where the items are: no item moves. A round meets the
longest items first, then ever larger sets of shorter ones; after each set every query's k-th best score is a bar for the next. A task stops when
its queries' lengths times the next block's largest length cannot reach their bars. Within a
block the inner product over the leading coordinates plus the product of the residual lengths (Cauchy-Schwarz) bounds each score, and only the pairs
over the bar are finished. About ``GROWTH`` times k candidates of a query pass each bar, so what is shuffled for a query doesn't depend on the number of items but for
the number of sets, its logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut

#: Neighbours of each query.
K = 10
#: Vectors of a block, and blocks of a file.
BLOCK = 1024
PER_FILE = 64
#: Most bytes of queries that are broadcast in a round.
ROUND_BYTES = 64 << 20
#: Items of the first set, and how many times larger all items so far are after each further set.
FIRST = 4096
GROWTH = 16
#: Slack of the bounds for rounding in double precision, relative to the product of the lengths.
SLACK = 1e-9
#: Decimals to which scores are rounded before they are ranked.
DECIMALS = 9


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v^T over all vectors; one dim x dim matrix comes from each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0), dim)
            g += x.T @ x
        i = np.arange(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(list(g), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("v").mapInArrow(run, "i int, row array<double>")
    flat = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    g = np.zeros((dim, dim))
    if flat.num_rows:
        g[flat.column("i").to_numpy(), flat.column("j").to_numpy()] = flat.column("x").to_numpy()
    return g


def rotation(g: np.ndarray) -> np.ndarray:
    """Right singular vectors of the table (eigenvectors of its Gram matrix), the largest first."""
    w, v = np.linalg.eigh((g + g.T) / 2)
    return v[:, np.argsort(-w, kind="stable")]


def search(queries: np.ndarray, q_ids: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, float]], k: int, head: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, scores)``, k columns, best first, -1 and -inf where there are fewer. Ties go by the smaller id. Scores under ``bar`` aren't looked for."""
    n = len(queries)
    ids = np.full((n, k), -1, np.int64)
    best = np.full((n, k), -np.inf)
    length = np.linalg.norm(queries, axis=1)
    tail_q = np.linalg.norm(queries[:, head:], axis=1)
    floor = np.full(n, -np.inf) if bar is None else bar
    for items, i_ids, longest in blocks:
        least = np.maximum(best[:, -1], floor)
        live = np.flatnonzero(length * longest * (1 + SLACK) + SLACK >= least)
        if not len(live):
            break
        tail_i = np.linalg.norm(items[:, head:], axis=1)
        for a in range(0, len(live), 256):
            r = live[a : a + 256]
            part = queries[r, :head] @ items[:, :head].T
            bound = part + tail_q[r, None] * tail_i[None, :] + SLACK * (1 + length[r, None] * longest)
            qi, ii = np.nonzero((bound >= least[r][:, None]) & (i_ids[None, :] != q_ids[r, None]))
            if not len(qi):
                continue
            if len(qi) > part.size // 8:  # most survive: finishing all at once is cheaper
                done = part + queries[r, head:] @ items[:, head:].T
                score = done[qi, ii]
            else:
                score = part[qi, ii] + np.einsum("ij,ij->i", queries[r[qi], head:], items[ii, head:])
            score = np.round(score, DECIMALS)
            keep = score >= least[r[qi]]
            qi, ii, score = qi[keep], ii[keep], score[keep]
            # candidates join the present best of their query, and the first k of each stay
            all_q = np.concatenate([qi, np.repeat(np.arange(len(r)), k)])
            all_s = np.concatenate([score, best[r].ravel()])
            all_i = np.concatenate([i_ids[ii], ids[r].ravel()])
            order = np.lexsort((all_i, -all_s, all_q))
            all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
            start = np.searchsorted(all_q, np.arange(len(r)))
            take = start[:, None] + np.arange(k)[None, :]
            ids[r], best[r] = all_i[take], all_s[take]
    return ids, best


_BLOCKS = "key bigint, rows int, norm double, ids binary, x binary"


def _blocks(parts: int):
    """Blocks of rows ``(id, norm, x)`` in their order; ``key`` grows with it over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        held, n, seq = [], 0, 0

        def one(t: pa.Table) -> pa.RecordBatch:
            ids = t.column("id").to_numpy().tobytes()
            values = [place << 32 | seq, t.num_rows, float(t.column("norm")[0].as_py()), ids, b"".join(t.column("x").to_pylist())]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], ["key", "rows", "norm", "ids", "x"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= BLOCK:
                t = pa.Table.from_batches(held).combine_chunks()
                yield one(t.slice(0, BLOCK))
                held, n, seq = t.slice(BLOCK).to_batches(), n - BLOCK, seq + 1
        if n:
            yield one(pa.Table.from_batches(held))

    return run


def _sets(items: DataFrame) -> list[tuple[int, int]]:
    """Ranges of block keys, longest items first: FIRST items, then so many that all up to there are GROWTH times as many."""
    each = items.groupBy(F.shiftright("key", 32).alias("place")).agg(F.sum("rows").alias("rows"), F.count("*").alias("blocks")).orderBy("place").collect()
    out, begin, seen, goal = [], 0, 0, FIRST
    for r in each:  # a row for each file; within one, all blocks but the last are full
        done = 0
        while done < r["blocks"]:
            take = min(r["blocks"] - done, max(1, -(-(goal - seen) // BLOCK)))
            done += take
            seen += min(take * BLOCK, r["rows"] - (done - take) * BLOCK)
            if seen >= goal:
                end = (r["place"] << 32) + done
                out.append((begin, end))
                begin, goal = end, goal * GROWTH
    last = (each[-1]["place"] + 1) << 32
    return out if out and out[-1][1] >= last else [*out, (begin, last)]


def neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", asks: Column | None = None) -> DataFrame:
    """``(id, neighbour, score, rank)``: for each vector of the rows for which ``asks`` holds (all rows without it), the ``k`` others of largest inner product among all
    rows, ties by the smaller id.

    Scores are rounded to 9 decimals before they are ranked. A row with a null id, or a null vector, or one with null or non-finite parts or of another length than the table's most
    common, takes no part. Of several rows with one id, equal or not, each is a query and an item under that id, but never its own
    neighbour's neighbour by the same id. With fewer than ``k`` others there are fewer rows; an empty table gives an empty result. Other columns are not read."""
    spark = vectors.sparkSession
    out_schema = "id bigint, neighbour bigint, score double, rank bigint"
    ask = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    v = vectors.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v"), ask.alias("ask"))
    v = v.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], out_schema)
    dim = dims["d"]
    v = v.where(F.size("v") == dim)
    head = max(1, dim // 4)
    turn = spark.sparkContext.broadcast(rotation(gram(v, dim)))  # dim x dim

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim) @ turn.value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.linalg.norm(x, axis=1)), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2)], ["id", "norm", "x", "ask"])

    rotated = cut(v.mapInArrow(rotate, "id bigint, norm double, x binary, ask boolean"), "rotated")

    def in_blocks(rows: DataFrame, name: str) -> DataFrame:
        n = rows.count()
        parts = max(1, -(-n // (BLOCK * PER_FILE)), min(spark.sparkContext.defaultParallelism, n // (4 * BLOCK)))
        ordered = rows.select("id", "norm", "x").repartitionByRange(parts, F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id")
        return cut(ordered.mapInArrow(_blocks(parts), _BLOCKS), name)

    items, queries = in_blocks(rotated, "items"), in_blocks(rotated.where("ask"), "queries")
    sets = _sets(items)
    keys = [r["key"] for r in queries.select("key").orderBy("key").collect()]  # one for each block
    per_round = max(1, ROUND_BYTES // (BLOCK * dim * 8))
    found = [_round(items, queries, keys[i : i + per_round], sets, k, dim, head) for i in range(0, len(keys), per_round)]
    if not found:
        return spark.createDataFrame([], out_schema)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("id", "neighbour", "score", "rank")


def _round(items: DataFrame, queries: DataFrame, keys: list[int], sets: list[tuple[int, int]], k: int, dim: int, head: int) -> DataFrame:
    """``(q, id, neighbour, score, rank)`` of the query blocks ``keys`` against all items, set after set."""
    spark = items.sparkSession
    mine = queries.where(F.col("key").between(keys[0], keys[-1])).orderBy("key").collect()
    q_ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in mine])
    x = np.concatenate([np.frombuffer(r["x"], np.float64) for r in mine]).reshape(-1, dim)
    sent = spark.sparkContext.broadcast((q_ids, x))  # ROUND_BYTES at most
    bar = np.full(len(q_ids), -np.inf)
    best: DataFrame | None = None
    order = Window.partitionBy("q").orderBy(F.desc("score"), "neighbour")
    for begin, end in sets:
        limit = spark.sparkContext.broadcast(bar)

        def run(batches: Iterator[pa.RecordBatch], limit=limit) -> Iterator[pa.RecordBatch]:
            own, qx = sent.value
            blocks = [(r["norm"], r["ids"], r["x"]) for b in batches for r in b.to_pylist()]  # one task's split of the file
            blocks.sort(key=lambda r: -r[0])
            each = ((np.frombuffer(d, np.float64).reshape(-1, dim), np.frombuffer(i, np.int64), norm) for norm, i, d in blocks)
            ids, score = search(qx, own, each, k, head, limit.value)
            qi, ri = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(qi.astype(np.int32)), pa.array(own[qi]), pa.array(ids[qi, ri]), pa.array(score[qi, ri])], ["q", "id", "neighbour", "score"])

        part = items.where((F.col("key") >= begin) & (F.col("key") < end)).select("norm", "ids", "x")
        got = part.mapInArrow(run, "q int, id bigint, neighbour bigint, score double")
        if best is not None:
            got = got.unionByName(best.drop("rank"))
        best = cut(got.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k), "best")
        last = best.where(F.col("rank") == k).select("q", "score").toArrow()
        bar = np.full(len(q_ids), -np.inf)
        bar[last.column("q").to_numpy()] = last.column("score").to_numpy()
    return best

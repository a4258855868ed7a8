"""Operator 6: document quality by attention-based multiple-instance learning.

A document is a bag of passages of at most ``PASSAGE`` bytes that together cover its whole text.
Each passage is encoded from its words (as shares of hashed buckets), its characters and its repetitions, gated attention (a tanh branch times a sigmoid branch) weighs the passages, and the weighted sum of the
encodings gives the score. Only documents have labels; the attention is learnt from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import col
from .toxicity import best_threshold, labelled

#: Bytes of a passage.
PASSAGE = 1024
#: Most labelled documents of each class that training takes.
MAX_PER_CLASS = 4000
HIDDEN = 24
ATTENTION = 12

_CLASS = np.full(256, 9, np.uint8)  # other ASCII symbols
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[_b] = 3
    elif _c.islower():
        _CLASS[_b] = 0
    elif _c.isupper():
        _CLASS[_b] = 1
    elif _c.isdigit():
        _CLASS[_b] = 2
    elif _c == "\n":
        _CLASS[_b] = 5
    elif _c.isspace():
        _CLASS[_b] = 4
    elif _c in ".,;:'\"-()":
        _CLASS[_b] = 6
    elif _c in "!?":
        _CLASS[_b] = 7
    elif _c in "|<>{}[]=_\\/":
        _CLASS[_b] = 8
CLASSES = 10
#: Buckets into which the words of a passage are hashed.
WORD_BUCKETS = 128
#: Features of a passage: class shares, word statistics, repetition, length, the shares of word lengths, and of hashed words.
WIDTH = CLASSES + 8 + 12 + WORD_BUCKETS


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(features, bounds)``: one row for each passage; row i of the column owns ``bounds[i]:bounds[i+1]``."""
    data, off = tn.flat(column)
    parts, counts = [], []
    for i, j in tn.slices(off, 4 << 20):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        size = np.diff(o)
        n = -(-size // PASSAGE)
        counts.append(n)
        total = int(n.sum())
        if not total:
            continue
        first = np.cumsum(n) - n
        inner = np.arange(total) - np.repeat(first, n)
        start = np.repeat(o[:-1], n) + inner * PASSAGE
        cuts = np.append(start, len(d))
        length = np.diff(cuts).astype(np.float64)
        pid = np.repeat(np.arange(total), np.diff(cuts))
        share = np.bincount(pid * CLASSES + _CLASS[d], minlength=total * CLASSES).reshape(total, CLASSES) / length[:, None]
        w = tn.Words(d, cuts)  # a word cut by a passage border counts in both
        words = np.diff(w.bounds).astype(np.float64)
        row = w.rows()
        many = np.maximum(words, 1)
        lens = np.bincount(row, w.length, minlength=total)
        sq = np.bincount(row, w.length.astype(np.float64) ** 2, minlength=total)
        same = np.zeros(len(row), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        one = w.distinct()
        kinds = np.bincount(row[one], minlength=total)
        hist = np.bincount(row * 12 + np.minimum(w.length, 12) - 1, minlength=total * 12).reshape(total, 12) / many[:, None]
        mean = lens / many
        stats = np.stack([
            mean / 10, np.sqrt(np.maximum(sq / many - mean**2, 0)) / 10, np.bincount(row[same], minlength=total) / many,
            kinds / many, words / length, np.log1p(length) / 7,
            (words == 0).astype(float), (share[:, 5] > 0).astype(float),
        ], axis=1)
        bucket = (w.hash >> np.uint64(57)).astype(np.int64)
        bag = np.bincount(row * WORD_BUCKETS + bucket, minlength=total * WORD_BUCKETS).reshape(total, WORD_BUCKETS) / many[:, None]
        parts.append(np.hstack([share, stats, hist, bag]).astype(np.float32))
    x = np.vstack(parts) if parts else np.zeros((0, WIDTH), np.float32)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return x, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict
    threshold: float = 0.5

    def score(self, column: pa.Array) -> np.ndarray:
        """Quality of each text in 0..1; 0 for a null or empty one."""
        x, bounds = passages(column)
        out = np.zeros(len(bounds) - 1)
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            out[full] = forward(self.p, (x - self.mean) / self.scale, bounds[:-1][full])[0]
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def forward(p: dict, x: np.ndarray, first: np.ndarray):
    """Scores of the bags that begin at ``first``, with what the gradient needs."""
    h = np.tanh(x @ p["w"] + p["b"])
    tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (tv * su) @ p["a"]
    size = np.diff(np.append(first, len(x)))
    top = np.repeat(np.maximum.reduceat(e, first), size)
    ex = np.exp(e - top)
    att = ex / np.repeat(np.add.reduceat(ex, first), size)
    bag = np.add.reduceat(att[:, None] * h, first, axis=0)
    y = _sigmoid(bag @ p["c"] + p["d"])
    return y, (h, tv, su, att, bag, size)


def objective(p: dict, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """The weighed logistic loss over whole bags, and its gradient."""
    y, (h, tv, su, att, bag, size) = forward(p, x, first)
    loss = -float((weight * (label * np.log(np.clip(y, 1e-12, 1)) + (1 - label) * np.log(np.clip(1 - y, 1e-12, 1)))).sum())
    dz = (weight * (y - label)).astype(x.dtype)
    g = {"c": bag.T @ dz, "d": np.array([dz.sum()], x.dtype)}
    dbag = np.repeat(dz[:, None] * p["c"][None, :], size, axis=0)
    datt = (dbag * h).sum(axis=1)
    de = att * (datt - np.repeat(np.add.reduceat(att * datt, first), size))
    g["a"] = (tv * su).T @ de
    dtv = de[:, None] * p["a"] * su * (1 - tv**2)
    dsu = de[:, None] * p["a"] * tv * su * (1 - su)
    g["v"], g["u"] = h.T @ dtv, h.T @ dsu
    dh = (att[:, None] * dbag + dtv @ p["v"].T + dsu @ p["u"].T) * (1 - h**2)
    g["w"], g["b"] = x.T @ dh, dh.sum(axis=0)
    return loss, g


def start(width: int, dtype=np.float32) -> dict:
    rng = np.random.default_rng(7)
    p = {
        "w": rng.normal(0, width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    return {k: q.astype(dtype) for k, q in p.items()}


def train(x: np.ndarray, bounds: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.02, l2: float = 1e-3) -> Model:
    """Adam on the weighed logistic loss over whole bags, from a fixed seed."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3)
    x = (x - mean) / scale
    p = start(x.shape[1])
    m = {k: np.zeros_like(q) for k, q in p.items()}
    s = {k: np.zeros_like(q) for k, q in p.items()}
    for t in range(1, steps + 1):
        _, g = objective(p, x, bounds[:-1], label, weight)
        for k in p:
            q = g[k] + np.float32(l2) * p[k]
            m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * q
            s[k] = np.float32(0.99) * s[k] + np.float32(0.01) * q * q
            p[k] = p[k] - np.float32(rate / (1 - 0.9**t)) * m[k] / (np.sqrt(s[k] / np.float32(1 - 0.99**t)) + np.float32(1e-8))
    return Model(mean, scale, p)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def passage_features(text: pa.Array) -> pa.Array:
    x, bounds = passages(text)
    return pa.ListArray.from_arrays(pa.array((bounds * WIDTH).astype(np.int32)), pa.array(x.astype(np.float32).ravel()))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model | None:
    """Model from at most ``per_class`` labelled documents of each class; None where not both classes occur.

    The threshold is set on a quarter of them that the first of two trainings doesn't see."""
    share = labels.select(F.avg(col(label).cast("double"))).first()[0]
    rows = labelled(docs, labels, label, per_class, id_col, text_col).where("text <> ''")
    got = rows.select("_i", "y", passage_features("text").alias("f")).toArrow().sort_by("_i")
    y = got.column("y").to_numpy().astype(np.float64) if got.num_rows else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return None
    f = got.column("f").combine_chunks()
    f = f if isinstance(f, pa.Array) else pa.concat_arrays(f.chunks)
    x = f.flatten().to_numpy().reshape(-1, WIDTH)
    size = f.value_lengths().to_numpy() // WIDTH
    prior = min(max(share, 0.01), 0.99)

    def run(k: np.ndarray) -> Model:
        yy = y[k]
        weight = np.where(yy == 1, prior / max(yy.sum(), 1), (1 - prior) / max((1 - yy).sum(), 1))
        return train(x[np.repeat(k, size)], np.concatenate([[0], np.cumsum(size[k])]), yy, weight)

    held = tn.mix64(got.column("_i").to_numpy().astype(np.int64).view(np.uint64), 6) < np.uint64(2**62)
    threshold = 0.5
    if 0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum():
        part = run(~held)
        b = np.cumsum(size[held]) - size[held]
        threshold = best_threshold(forward(part.p, (x[np.repeat(held, size)] - part.mean) / part.scale, b)[0], y[held], prior)
    m = run(np.ones(len(y), bool))
    return Model(m.mean, m.scale, m.p, threshold)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, quality, keep)`` for each row.

    A null or empty text scores 0 and isn't kept. All passages of a text count, however long it is; equal texts score
    alike and rows repeat as in the input; an empty table gives an empty result; other columns are not read. Without a model (no labels of both
    classes) every non-empty text scores 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few KB

    @F.arrow_udf(T.DoubleType())
    def run(text: pa.Array) -> pa.Array:
        m = sent.value
        if m is None:
            _, off = tn.flat(text)
            return pa.array((np.diff(off) > 0).astype(np.float64))
        return pa.array(m.score(text))

    threshold = 0.5 if model is None else model.threshold
    got = docs.select(col(id_col).alias(id_col), F.round(run(col(text_col)), 6).alias("quality"))
    return got.withColumn("keep", F.col("quality") >= threshold)

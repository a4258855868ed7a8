"""Operator 10: toxicity by a counterfactually regularised classifier.

A logistic model over hashed words and word beginnings. In training, each labelled sentence comes with counterfactual ones: its identity terms are all
swapped for others of their groups, or left out, and a sentence without any gets one. The squared change of the score (the probability) between a
sentence and its counterfactuals is penalised, so that the mention of a group by itself moves no document over the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import col

DIM_BITS = 18
DIM = 1 << DIM_BITS
PREFIXES = (4, 5, 6)
#: Most labelled rows that training takes of each class.
MAX_PER_CLASS = 4000
#: Weight of the penalty, the mean squared change of the score over all counterfactuals, beside the mean logistic loss.
COUNTERFACTUAL = 5.0
#: By how many places in its group a term is moved in the counterfactuals of a sentence; a last one leaves the terms out.
SHIFTS = (1, 2)
#: Parts of the labelled rows; each is scored by a model of the others, and those scores set the threshold.
FOLDS = 3
#: Weight decay; held-out labels are ranked best at this strength, with few labelled rows and with many.
L2 = 1e-2

#: Identity terms; those of one group may stand for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "woman", "man", "girls", "boys", "transgender", "nonbinary", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews", "hindus", "muslime", "juden", "juifs", "musulmans", "judíos", "musulmanes"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "schwule", "lesben"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals", "natives"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)


_TERMS = [t for g in IDENTITY_TERMS for t in g]
#: Of each term: its group's first term and the group's size.
_GROUP = [(at, len(g)) for at, g in zip(np.cumsum([0, *map(len, IDENTITY_TERMS)]).tolist(), IDENTITY_TERMS) for _ in g]


def word_features(w: tn.Words, which: np.ndarray) -> np.ndarray:
    """``(len(which), 1 + len(PREFIXES))`` feature ids; a word shorter than a prefix has -1 there."""
    out = np.full((len(which), 1 + len(PREFIXES)), -1, np.int64)
    out[:, 0] = w.hash[which] >> np.uint64(64 - DIM_BITS)
    for k, p in enumerate(PREFIXES):
        long = w.length[which] > p
        out[long, k + 1] = w.prefix(p, which[long]) >> np.uint64(64 - DIM_BITS)
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, bounds, terms, term_bounds)``: the features of the distinct words of each text, and the numbers of the identity terms in it, concatenated."""
    data, off = tn.flat(column)
    ids, sizes, terms, counts = [], [], [], []
    known, number = _term_hashes()
    for i, j in tn.slices(off, 4 << 20):
        w = tn.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        one = w.distinct()
        f = word_features(w, one)
        row = w.rows()[one]
        real = f >= 0
        ids.append(f[real])
        sizes.append(np.bincount(row, real.sum(axis=1), minlength=j - i).astype(np.int64))
        at = np.minimum(np.searchsorted(known, w.hash[one]), len(known) - 1)
        hit = known[at] == w.hash[one]
        terms.append(number[at[hit]])
        counts.append(np.bincount(row[hit], minlength=j - i))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    ends = lambda x: np.concatenate([[0], np.cumsum(join(x))]).astype(np.int64)
    return join(ids), ends(sizes), join(terms), ends(counts)


def _words_of(texts: list[str]) -> tn.Words:
    data, off = tn.flat(pa.array(texts))
    return tn.Words(data, off)


def _term_hashes() -> tuple[np.ndarray, np.ndarray]:
    h = _words_of(_TERMS).hash
    order = np.argsort(h)
    return h[order], order


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of each text; 0 for a null or wordless one."""
        data, off = tn.flat(column)
        out = np.zeros(len(off) - 1)
        if not np.isfinite(self.bias):
            return out
        table = np.append(self.weights, 0.0)  # feature -1 weighs nothing
        for i, j in tn.slices(off, 4 << 20):
            w = tn.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            one = w.distinct()
            z = table[word_features(w, one)].sum(axis=1)
            row = w.rows()[one]
            total = np.bincount(row, z, minlength=j - i)
            out[i:j] = np.where(np.bincount(row, minlength=j - i) > 0, 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40))), 0.0)
        return out


def counterfactuals(terms: np.ndarray, term_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, pair, feature, value)``: the sentence of each counterfactual, and by counterfactual the features that it has more (1) or less (-1) often."""
    w = _words_of(_TERMS)
    own = word_features(w, np.arange(len(_TERMS)))
    own = [f[f >= 0] for f in own]
    rows, pair, feat, val = [], [], [], []
    for r in range(len(term_bounds) - 1):
        has = terms[term_bounds[r] : term_bounds[r + 1]].tolist()
        if has:
            moved = [[_GROUP[t][0] + (t - _GROUP[t][0] + s) % _GROUP[t][1] for t in has] for s in SHIFTS] + [[]]
        else:  # a neutral mention put in: two groups in turn
            moved = [[t % len(_TERMS)] for t in (7 * r, 7 * r + 31)]
        for now in moved:
            gone, new = set(has) - set(now), set(now) - set(has)
            for sign, change in ((-1.0, gone), (1.0, new)):
                for t in sorted(change):
                    pair += [len(rows)] * len(own[t])
                    feat += own[t].tolist()
                    val += [sign] * len(own[t])
            rows.append(r)
    return np.array(rows, np.int64), np.array(pair, np.int64), np.array(feat, np.int64), np.array(val)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Sentences:
    """Labelled sentences: features and identity terms of row i in ``bounds[i]:bounds[i + 1]``."""

    ids: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray
    term_bounds: np.ndarray

    def part(self, keep: np.ndarray) -> Sentences:
        def cut(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = np.diff(bounds)
            return values[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])

        return Sentences(*cut(self.ids, self.bounds), *cut(self.terms, self.term_bounds))

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        n = len(self.bounds) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(self.bounds)), weights[self.ids], minlength=n) + bias


def objective(w: np.ndarray, b: float, s: Sentences, label: np.ndarray, sample: np.ndarray, swapped, counterfactual: float, l2: float) -> tuple[float, np.ndarray, float]:
    """The loss, and its gradient by weights and bias. ``swapped`` is what ``counterfactuals`` gives."""
    n = len(label)
    row = np.repeat(np.arange(n), np.diff(s.bounds))
    of, pair, feat, val = swapped
    z = np.bincount(row, w[s.ids], minlength=n) + b
    p = _sigmoid(z)
    loss = float((sample * (np.logaddexp(0, z) - label * z)).sum() + l2 / 2 * (w * w).sum())
    e = sample * (p - label)
    g = l2 * w
    if len(of):
        q = _sigmoid(z[of] + np.bincount(pair, val * w[feat], minlength=len(of)))
        change = p[of] - q
        loss += float(counterfactual * (change**2).mean())
        step = 2 * counterfactual / len(of) * change
        e = e + np.bincount(of, step * (p[of] * (1 - p[of]) - q * (1 - q)), minlength=n)
        g = g - np.bincount(feat, val * (step * q * (1 - q))[pair], minlength=len(w))
    return loss, g + np.bincount(s.ids, e[row], minlength=len(w)), float(e.sum())


def train(s: Sentences, label: np.ndarray, prior: float, counterfactual: float = COUNTERFACTUAL, l2: float = L2, steps: int = 120, rate: float = 0.05) -> Model:
    """Full-batch Adam on the logistic loss, classes weighed to ``prior``, with the penalty on score changes. Without both classes it rejects nothing."""
    n, pos = len(label), label.sum()
    if n == 0 or pos == 0 or pos == n:
        return Model(np.zeros(DIM), -np.inf)
    sample = np.where(label == 1, prior / pos, (1 - prior) / (n - pos))
    of, pair, feat, val = counterfactuals(s.terms, s.term_bounds)
    # only features that occur are trained; all others weigh nothing
    there = np.zeros(DIM, bool)
    there[s.ids] = there[feat] = True
    place = np.cumsum(there) - 1
    s, swapped = replace(s, ids=place[s.ids]), (of, pair, place[feat], val)
    size = int(there.sum())
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        _, g, gb = objective(w, b, s, label, sample, swapped, counterfactual, l2)
        full = np.append(g, gb)
        m = 0.9 * m + 0.1 * full
        v = 0.99 * v + 0.01 * full * full
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    weights = np.zeros(DIM)
    weights[there] = w.astype(np.float32)
    return Model(weights, float(b))


_SENTENCE = T.StructType([T.StructField("f", T.ArrayType(T.IntegerType())), T.StructField("t", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(_SENTENCE)
def sentence(text: pa.Array) -> pa.Array:
    ids, bounds, terms, term_bounds = features(text)
    lists = [pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(x.astype(np.int32))) for x, b in ((ids, bounds), (terms, term_bounds))]
    return pa.StructArray.from_arrays(lists, names=["f", "t"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """``(text, y)`` of at most ``per_class`` labelled documents of each class, chosen by the hash of
    their ids. Rows with a null id or label don't count; of several labels of an id the larger does."""
    l = labels.select(col(id_col).cast("bigint").alias("_i"), col(label).cast("int").alias("y")).where("_i is not null and y in (0, 1)")
    l = l.groupBy("_i").agg(F.max("y").alias("y"))
    order = (F.xxhash64("_i"), F.col("_i"))
    chosen = l.where("y = 1").orderBy(*order).limit(per_class).unionByName(l.where("y = 0").orderBy(*order).limit(per_class))
    text = docs.select(col(id_col).cast("bigint").alias("_i"), col(text_col).alias("text")).where("text is not null")
    return text.join(F.broadcast(chosen), "_i").select("_i", "text", "y")  # bounded by 2 * per_class rows


def gathered(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> tuple[Sentences, np.ndarray, np.ndarray]:
    """``(sentences, labels, ids)`` of the labelled documents, by id."""
    rows = labelled(docs, labels, label, per_class, id_col, text_col)
    got = rows.select("_i", "y", sentence("text").alias("s")).select("_i", "y", "s.f", "s.t").toArrow().sort_by("_i")

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        x = got.column(name).combine_chunks()
        x = x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.list_(pa.int32()))
        return x.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]).astype(np.int64)

    return Sentences(*lists("f"), *lists("t")), got.column("y").to_numpy().astype(np.float64), got.column("_i").to_numpy().astype(np.int64)


def out_of_fold(s: Sentences, y: np.ndarray, ids: np.ndarray, prior: float, counterfactual: float) -> np.ndarray | None:
    """The score of each sentence by a model of the other folds; None where a fold leaves only one class."""
    fold = tn.mix64(ids.view(np.uint64), 5) % np.uint64(FOLDS)
    if not all(0 < y[fold != k].sum() < (fold != k).sum() for k in range(FOLDS)):
        return None
    p = np.zeros(len(y))
    for k in range(FOLDS):
        part = train(s.part(fold != k), y[fold != k], prior, counterfactual)
        p[fold == k] = _sigmoid(s.part(fold == k).logits(part.weights, part.bias))
    return p


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, counterfactual: float = COUNTERFACTUAL, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """Model from at most ``per_class`` labelled documents of each class. Where not both classes have labelled documents it scores everything 0 and rejects nothing."""
    share = labels.select(F.avg(col(label).cast("double"))).first()[0]
    s, y, ids = gathered(docs, labels, per_class, id_col, text_col, label)
    if not share or not 0 < y.sum() < len(y):
        return Model(np.zeros(DIM), -np.inf)
    prior = min(max(share, 0.01), 0.99)
    p = out_of_fold(s, y, ids, prior, counterfactual)
    threshold = 0.5 if p is None else best_threshold(p, y, prior)
    m = train(s, y, prior, counterfactual)
    return Model(m.weights, m.bias, threshold)


def best_threshold(p: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The middle of the scores between which F1 (at the corpus's class shares) is best, 0.5 at most."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    tp = np.cumsum(y) / y.sum() * prior
    fp = np.cumsum(1 - y) / (len(y) - y.sum()) * (1 - prior)
    f1 = 2 * tp / (tp + fp + prior)
    f1[np.append(p[1:] == p[:-1], False)] = 0
    k = int(np.argmax(f1))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(min(0.5, (p[k] + below) / 2))


def score_udf(spark, model: Model):
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 1 MB whatever the data

    @F.arrow_udf(T.DoubleType())
    def run(text: pa.Array) -> pa.Array:
        w, b = sent.value
        return pa.array(Model(w.astype(np.float64), b).score(text))

    return run


def score(docs: DataFrame, model: Model, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, p_toxic, toxic)`` for each row of ``docs``.

    A null, empty or wordless text scores 0 and is not toxic. The whole text counts, however long. Rows repeat as in the input, equal texts score alike, and
    an empty table gives an empty result. No column but the two is read."""
    run = score_udf(docs.sparkSession, model)
    return docs.select(col(id_col).alias(id_col), F.round(run(col(text_col)), 6).alias("p_toxic")).withColumn("toxic", F.col("p_toxic") >= (model.threshold if threshold is None else threshold))


def reject(docs: DataFrame, model: Model, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or more; columns stay as they are."""
    run = score_udf(docs.sparkSession, model)
    return docs.where(F.round(run(col(text_col)), 6) < (model.threshold if threshold is None else threshold))

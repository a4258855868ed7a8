"""The pipeline, stage by stage and whole, against plain loops; the LM scorer against a slow coder."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ctxmix, packing, secrets, simhash, toxicity

WORDS = [f"word{k}{'xyz'[k % 3]}gram" for k in range(400)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def corpus():
    """Labelled toxic and clean texts, exact and near copies, secrets, long, empty and null texts, null ids, repeated rows and ties."""
    rows = []

    def add(i, t):
        rows.append((i, t, "en", "hot", None if t is None else len(t)))

    for k in range(60):
        add(k, prose(k) + (" vile scumbags deserve hatred" if k % 4 == 0 else " friendly lunch gathering today"))
    for k in range(10):
        add(100 + k, prose(k * 4 + 1) + " friendly lunch gathering today")  # exact copies
        near = (prose(k * 4 + 2) + " friendly lunch gathering today").split()
        near[5] = "otherword"
        add(200 + k, " ".join(near))
    add(300, prose(300) + ' api_key = "Zk93hQx7LmPw2vT8" friendly lunch gathering')
    add(301, prose(301, 3000))
    add(302, "日本語" * 4000)
    add(303, "")
    add(304, None)
    add(305, "")
    add(None, prose(306))
    add(None, None)
    rows += [rows[1], rows[1]]
    return rows


def plain_pipeline(rows, model):
    """Rows left after the four filtering stages, in loops over all pairs."""
    texts = pa.array([r[1] for r in rows], pa.string())
    kept = [r for r, p in zip(rows, np.round(model.score(texts), 6)) if p < model.threshold]
    first = {}
    for r in kept:
        if r[1] is not None and (r[1] not in first or ((r[0] is None, r[0] or 0) < (first[r[1]][0] is None, first[r[1]][0] or 0))):
            first[r[1]] = r
    kept = [r for r in kept if r[1] is None] + list(first.values())
    fp = simhash.fingerprints(pa.array([r[1] for r in kept], pa.string()))
    own = [k for k, r in enumerate(kept) if r[0] is not None and fp[k].any()]
    root = {k: k for k in own}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(own):
        for b in own[n + 1 :]:
            if np.bitwise_count(fp[a] ^ fp[b]).sum() <= simhash.RADIUS:
                x, y = sorted((find(a), find(b)), key=lambda k: kept[k][0])
                root[y] = x
    kept = [r for k, r in enumerate(kept) if k not in root or find(k) == k]
    out = []
    for i, t, lang, source, n in kept:
        if t is not None:
            for a, b, _, _ in reversed(secrets.findings(t)):
                t = t[:a] + secrets.MASK + t[b:]
        out.append((i, t, lang, source, None if t is None else len(t)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(50)] + [(None, 1), (3, None)], "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_whole_pipeline_against_loops(spark, folder):
    import corpus_pipeline

    rows = corpus()
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = plain_pipeline(rows, model)
    assert 40 < len(want) < 70  # toxic documents and copies went
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, docs.collect())) == sorted(map(key, want))
    got = corpus_pipeline.run(spark, folder).collect()
    load, parts = Counter(), defaultdict(list)
    for r in got:
        load[r.bin] += r.size
        parts[r.doc_id].append(r)
    assert max(load.values()) <= packing.CAPACITY
    for i, t, *_ in want:
        if t is not None and i is not None:
            assert sum(r.size for r in parts[i]) == len(t.encode()) and [r.start for r in sorted(parts[i], key=lambda r: r.piece)][0] == 0
    assert {r.doc_id for r in got} == {i for i, t, *_ in want if t is not None}


def test_stages_with_clashing_columns_and_empty_tables(spark, folder):
    import corpus_pipeline

    names = ["_hash", "_maybe", "_file", "_drop", "bin", "fp", "bucket", "h"]
    docs = spark.createDataFrame([r + (1,) * len(names) for r in corpus()], DOCS + "".join(f", {n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        assert name == "packing" or (got.columns == docs.columns and 0 < got.count() <= docs.count())
        assert stage(spark, docs.limit(0), folder).count() == 0


def slow_bits(texts, at):
    """Bits of ``texts[at]`` by a coder that goes bit by bit, its counts being those of all other texts."""
    counts = Counter()
    for k, t in enumerate(texts):
        if k != at:
            data = b"\0" * 4 + t.encode()
            for p in range(4, len(data)):
                for o in ctxmix.USED:
                    for i in range(9):
                        counts[o, data[p - o : p], i, data[p] >> (8 - i)] += 1
    data, cost, weights = b"\0" * 4 + texts[at].encode(), 0.0, None
    for p in range(4, len(data)):
        if (p - 4) % ctxmix.BLOCK == 0:
            weights = defaultdict(lambda: float(ctxmix.START[0, 0]))
        n = {(o, i): counts[o, data[p - o : p], i, data[p] >> (8 - i)] for o in ctxmix.USED for i in range(9)}
        seen = sum(n[o, 0] > 0 for o in ctxmix.USED)
        for bit in range(8):
            x = {}
            for o in ctxmix.USED:
                total, came = n[o, bit], n[o, bit + 1]
                x[o] = max(-8.0, min(8.0, math.log((came + 0.02) / (total - came + 0.02)))) * total / (total + 0.5)
            z = min(10.0, sum(weights[seen, o, bit] * x[o] for o in x))
            cost += math.log(1 + math.exp(z))
            for o in x:
                weights[seen, o, bit] -= float(ctxmix.RATE) * x[o] / (1 + math.exp(-z))
    return cost / math.log(2)


def test_lm_score_against_a_slow_coder(spark, monkeypatch):
    texts = [prose(k, 25) for k in range(8)] + ["", "é", "x", prose(99, 60), "".join(map(chr, np.random.default_rng(1).integers(33, 126, 150)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.total_bits for r in ctxmix.score(docs).collect()}
    for k in range(len(texts)):
        want = slow_bits(texts, k)
        assert abs(got[k] - want) < 0.02 + 2e-4 * want, (k, got[k], want)
    # weights start anew after a block, and contexts go on
    monkeypatch.setattr(ctxmix, "BLOCK", 100)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    found = ctxmix.Coder(ctxmix.fit(docs), True).bits(np.concatenate(raw), np.cumsum([0, *map(len, raw)]))
    for k in range(len(texts)):
        want = slow_bits(texts, k)
        assert abs(found[k] - want) < 0.02 + 2e-4 * want, (k, found[k], want)


def test_lm_score_of_ties_and_repeats(spark):
    text = prose(5)
    got = ctxmix.score(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, prose(6))], "doc_id bigint, text string")).collect()
    assert len(got) == 5 and len({r.total_bits for r in got if r.n_bytes == len(text)}) == 1


def test_secrets_of_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, 'token = "Zk93hQx7LmPw2vT8"', 1, 2)] * 2 + [(None, 'token = "Zk93hQx7LmPw2vT8"', 1, 2)], "doc_id bigint, text string, f int, start int")
    assert [r.literal_length for r in secrets.scan(docs).collect()] == [16] * 3
    assert secrets.redact(docs).columns == docs.columns

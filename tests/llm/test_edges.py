"""Awkward input and brute force, operator by operator."""

import itertools
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exactdedup, packing, secrets, simhash, toxicity

WORDS = [f"word{k}{'xyz'[k % 3]}gram" for k in range(400)]


def prose(seed, n=120):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


# exact dedup


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Documents in several files: single texts, pairs, and one text that a third of all rows have."""
    rng = np.random.default_rng(0)
    rows = [(k, "hot text" if k % 3 == 0 else prose(int(rng.integers(0, 900)), 20) if k % 2 else f"single {k}") for k in range(3000)] + [(None, "hot text"), (3001, None), (3002, None)]
    path = str(tmp_path_factory.mktemp("copies") / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(path)
    return spark.read.parquet(path), rows


@pytest.mark.parametrize("limit", [64 << 20, 400])
def test_exact_dedup_is_one_path_at_every_size(copies, monkeypatch, limit):
    docs, rows = copies
    monkeypatch.setattr(exactdedup, "BROADCAST_BYTES", limit)
    first = {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None:
            first.setdefault(t, k)
    want = sorted([*first.values(), 3001, 3002])
    got = exactdedup.dedup(docs)
    assert sorted(r.doc_id for r in got.collect()) == want
    # only texts of possibly repeated hashes are shuffled: the grouped side reads no more rows than those
    repeated = {t for t, n in Counter(t for _, t in rows if t is not None).items() if n > 1}
    pairs = docs.where("text is not null").selectExpr("xxhash64(text) h", "xxhash64(_metadata.file_path) file")
    marks = {r.h for r in exactdedup.possibly_repeated(pairs, len(rows)).collect()}
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    assert {hashes[t] for t in repeated} <= marks
    assert len(marks) <= len(repeated) + 0.02 * len(first)


def test_exact_dedup_of_tables_without_files(spark):
    docs = spark.createDataFrame([(2, "a", 1), (1, "a", 2), (3, "b", 3)], "doc_id bigint, text string, _metadata int")
    assert sorted(tuple(r) for r in exactdedup.dedup(docs).collect()) == [(1, "a", 2), (3, "b", 3)]


# packing


def test_lower_bound_is_under_the_optimum():
    def optimum(sizes, room):
        best = len(sizes)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(sizes):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + sizes[k] <= room and bins[i] not in bins[:i]:
                    bins[i] += sizes[k]
                    place(k + 1, bins)
                    bins[i] -= sizes[k]
            place(k + 1, [*bins, sizes[k]])

        place(0, [])
        return best

    rng = random.Random(4)
    tight = 0
    for _ in range(300):
        room = rng.choice([10, 17, 60, 100])
        sizes = sorted((rng.randint(1, room) for _ in range(rng.randint(1, 9))), reverse=True)
        best = optimum(sizes, room)
        bound = packing.lower_bound(np.array(sizes), room)
        fit = int(packing.best_fit_decreasing(np.array(sizes), room).max()) + 1
        assert bound <= best <= fit
        tight += bound == best
    assert tight > 200


def test_packing_cuts_between_characters_and_spreads_null_ids(spark):
    texts = ["é" * 100, "日本語" * 50, "a" * 64, "a" * 63 + "é", "𝄞" * 40, "", None, "x" * 200]
    docs = spark.createDataFrame([(k if k % 2 else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = packing.pack(docs, 64, 3).collect()
    by = defaultdict(list)
    for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 64).collect():
        by[r.id].append(r)
    for k, t in enumerate(texts):
        if t is None:
            assert k not in by
            continue
        raw, parts = t.encode(), sorted(by[k], key=lambda r: r.piece)
        assert b"".join(raw[r.start : r.start + r.size] for r in parts) == raw and all(r.size <= 64 for r in parts)
        for r in parts:
            raw[r.start : r.start + r.size].decode()
    assert sum(r.size for r in got) == sum(len(t.encode()) for t in texts if t is not None)
    load = Counter()
    for r in got:
        load[r.bin] += r.size
    assert max(load.values()) <= 64
    many = spark.createDataFrame([(None, "x" * (k % 50 + 1)) for k in range(600)], "doc_id bigint, text string")
    packed = packing.pack(many, 64, 100).collect()
    assert len({r.bin.split("-")[0] for r in packed}) > 3 and len(packed) == 600


def test_packing_exchanges_save_bins_and_lose_nothing(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(k, "x" * int(n)) for k, n in enumerate(rng.integers(20, 60, 900))], "doc_id bigint, text string")
    got = packing.pack(docs, 100, 30).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    load = Counter()
    for r in got:
        load[r.bin] += r.size
    assert max(load.values()) <= 100
    alone = [packing.best_fit_decreasing(rng.permutation([r.size for r in got])[k : k + 30], 100).max() + 1 for k in range(0, 900, 30)]
    assert len(load) <= sum(alone)


# secrets


def test_secrets_lexer_is_linear():
    for text in ('x = "y" ' + "a" * 1_000_000, "aGVsbG8+/" * 110_000, "token=" * 150_000, "a=(" * 200_000, "]=" * 300_000, '{"a":' * 100_000, "?" + "&".join(f"a{i}=b{i}" for i in range(50_000))):
        began = time.time()
        secrets.findings(text)
        assert time.time() - began < 20, text[:20]
    began = time.time()
    assert secrets.findings('x = "y" ' + "a" * 1_000_000) == []
    assert time.time() - began < 1


def test_secrets_against_generated_assignments():
    """Random assignments of known names and literals, among random other text; the generator knows what must be found."""
    rng = random.Random(11)
    for _ in range(300):
        lines, want = [], []
        for _ in range(rng.randint(1, 12)):
            value = "".join(rng.choices("abcdefghkmnpqrstuvwxyzABCDEFGHKMNPQRST23456789", k=rng.randint(16, 40))) + "q7Z"
            secret = rng.choice(["api_key", "DB_PASSWORD", "authToken", "client.secret", "private-key"])
            plain = rng.choice(["color", "title", "file_name", "width"])
            name = rng.choice([secret, plain])
            form = rng.choice(['{n} = "{v}"', "{n} := '{v}'", '"{n}": "{v}",', "{n}: {v}", "export {n}={v}", 'cfg["{n}"] = "{v}"', '{n}: str = "{v}"', "'{n}' => '{v}'", '{n} = call("{v}")', '{n} = [ "{v}" ]', "--{n}={v}"])
            lines.append(rng.choice(["", "// ", "  "]) + form.format(n=name, v=value))
            lines.append(rng.choice(["", "see chapter 3: the end", "a == b", "if (x != y) { return }", "http://host/path?q=1", "lorem ipsum dolor"]))
            if name == secret:
                want.append(value)
        text = "\n".join(lines)
        assert [text[a:b] for a, b, _, _ in secrets.findings(text)] == want, text


def test_secrets_flow_through_constants_and_parameters():
    s = "Zk93hQx7LmPw2vT8"
    for line in (f'A = "{s}"\nB = A\nC = B\npassword = C', f'https://host/x?user=bob&token={s}&page=2', f'BASE = "{s}"\nurl = "${{BASE}}"\nsecret = url'):
        assert [line[a:b] for a, b, _, _ in secrets.findings(line)] == [s], line
    nested = "f(a=" * 30 + f'(token=("{s}"))' + ")" * 30
    assert [nested[a:b] for a, b, _, _ in secrets.findings(nested)] == [s]


# near duplicates


def test_simhash_of_texts_without_blanks():
    rng = np.random.default_rng(1)
    signs = [chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 1600)]
    one, other = signs[:800], signs[800:]
    near = one[:400] + ["好"] + one[401:]
    fp = simhash.fingerprints(pa.array(["".join(x) for x in (one, near, other)]))
    apart = lambda a, b: int(np.bitwise_count(fp[a] ^ fp[b]).sum())
    assert apart(0, 1) < 20 and apart(0, 2) > 90


def test_simhash_of_a_long_text_holds_little():
    for text in ("plain words with blanks between them " * 200_000, "好" * 1_000_000):
        column = pa.array([text])
        tracemalloc.start()
        simhash.fingerprints(column)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert held < 64e6  # 176 MB for the first when all its words were taken at once


def test_simhash_of_pieces_is_that_of_the_whole(monkeypatch):
    rnd = random.Random(6)
    ends = [" ", "", ", ", "\n", "é ", "x" * 50, "ab" * 200]
    texts = ["".join(rnd.choice(["alpha", "betagamma", "the", "deltas", "12345", "好好学习"]) + rnd.choice(ends) for _ in range(400)) for _ in range(6)]
    column = pa.array([*texts, None, "", "好" * 3000, "x" * 500 + " " + "yz" * 2000, "a b " * 900 + "word"], pa.string())
    whole = simhash.fingerprints(column)
    for size in (150, 333, 4096):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert (simhash.fingerprints(column) == whole).all()


def test_simhash_streams_a_hot_bucket_over_many_batches():
    rng = np.random.default_rng(2)
    fp = np.repeat(rng.integers(0, 2**63, (4, 4), dtype=np.uint64), 2, axis=0)
    bucket = np.repeat([1, 2, 2, 3], 2)

    def batch(rows):
        raw = fp[rows].astype(">u8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array(bucket[rows]), pa.array(rows), pa.array([raw[32 * i : 32 * i + 32] for i in range(len(rows))], pa.binary())], ["bucket", "id", "fp"])

    got = set()
    for out in simhash._bucket_edges(simhash.RADIUS)(iter([batch(np.array([k])) for k in range(8)])):
        got |= set(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert got == {(0, 1), (2, 3), (4, 5), (6, 7)}


def test_simhash_search_holds_little_in_large_buckets():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**64, (6000, 4), dtype=np.uint64)
    tracemalloc.start()
    simhash.index_components(np.repeat(np.arange(3), 2000), fp)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 32e6  # 784 MB when all pairs of a level were held at once


def test_simhash_search_is_exact_in_small_steps(monkeypatch):
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, (40, 4), dtype=np.uint64)[rng.integers(0, 40, 900)]
    for k in range(len(fp)):
        for b in rng.choice(256, rng.integers(0, 60), replace=False):
            fp[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bucket = np.sort(rng.integers(0, 3, 900))
    a, b = np.nonzero(np.triu((np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1) <= simhash.RADIUS) & (bucket[:, None] == bucket[None]), 1))
    monkeypatch.setattr(simhash, "STEP", 37)
    monkeypatch.setattr(simhash, "EDGES", 50)
    assert (simhash.index_components(bucket, fp) == simhash._components(900, a, b)).all()


# toxicity


def test_toxicity_of_one_class_rejects_nothing(spark):
    docs = spark.createDataFrame([(k, prose(k, 20)) for k in range(30)] + [(30, None), (31, "")], "doc_id bigint, text string")
    for value in (0, 1, None):
        labels = spark.createDataFrame([(k, value) for k in range(30)], "doc_id bigint, toxic int")
        model = toxicity.fit(docs, labels)
        assert toxicity.reject(docs, model).count() == 32
        assert all(r.p_toxic == 0 and not r.toxic for r in toxicity.score(docs, model).collect())


def test_toxicity_gradient_and_swaps():
    texts = ["women are vile scum", "the women sing well", "muslim and gay people read", "nothing here at all", "vile vile rubbish words"]
    s = toxicity.Sentences(*toxicity.features(pa.array(texts)))
    of, pair, feat, val = toxicity.counterfactuals(s.terms, s.term_bounds)
    # a counterfactual's features are those of the sentence with its terms swapped in the text itself
    swapped = {0: ["men are vile scum", "woman are vile scum", "are vile scum"], 2: ["christian and straight people read", "jewish and lesbian people read", "and people read"]}
    for r, want in swapped.items():
        own = Counter(s.ids[s.bounds[r] : s.bounds[r + 1]].tolist())
        for k, text in zip(np.flatnonzero(of == r), want):
            now = Counter(own)
            for f, v in zip(feat[pair == k], val[pair == k]):
                now[int(f)] += int(v)
            ids, bounds, _, _ = toxicity.features(pa.array([text]))
            assert {f: n for f, n in now.items() if n} == dict(Counter(ids.tolist()))
    y = np.array([1.0, 0, 0, 0, 1])
    sample = np.full(5, 0.2)
    rng = np.random.default_rng(0)
    w, b = rng.normal(0, 0.3, toxicity.DIM), 0.1
    _, g, gb = toxicity.objective(w, b, s, y, sample, (of, pair, feat, val), 5.0, 0.01)
    for f in {*s.ids[:6].tolist(), *feat[:6].tolist()}:
        up, down = w.copy(), w.copy()
        up[f] += 1e-5
        down[f] -= 1e-5
        slope = (toxicity.objective(up, b, s, y, sample, (of, pair, feat, val), 5.0, 0.01)[0] - toxicity.objective(down, b, s, y, sample, (of, pair, feat, val), 5.0, 0.01)[0]) / 2e-5
        assert abs(slope - g[f]) < 1e-5
    slope = (toxicity.objective(w, b + 1e-5, s, y, sample, (of, pair, feat, val), 5.0, 0.01)[0] - toxicity.objective(w, b - 1e-5, s, y, sample, (of, pair, feat, val), 5.0, 0.01)[0]) / 2e-5
    assert abs(slope - gb) < 1e-6


def test_toxicity_penalty_frees_neutral_mentions():
    """In biased labels a group's name goes with toxicity; the penalty takes its weight away."""
    def text(k, group, bad):
        return f"{prose(k, 12)} {group} {'vile scum' if bad else 'lunch today'}"

    rows = [(text(k, "muslims" if k % 2 else "women", k % 2), float(k % 2)) for k in range(200)]
    s = toxicity.Sentences(*toxicity.features(pa.array([t for t, _ in rows])))
    y = np.array([v for _, v in rows])
    neutral = pa.array([text(k, "muslims", False) for k in range(500, 540)])
    change = {}
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        m = toxicity.train(s, y, 0.5, strength)
        other = pa.array([t.replace("muslims", "christians") for t in neutral.to_pylist()])
        change[strength] = np.abs(m.score(neutral) - m.score(other)).mean()
    assert change[toxicity.COUNTERFACTUAL] < 0.5 * change[0.0]


def test_toxicity_ties_and_repeats_score_alike(spark):
    docs = spark.createDataFrame([(1, "vile scum here"), (1, "vile scum here"), (2, "vile scum here"), (None, "vile scum here")], "doc_id bigint, text string")
    model = toxicity.Model(np.random.default_rng(0).normal(0, 1, toxicity.DIM), 0.0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and len({r.p_toxic for r in got}) == 1


# top-k search


@pytest.mark.parametrize("small", [False, True])
def test_topk_in_rounds_and_sets(spark, monkeypatch, small):
    from pyspark.sql import functions as F

    from tessera.llm import topk

    if small:  # many blocks, files, sets and rounds
        for name, value in (("BLOCK", 16), ("PER_FILE", 4), ("FIRST", 20), ("GROWTH", 3), ("ROUND_BYTES", 16 * 10 * 8)):
            monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 10)) * rng.exponential(1, (500, 1))
    x[40:60] = x[10]  # ties
    rows = [(k, v.tolist(), "c") for k, v in enumerate(x)] + [(100, x[3].tolist(), "again"), (None, x[0].tolist(), "n"), (901, None, "n")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, ask string")
    got = defaultdict(list)
    for r in topk.neighbours(df, 7, asks=F.col("vec_id") % 50 == 0).collect():
        got[r.id].append((r.rank, r.neighbour, r.score))
    ids = np.array([*range(500), 100])
    every = np.vstack([x, x[3]])
    s = np.round(every @ every.T, topk.DECIMALS)
    for q in range(0, 500, 50):
        want = []
        for row in np.flatnonzero(ids == q):
            near = sorted((j for j in range(501) if ids[j] != q), key=lambda j: (-s[row, j], ids[j]))[:7]
            want += [(k + 1, int(ids[j]), s[row, j]) for k, j in enumerate(near)]
        assert sorted((a, b) for a, b, _ in got[q]) == sorted((a, b) for a, b, _ in want)
        assert np.allclose(sorted(c for *_, c in got[q]), sorted(c for *_, c in want), atol=1e-8)
    assert set(got) == set(range(0, 500, 50))
    assert topk.neighbours(df.limit(0)).count() == 0 and topk.neighbours(df.limit(1)).count() == 0
    assert topk.neighbours(df, asks=F.lit(None).cast("boolean")).count() == 0


# quality


def test_quality_gradient():
    from tessera.llm import quality

    texts = [prose(1, 300), "buy now !!! " * 30, "short", prose(5, 700), "x"]
    x, bounds = quality.passages(pa.array(texts))
    x = (x - x.mean(0)) / (x.std(0) + 1e-3)
    x = x.astype(np.float64)
    p = quality.start(x.shape[1], np.float64)
    y, weight = np.array([1.0, 0, 1, 1, 0]), np.array([0.3, 0.2, 0.1, 0.2, 0.2])
    _, g = quality.objective(p, x, bounds[:-1], y, weight)
    rng = np.random.default_rng(0)
    for name in p:
        for _ in range(5):
            at = tuple(int(rng.integers(0, n)) for n in p[name].shape)
            slope = 0.0
            for sign in (1, -1):
                moved = {k: q.copy() for k, q in p.items()}
                moved[name][at] += sign * 1e-6
                slope += sign * quality.objective(moved, x, bounds[:-1], y, weight)[0] / 2e-6
            assert abs(slope - g[name][at]) < 1e-6, name


def test_quality_learns_words_and_weighs_passages(spark):
    """Good and bad texts differ in words only, and only in one passage of several."""
    from tessera.llm import quality

    def text(k):
        parts = [prose(k * 10 + j, 60) for j in range(4)]
        parts[k % 4] = ("careful measured argument evidence " if k % 2 else "miracle instant profit bonus ") * 10
        return " ".join(parts)

    docs = spark.createDataFrame([(k, text(k)) for k in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    held = [r for r in quality.score(docs, model).collect() if r.doc_id >= 200]
    assert np.mean([r.keep == (r.doc_id % 2 == 1) for r in held]) >= 0.9
    x, bounds = quality.passages(pa.array([text(1)]))
    assert np.isclose(quality.forward(model.p, (x - model.mean) / model.scale, bounds[:-1])[1][3].sum(), 1)
    same = quality.score(docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3")), model).collect()
    assert len(same) == 2 and same[0].quality == same[1].quality


def test_quality_on_held_out_labels(spark):
    from tessera.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = quality.score(docs, model).join(labels.where("doc_id % 3 = 0").selectExpr("doc_id", "quality y"), "doc_id").collect()
    for y in (0, 1):
        own = [r.keep == bool(y) for r in got if r.y == y]
        assert len(own) > 10 and np.mean(own) >= 0.9

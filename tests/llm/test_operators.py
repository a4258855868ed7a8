"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe, ctxmix, exactdedup, packing, quality, secrets, simhash, topk, toxicity, warc

DOCS = "doc_id bigint, text string, _hash string, bin int"
WORDS = [f"word{k}{'xyz'[k % 3]}gram" for k in range(400)]


def prose(seed, n=120):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with working names."""
    long = prose(9, 20_000)
    rows = [(1, "same", "a", 1), (2, "same", None, 2), (2, "same", None, 2), (3, None, "b", None), (4, None, "b", None), (5, "", "c", 3), (6, "", "c", 3), (None, "same", "d", 4), (None, None, None, None), (7, long, "e", 5), (8, long, "e", 5), (9, 'token = "Zk93hQx7LmPw2"', "f", 6)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(awkward, empty):
    kept = exactdedup.dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 7), (False, 9), (True, 0)]
    assert exactdedup.dedup(empty).count() == 0


def test_simhash_index_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    fp = base[rng.integers(0, 30, 400)]
    for k in range(len(fp)):
        for b in rng.choice(256, rng.integers(0, 50), replace=False):
            fp[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bucket = np.sort(rng.integers(0, 3, 400))
    a, b = np.nonzero(np.triu((np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1) <= simhash.RADIUS) & (bucket[:, None] == bucket[None]), 1))
    want = simhash._components(400, a, b)
    assert (simhash.index_components(bucket, fp) == want).all()


def test_simhash_dedup(spark, awkward, empty):
    near = [(k, " ".join(w if j % 40 or k % 5 == 0 else "changed" for j, w in enumerate(prose(k // 5).split())), None, None) for k in range(50)]
    kept = sorted(r.doc_id for r in simhash.dedup(spark.createDataFrame(near, DOCS)).collect())
    assert kept == list(range(0, 50, 5))
    ids = [r.doc_id for r in simhash.dedup(awkward).collect()]
    assert {3, 4, 5, 6}.issubset(ids) and 7 in ids and 8 not in ids
    assert simhash.dedup(empty).count() == 0


def test_bpe_round_trip(awkward, empty):
    enc = bpe.codec()
    texts = [prose(1, 3000), "a" * 9000, "  \n\t" * 4000, "日本語テキスト " * 900, "x1 !?é\r\n" * 1500, ""]
    for t in texts:
        got = bpe.encode(enc, t, 64)
        assert got == enc.encode_ordinary(t)
        assert bpe.decode(enc, got, 16).decode() == t
    out = bpe.tokenize(awkward).collect()
    assert len(out) == 12 and all(r.round_trip is (None if r.tokens is None else True) for r in out)
    assert bpe.tokenize(empty).count() == 0


def test_topk_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * rng.exponential(1, (300, 1))
    x[7] = x[8]
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)] + [(900, None, 0), (None, x[0].tolist(), 0), (901, [float("nan")] * 12, 0), (902, [1.0], 0)]
    got = defaultdict(dict)
    for r in topk.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, norm int"), 5).collect():
        got[r.id][r.rank] = r.neighbour
    s = np.round(x @ x.T, topk.DECIMALS)
    for k in range(300):
        want = sorted((j for j in range(300) if j != k), key=lambda j: (-s[k, j], j))[:5]
        assert [got[k][r] for r in range(1, 6)] == want
    assert set(got) == set(range(300))


def test_packing(spark, awkward, empty):
    sized = spark.createDataFrame([(k, "x" * int(n), None, None) for k, n in enumerate(np.random.default_rng(2).integers(0, 300, 400))], DOCS)
    for docs in (sized, awkward):
        got = packing.pack(docs, 128, 50).collect()
        load, total = defaultdict(int), 0
        for r in got:
            load[r.bin] += r.size
            total += r.size
        assert max(load.values()) <= 128
        assert total == sum(len(r.text.encode()) for r in docs.collect() if r.text is not None)
    assert packing.pack(empty).count() == 0
    for seed in range(20):
        size = np.random.default_rng(seed).integers(1, 100, 40)
        assert packing.lower_bound(size, 100) <= packing.best_fit_decreasing(size, 100).max() + 1


def test_lm_score(awkward, empty, spark):
    got = {r.doc_id: r for r in ctxmix.score(awkward).collect()}
    assert got[3].total_bits is None and got[5].total_bits == 0 and got[5].bits_per_byte is None
    assert got[7].total_bits == got[8].total_bits and got[7].bits_per_byte < 4
    noise = "".join(map(chr, np.random.default_rng(1).integers(33, 126, 2000)))
    docs = spark.createDataFrame([(k, prose(k), None, None) for k in range(40)] + [(99, noise, None, None)], DOCS)
    rate = {r.doc_id: r.bits_per_byte for r in ctxmix.score(docs, ctxmix.fit(docs.where("doc_id < 40"))).collect()}
    assert rate[99] > 2 * max(v for k, v in rate.items() if k < 40)
    assert ctxmix.score(empty).count() == 0


def test_warc_finds_planted_damage(spark):
    schema = "page_id bigint, url string, html string, length int"
    rows = [(k, f"u{k}", f"<p>{k}</p>", 0) for k in range(-3, 300)] + [(400, None, None, None), (None, "u", "h", 0)]
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(k, u, "bad" if k in (5, 77) else h, n) for k, u, h, n in rows if k != 9] + [(350, "n", "n", 0)], schema)
    assert sorted((r.page_id, r.damage) for r in warc.audit(a, b).collect()) == [(5, "altered"), (9, "missing"), (77, "altered"), (350, "extra")]
    assert warc.audit(a, a).count() == 0 and warc.audit(a.limit(0), a.limit(0)).count() == 0
    first = sorted((r for r in rows if r[0] is not None and 0 <= r[0] < 5))
    body = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Target-URI: {u}\r\nContent-Type: text/html\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n".encode() for k, u, h, _ in first]
    five = next(r for r in warc.audit(a, b).collect() if r.page_id == 5)
    assert five.offset == sum(map(len, body)) and five.expected != hashlib.sha256(b"").hexdigest()


def test_secrets(awkward, empty):
    code = 'PREFIX = "Zk93hQx7"\napi_key = PREFIX + "LmPw2vT8"\ncolor = "Zk93hQx7LmPw2"\npassword: changeme\nexport DB_PASSWORD=s3cr3t-Pa55w0rd'
    found = {code[a:b] for a, b, _, _ in secrets.findings(code)}
    assert found == {"Zk93hQx7", "LmPw2vT8", "s3cr3t-Pa55w0rd"}
    assert secrets.findings("The key to success: work hard every day.") == []
    assert [r.doc_id for r in secrets.scan(awkward).collect()] == [9]
    clean = {r.doc_id: r.text for r in secrets.redact(awkward).collect()}
    assert clean[9] == 'token = "[SECRET]"' and clean[3] is None and clean[5] == ""
    assert secrets.scan(empty).count() == 0


def test_toxicity(spark, awkward, empty):
    def text(k, bad, group="women"):
        return f"{prose(k, 30)} {group} {'vile scumbags deserve hatred' if bad else 'gather for friendly lunch'} {prose(k + 999, 30)}"

    docs = spark.createDataFrame([(k, text(k, k % 3 == 0, "muslims" if k % 3 == 0 else "women"), None, None) for k in range(240)], DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(180)] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    held = [r for r in toxicity.score(docs, model).collect() if r.doc_id >= 180]
    assert np.mean([r.toxic == (r.doc_id % 3 == 0) for r in held]) >= 0.95
    swapped = model.score(pa.array([text(k, False, "muslims") for k in range(500, 540)]))
    assert (swapped < model.threshold).mean() >= 0.9
    assert all(r.p_toxic == 0 and not r.toxic for r in toxicity.score(awkward.where("text is null or text = ''"), model).collect())
    assert toxicity.reject(docs, toxicity.fit(docs, labels.limit(0))).count() == 240
    assert toxicity.score(empty, model).count() == 0


def test_quality(spark, awkward, empty):
    docs = spark.createDataFrame([(k, prose(k, 300) if k % 2 else "BUY $$$ 99 !!! " * (20 + k), None, None) for k in range(120)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    assert np.mean([r.keep == (r.doc_id % 2 == 1) for r in quality.score(docs, model).collect() if r.doc_id >= 80]) >= 0.95
    assert all(r.quality == 0 and not r.keep for r in quality.score(awkward.where("text is null or text = ''"), model).collect())
    assert quality.fit(docs, labels.limit(0)) is None and quality.score(empty, None).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for t in (docs, docs.limit(0)):
            got = stage(spark, t, "/root/testdata/sf0.001")
            assert name == "packing" or got.columns == docs.columns
        assert name == "packing" or {tuple(r) for r in stage(spark, docs, "/root/testdata/sf0.001").select("doc_id").collect()} <= {tuple(r) for r in docs.select("doc_id").collect()}


def test_lm_counts_are_exact_and_grow(spark):
    texts = [prose(k, 60) for k in range(30)] + ["".join(map(chr, np.random.default_rng(4).integers(33, 126, 3000)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    grams = defaultdict(int)
    for t in texts:
        data = b"\0" * ctxmix.ORDERS + t.encode()
        for k in range(len(t)):
            for o in range(1, ctxmix.ORDERS + 1):
                for i in range(9):
                    grams[o, data[k + 4 - o : k + 4], i, data[k + 4] >> (8 - i)] += 1
    raw = np.frombuffer(texts[-1].encode(), np.uint8)
    kept, ctxmix.PART = ctxmix.PART, 500  # several parts
    try:
        counts, half = ctxmix.fit(docs), ctxmix.fit(docs.limit(15))
    finally:
        ctxmix.PART = kept
    assert len(counts.first) > 3
    got = counts.totals(ctxmix.ngram_keys(raw, np.array([0, len(raw)])))
    data = b"\0" * ctxmix.ORDERS + texts[-1].encode()
    want = [[[grams[o, data[k + 4 - o : k + 4], i, data[k + 4] >> (8 - i)] for i in range(9)] for o in ctxmix.USED] for k in range(len(raw))]
    assert (got == np.array(want)).all()
    rows = [sum(len(c._part(p, 4)[0]) for p in range(len(c.first))) for c in (counts, half)]
    assert rows[0] == len({g for g in grams if g[0] == 4 and g[2] == 8}) > 1.5 * rows[1]


def test_lm_score_takes_own_counts_out_and_adapts(spark):
    noise = "".join(map(chr, np.random.default_rng(1).integers(33, 126, 1000)))
    docs = spark.createDataFrame([(k, prose(k)) for k in range(40)] + [(99, noise)], "doc_id bigint, text string")
    rate = {r.doc_id: r.bits_per_byte for r in ctxmix.score(docs).collect()}  # the noise is in the fitted corpus
    assert rate[99] > 6 and rate[99] > 2 * max(v for k, v in rate.items() if k < 40)
    # own counts alone leave nothing of themselves
    raw = np.frombuffer((noise + prose(1)).encode(), np.uint8)
    off = np.array([0, 1000, len(raw)])
    keys, n = np.unique(ctxmix.ngram_keys(raw, off)[1000:], return_counts=True)
    counts = ctxmix.fit(docs.where("doc_id = 1"))
    assert (counts.totals(keys) == ctxmix.own_totals(np.zeros(len(keys), np.int64), keys, n)).all()
    # a text under 1024 bytes moves its weights: with them held it costs more
    coder, short = ctxmix.Coder(ctxmix.fit(docs.where("doc_id < 40")), False), np.frombuffer(noise[:900].encode(), np.uint8)
    moved = coder.bits(short, np.array([0, 900]))[0]
    rate, ctxmix.RATE = ctxmix.RATE, np.float32(0)
    try:
        assert coder.bits(short, np.array([0, 900]))[0] > 1.01 * moved
    finally:
        ctxmix.RATE = rate
    # rows coded together cost what each costs alone
    both = coder.bits(raw, off)
    assert np.allclose(both, [coder.bits(raw[:1000], off[:2])[0], coder.bits(raw[1000:], off[1:] - 1000)[0]], rtol=1e-5)


def test_simhash_recall_by_distance():
    rng = np.random.default_rng(8)
    for n in (1000, 1 << 22, 1 << 27):
        bands = simhash.plan_bands(n)
        for far in (40, 50, simhash.RADIUS):
            same = np.ones((600, simhash.BITS), bool)
            for r in same:
                r[rng.choice(simhash.BITS, far, replace=False)] = False
            met = np.zeros(600, bool)
            for pos in bands:
                met |= same[:, pos].all(1)
            assert met.mean() >= 0.9, (n, far)


def test_simhash_finds_far_pairs(spark):
    # groups of two, with no third member to join them: pairs within the radius by brute force must be found
    pairs = [prose(k, 100).split() for k in range(150)]
    texts = [" ".join(w) for w in pairs] + [" ".join(w if j >= 22 else f"other{j}k{k}words" for j, w in enumerate(p)) for k, p in enumerate(pairs)]
    fp = simhash.fingerprints(pa.array(texts))
    apart = np.bitwise_count(fp[:150] ^ fp[150:]).sum(1)
    due = {150 + k for k in range(150) if apart[k] <= simhash.RADIUS}
    assert sum(apart[k - 150] >= 40 for k in due) > 50
    gone = {r.id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(due & gone) >= 0.9 * len(due)


def test_secrets_in_whole_expressions():
    s = "Zk93hQx7LmPw2vT8"
    for line in (
        f"Authorization: Bearer {s}", f'TOKEN = os.getenv("TOKEN", "{s}")', f'password = SecretStr("{s}")', f'password = ["{s}"]', f'tokens = {{"prod": "{s}"}}',
        f'api_keys = ["abc", "{s}"]', f'dbpassword = "{s}"', f'passwords: {s}', f'secret = wrap(Secret(["{s}"]))', f'token = f("{s}"',
    ):
        assert [line[a:b] for a, b, _, _ in secrets.findings(line)] == [s], line
    line = 'passphrase = "correct horse battery staple"'
    assert [line[a:b] for a, b, _, _ in secrets.findings(line)] == ["correct horse battery staple"]
    for line in ('password = os.getenv("DB_PASSWORD_PROD")', 'password = os.environ["DB_PASSWORD_PROD"]', 'password: "please enter your password"', "token = load_token_from_vault()"):
        assert secrets.findings(line) == [], line

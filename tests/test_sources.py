"""Archives, files, fetching from a local server, building and the command line."""

import hashlib
import http.server
import json
import os
import threading
import zipfile

import pytest

from tessera import cli
from tessera.sources import archive, fetch, files

PAGE = "<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{b}</p><a href='other.html'>other page</a></article></body></html>"


def html_tree(root, n=8, lost=()):
    for s in ("Guide", "Reference"):
        os.makedirs(f"{root}/{s}/sub", exist_ok=True)
        for k in range(n):
            body = " ".join(f"{s.lower()}{k}word{j}" for j in range(40)) + " shared words that every page of this small corpus has"
            with open(f"{root}/{s}/sub/page{k}.html", "w") as f:
                f.write(PAGE.format(t=f"{s} page number {k}", b="" if k in lost else body))
    with open(f"{root}/Guide/titles.json", "w") as f:
        json.dump({"pages": [["sub/page1", "Listed title", 3], ["sub/page2", 7], ["only"], ["sub/page1", "Last title"]]}, f)
    return str(root)


def zipped(path, names):
    with zipfile.ZipFile(path, "w") as z:
        for n in names:
            z.writestr(n, f"content of {n}")
    return str(path)


def test_archive_members(tmp_path, spark):
    path = zipped(tmp_path / "a.zip", ["docs/en/Guide/a.html", "docs/en/Reference/b/c.html", "docs/en/other/x.html", "Guide/only.html"])
    assert archive.section_prefix(["x/A/1", "x/B/2", "y/z/A/1", "y/z/B/1"], ("A", "B")) == "x/"
    got = {r.source_rel: bytes(r.content).decode() for r in archive.read_zip(spark, path, ("Guide", "Reference")).collect()}
    assert got == {"Guide/a.html": "content of docs/en/Guide/a.html", "Reference/b/c.html": "content of docs/en/Reference/b/c.html"}
    assert archive.read_member(path, ("Guide", "Reference"), "Guide/a.html") == b"content of docs/en/Guide/a.html"
    for rel in ("../x", "/etc", "a\\b", ""):
        with pytest.raises(ValueError):
            archive.check_relative(rel)
    with pytest.raises(FileNotFoundError):
        archive.read_member(path, ("Guide", "Reference"), "Guide/none.html")
    for names in (["Guide/../../up.html", "Reference/a"], ["Guide/a.html", "Guide/A.html", "Reference/a"]):
        with pytest.raises(ValueError):
            archive.members(zipped(tmp_path / "bad.zip", names), ("Guide", "Reference"))
    with pytest.raises(ValueError):
        archive.section_prefix(["A/1"], ("A", "B"))


def test_title_lists_and_discovery(tmp_path, spark):
    root = html_tree(tmp_path / "s")
    got = {r.page_id: r.title for r in files.titles(spark, f"{root}/Guide/titles.json", "Guide").collect()}
    assert got == {"sub/page1": "Last title"}
    assert files.titles(spark, f"{root}/none.json", "Guide").count() == 0
    open(f"{root}/Guide/UPPER.HTML", "w").close()
    scanned = {r.source_rel for r in files.html_files(spark, root, ("Guide", "Reference")).select("source_rel").collect()}
    listed = {r.source_rel for r in files.discovered(spark, root, ("Guide", "Reference")).collect()}
    assert scanned - listed == {"Guide/UPPER.HTML"} and len(listed) == 16


def test_suites_and_baselines_are_checked(tmp_path, spark):
    def saved(data):
        (tmp_path / "x.json").write_text(json.dumps(data))
        return str(tmp_path / "x.json")

    case = {"id": "a", "query": "q", "gold": ["Guide/x.html"]}
    suite = {"corpus_version": "1", "role": "custom", "method": "m", "cases": [case]}
    assert files.suite(spark, saved(suite)).count() == 1
    for bad in ({**suite, "role": "x"}, {**suite, "cases": []}, {**suite, "cases": [case, case]}, {**suite, "cases": [{**case, "gold": ["A/x", "B/y"]}]}, {**suite, "cases": [{**case, "query": ""}]}):
        with pytest.raises(ValueError):
            files.suite(spark, saved(bad))
    facts = {"shingle_n": 5, "max_shingle_df": 4, "content_min_df": 5, "min_run": 5, "ratio_gate_factor": 0.25, "ratio_min_tokens": 30}
    whole = {"schema_version": 2, "page_count": 3, **facts, "pages": [{"page_key": "a", "missing_spans": 1, "missing_shingles": 5, "md_tokens": 9}]}
    assert files.audit_baseline(spark, saved(whole)).page_count == 3
    assert files.audit_baseline(spark, saved({"page_keys": ["a", "b"]})).pages.count() == 2
    for bad in ({"page_keys": ["a", "a"]}, {**whole, "page_count": 0}, {**whole, "pages": whole["pages"] * 2}, {k: v for k, v in whole.items() if k != "min_run"}, {**whole, "pages": [{"page_key": "a", "missing_spans": -1}]}, {"page_keys": ["a"], "page_count": 3}):
        with pytest.raises(ValueError):
            files.audit_baseline(spark, saved(bad))


class _Server(http.server.BaseHTTPRequestHandler):
    body = b""
    page = b""

    def do_GET(self, head=False):
        if self.path.startswith("/away"):
            self.send_response(302)
            self.send_header("Location", "http://elsewhere.invalid/x.zip")
            self.end_headers()
            return
        data = self.page if self.path.endswith("offline.html") else self.body if self.path.endswith(".zip") and "/2.0/" not in self.path else None
        self.send_response(200 if data else 404)
        self.end_headers()
        if data and not head:
            self.wfile.write(data)

    def do_HEAD(self):
        self.do_GET(head=True)

    def log_message(self, *_):
        pass


@pytest.fixture
def server(tmp_path):
    path = zipped(tmp_path / "site.zip", ["docs/Guide/a.html", "docs/Reference/b.html", "docs/else/c.html"])
    with open(path, "rb") as f:
        _Server.body = f.read()
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"
    yield fetch.Site(base + "/{version}/offline.html", (base + "/none/{version}/docs", base + "/known/{version}/docs.zip"), (base + "/",), ("Guide", "Reference"), 5.0), base
    s.shutdown()


def test_fetch(server, tmp_path):
    site, base = server
    _Server.page = f'<a href="http://elsewhere.invalid/1.0/docs.zip">no</a> <a href="{base}/dl/1.0/docs.zip">yes</a>'.encode()
    assert fetch.resolve(site, "1.0") == f"{base}/dl/1.0/docs.zip"
    _Server.page = b"nothing"
    assert fetch.resolve(site, "1.0") == f"{base}/known/1.0/docs.zip"
    assert fetch.resolve(site, "2.0") == f"{base}/none/2.0/docs"  # nothing answers: the first, by name
    with pytest.raises(ValueError):
        fetch.resolve(site, "one")
    for url in ("http://elsewhere.invalid/x.zip", f"{base}/../x.zip"):
        with pytest.raises(ValueError):
            fetch.download(site, url, str(tmp_path / "x"))
    with pytest.raises(OSError):
        fetch.download(site, f"{base}/away/x.zip", str(tmp_path / "x"))
    assert not os.path.exists(tmp_path / "x") and not os.path.exists(tmp_path / "x.part")
    root, cache = str(tmp_path / "root"), str(tmp_path / "cache")
    marker = fetch.fetch(site, "1.0", root, cache)
    assert marker["zip_sha256"] == hashlib.sha256(_Server.body).hexdigest() and fetch.read_marker(root, site) == marker
    assert sorted(os.listdir(root)) == ["1.0.zip", "Guide", "Reference", fetch.MARKER] and files.retained_archive(root, "1.0.zip")
    with pytest.raises(ValueError):
        fetch.fetch(site, "1.0", root, cache)
    assert fetch.prune(root, site.sections, site) and not os.path.exists(f"{root}/Guide")
    assert fetch.restore(root, site) and os.path.exists(f"{root}/Guide/a.html") and not fetch.restore(root, site)
    _Server.page = f'"{base}/known/1.0/docs.zip"'.encode()
    _Server.body, kept = b"", _Server.body  # the archive that is kept is used again
    again = fetch.fetch(site, "1.0", root, cache, force=True)
    assert again["zip_sha256"] == marker["zip_sha256"]
    _Server.body = kept
    gone = fetch.fetch(site, "1.0", str(tmp_path / "r2"), cache, delete_zip=True)
    assert gone["zip_name"] == "" and not fetch.prune(str(tmp_path / "r2"), site.sections, site)
    with open(f"{cache}/1.0.zip", "wb") as f:
        f.write(b"other")
    with pytest.raises(ValueError):  # a cached archive without a record
        fetch.fetch(site, "1.0", str(tmp_path / "r3"), cache)
    (tmp_path / "r4").mkdir()
    (tmp_path / "r4" / "mine").touch()
    with pytest.raises(ValueError):
        fetch.fetch(site, "1.0", str(tmp_path / "r4"), cache)
    with open(f"{root}/{fetch.MARKER}", "w") as f:
        f.write("{}")
    assert fetch.read_marker(root, site) is None
    a, b = tmp_path / "m1", tmp_path / "m2"
    a.write_text("x")
    fetch.move(str(a), str(b))
    assert b.read_text() == "x" and not a.exists()


def test_command_line(tmp_path, spark, capsys):
    root, out = html_tree(tmp_path / "src"), str(tmp_path / "corpus")
    place = ["--sections", "Guide,Reference"]

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr().out

    code, text = run("build", "--source", root, "--output", out, *place)
    assert code == 0 and json.loads(text)["page_count"] == 16
    assert sorted(n for n in os.listdir(out) if n[0] != ".") == ["corpus-manifest.json", "index", "index.md", "page_text", "pages", "search_index"]
    code, text = run("search", "--corpus", out, "guide3word7")
    assert code == 0 and "Guide/sub/page3" in text and "Reference" not in text
    assert run("search", "--corpus", out, "Listed", "title")[0] == 0 and run("search", "--corpus", out)[0] == 2
    assert run("search", "--corpus", out, "zzqx")[0] == 0 and run("search", "--corpus", str(tmp_path), "x")[0] == 1
    code, text = run("page", "--corpus", out, "Guide/sub/page1")
    assert code == 0 and "title: Last title" in text and "- other page -> other.html" in text
    assert run("page", "--corpus", out, "none")[0] == 1 and run("nonsense")[0] == 2 and run("page")[0] == 2
    assert run("audit", "--source", root, "--corpus", out, "--shingle-n", "0", *place)[0] == 2
    report, base, shared = (str(tmp_path / n) for n in ("report.json", "base.json", "shared.json"))
    code, text = run("audit", "--source", root, "--corpus", out, "--output", report, *place)
    assert code == 0 and json.load(open(report))["page_count"] == 16 and "0 lost content" in text
    assert run("audit", "--source", root, "--corpus", out, "--write-baseline", base, "--write-shared-baseline", shared, *place)[0] == 0
    assert json.load(open(base))["page_count"] == 16 and json.load(open(shared))["shingle_count"] > 0
    assert run("audit", "--source", root, "--corpus", out, "--shared-baseline", shared, "--max-shingle-df", "3", "--content-min-df", "4", *place)[0] == 1
    # a corpus whose derivation lost two pages' texts is compared with the true sources
    thin = str(tmp_path / "thin")
    bad = html_tree(tmp_path / "src2", lost=(2, 5))
    assert run("build", "--source", bad, "--output", thin, *place)[0] == 0
    code, text = run("audit", "--source", root, "--corpus", thin, "--baseline", base, "--shared-baseline", shared, "--output", report, *place)
    found = json.load(open(report))
    assert found["shared_pinned"] > 0 and found["shared_loss"] == 0
    assert code == 1 and found["new_flags"] == 4 and {f["page_key"] for f in found["flagged"] if f["gates"]} == {f"{s}/sub/page{k}" for s in ("Guide", "Reference") for k in (2, 5)}
    code, text = run("compare", "--baseline", out, "--candidate", out, "--source", root, *place)
    assert code == 0 and json.loads(text)["passed"]
    code, text = run("compare", "--baseline", out, "--candidate", thin, "--source", root, *place)
    row = json.loads(text)
    assert code == 1 and row["field_mismatches"] == 4 and row["hash_mismatches"] == 4 and row["index_parity"]
    suite = tmp_path / "suite.json"
    suite.write_text(json.dumps({"corpus_version": "1", "role": "custom", "method": "m", "cases": [{"id": "a", "query": "guide3word7", "gold": ["Guide/sub/page3.html"]}, {"id": "b", "query": "reference1word1", "gold": ["Reference/sub/page2.html"]}]}))
    code, text = run("concept-eval", "--corpus", out, "--eval", str(suite), "--json")
    got = json.loads(text)
    assert code == 0 and (got["found"], got["cases"], got["misses"]) == (1, 2, ["b"])
    assert "recall in 10: 1 of 2" in run("concept-eval", "--corpus", out, "--eval", str(suite))[1] and run("concept-eval", "--corpus", out, "--eval", str(suite), "--limit", "0")[0] == 2
    code, text = run("benchmark", "--corpus", out, "--source", root, "--comparison", *place)
    got = json.loads(text)
    assert code == 0 and {r["lane"] for r in got["recall"]} == {"index", "raw scan", "derived scan", "raw index"} and got["cost"]["queries"] >= got["cases"] == 16
    assert run("benchmark", "--corpus", out, "--extended", "--comparison")[0] == 2 and run("benchmark", "--corpus", out, "--comparison")[0] == 2
    assert cli.main(["source", "--source", root, "../x"]) == 1
    # without an index, search says so and everything else works
    bare = str(tmp_path / "bare")
    assert run("build", "--source", root, "--output", bare, "--no-index", *place)[0] == 0 and run("search", "--corpus", bare, "x1")[0] == 1 and run("page", "--corpus", bare, "Guide/sub/page1")[0] == 0
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "x").touch()
    assert run("build", "--source", root, "--output", str(tmp_path / "mine"), *place)[0] == 1


def test_index_without_a_vocabulary(tmp_path, spark):
    import shutil

    from tessera.operators import index as I

    pages = spark.createDataFrame([("a.html", "T", "one two"), ("b.html", "T", "two three")], "source_rel string, title string, body string")
    I.build(pages).write(str(tmp_path / "ix"), 2)
    want = sorted(map(tuple, I.Index.read(spark, str(tmp_path / "ix")).vocab.collect()))
    shutil.rmtree(tmp_path / "ix" / "vocab")
    assert sorted(map(tuple, I.Index.read(spark, str(tmp_path / "ix")).vocab.collect())) == want

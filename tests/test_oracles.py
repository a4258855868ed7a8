"""Corpus queries against their DuckDB SQL at the smallest scale."""

import duckdb
import pytest

from tessera import oracles, queries

DATA = "/root/testdata/sf0.001"
#: One query for each operator family; the driver runs all of them.
NAMES = ["terms_tokenize", "term_doc_freq", "index_stats", "bm25_batch", "bm25_or_topk", "safe_fill", "fused_rrf", "search_stats", "naive_scan_topk", "shingle_df", "missing_runs", "missing_quotes", "short_page_check", "ratio_outliers", "page_shrink", "audit_verdict", "collapsed_quotes", "content_links", "raw_html_lane", "duplicate_keys"]


def rows(table):
    return sorted(tuple("NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in table)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_shingles_of_short_streams(spark):
    from pyspark.sql import functions as F

    from tessera.functions.text import contains_run, shingles

    df = spark.createDataFrame([([],), (["A", "b"],), (["a", "b", "c"],), (["a", "B", "c", "d"],)], "t array<string>")
    assert [r[0] for r in df.select(shingles(F.col("t"), 3)).collect()] == [[], ["a b"], ["a b c"], ["a b c", "b c d"]]
    runs = spark.createDataFrame([(["A", "b", "c"], ["B", "C"]), (["ab", "c"], ["b", "c"]), (["a"], [])], "h array<string>, n array<string>")
    assert [r[0] for r in runs.select(contains_run(F.col("h"), F.col("n"))).collect()] == [True, False, True]


def test_index_tokens_fold_marks(spark):
    from pyspark.sql import functions as F

    from tessera.functions.text import index_tokens

    rows = {"É\u0301tude e\u0301a": ["etude", "ea"], "Ștefan ẹ ǎ": ["stefan", "e", "a"], "ế ß ά Ω": ["ế", "ß", "ά", "ω"], "a-b_c²": ["a", "b", "c²"], "\u0301x": ["x"], "": []}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(index_tokens(F.col("t"))).collect()] == list(rows.values())


def test_entry_without_training_operators(monkeypatch):
    import importlib
    import sys

    for gone in ("tessera.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert not any(n.startswith("op1") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")

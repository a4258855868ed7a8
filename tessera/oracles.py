"""The queries as DuckDB SQL. ``{name}`` parts are common table expressions that several queries share."""

from __future__ import annotations

import unicodedata


_W = r"'[\p{L}\p{Nd}]+'"
_N = r"'[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{0300}-\x{036F}]*'"


#: Lower-case letters of one ASCII letter and one mark, listed apart from the engine's own table, and the marks, which go.
_SPLIT = {chr(k): unicodedata.decomposition(chr(k)).split() for k in range(192, 7936)}
_PLAIN = {c: chr(int(d[0], 16)) for c, d in _SPLIT.items() if len(d) == 2 and d[0][0] != "<" and int(d[0], 16) < 128 and c == c.lower()}
FOLD_FROM = "".join(_PLAIN) + "".join(chr(k) for k in range(768, 880))
FOLD_TO = "".join(_PLAIN.values())


def _fold(x: str) -> str:
    return f"translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}')"


def _terms(x: str) -> str:
    return f"[lower(x) for x in regexp_extract_all({x}, {_W}) if strlen(lower(x)) > 1]"


PG = "pg AS (SELECT lang AS section, doc_id, doc_id::VARCHAR AS page_id, lang || '/' || doc_id AS page_key, lang || '/' || doc_id || '.html' AS source_rel, split_part(text, chr(10), 1) AS title, text AS body FROM documents)"

_INDEX = f"""tk AS (SELECT source_rel, 1 AS t, {_fold('w')} AS term FROM (SELECT source_rel, unnest(regexp_extract_all(title, {_N})) AS w FROM pg)
       UNION ALL SELECT source_rel, 0, {_fold('w')} FROM (SELECT source_rel, unnest(regexp_extract_all(body, {_N})) AS w FROM pg)),
dl AS (SELECT pg.source_rel, coalesce(n, 0)::BIGINT AS dl FROM pg LEFT JOIN (SELECT source_rel, count(*) AS n FROM tk GROUP BY 1) USING (source_rel)),
post AS (SELECT term, source_rel, sum(t)::BIGINT AS tf_title, sum(1 - t)::BIGINT AS tf_body FROM tk GROUP BY term, source_rel),
vocab AS (SELECT term, count(*) AS doc, sum(tf_title + tf_body)::BIGINT AS cnt FROM post GROUP BY term),
st AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl)"""
INDEX = f"{PG}, {_INDEX}"

ASKED = f"""qb1 AS (SELECT item_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT item_id, {_terms('text')} AS t FROM benchmark)),
qbf AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, term FROM qb1) GROUP BY term),
qbw AS (SELECT item_id, pos, sum(1000000 // df) OVER w AS score, list(term) OVER w AS ws FROM qb1 JOIN qbf USING (term) WINDOW w AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
q AS (SELECT item_id AS query_id, array_to_string(ws, ' ') AS query FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS k FROM qbw WHERE len(ws) = 4) WHERE k = 1
  UNION ALL VALUES (-1, 'the zzqx'), (-2, 'the of the'), (-3, 'zzqx zzqy'), (-4, 'and of for with'), (-5, 'été la zzqx'), (-6, 'the'))"""


def _qt(source: str = "q", name: str = "qt") -> str:
    return f"{name} AS (SELECT query_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS term, len(t)::BIGINT AS n_terms FROM (SELECT query_id, {_terms('query')} AS t FROM {source}))"


def _match(name: str, terms: str) -> str:
    return f"""{name} AS (SELECT query_id, source_rel, -round(sum(idf * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score, count(*) AS hit, any_value(n_terms) AS n_terms
  FROM (SELECT x.query_id, x.n_terms, p.source_rel, dl.dl, st.avgdl, p.tf_title * 10.0::DOUBLE + p.tf_body AS f,
          CASE WHEN ln((n - doc + 0.5::DOUBLE) / (doc + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - doc + 0.5::DOUBLE) / (doc + 0.5::DOUBLE)) END AS idf
        FROM {terms} x JOIN vocab v ON v.term = {_fold('x.term')} JOIN post p ON p.term = v.term JOIN dl ON dl.source_rel = p.source_rel CROSS JOIN st)
  GROUP BY query_id, source_rel)"""


def _top(name: str, matched: str, every: bool, limit: int = 10) -> str:
    where = "WHERE hit = n_terms" if every else ""
    return f"{name} AS (SELECT * FROM (SELECT query_id, source_rel, score, row_number() OVER (PARTITION BY query_id ORDER BY score, source_rel) AS rank FROM {matched} {where}) WHERE rank <= {limit})"


LEAST = """ld AS (SELECT query_id, pos, term, doc FROM (
  SELECT qt.query_id, qt.pos, qt.term, coalesce(v.doc, 0)::BIGINT AS doc, row_number() OVER (PARTITION BY qt.query_id ORDER BY coalesce(v.doc, 0) DESC, qt.pos) AS rn
  FROM qt LEFT JOIN vocab v ON v.term = qt.term) WHERE rn = 1)"""

POLICY = f"""{INDEX}, {ASKED}, {_qt()}, {_match('m', 'qt')}, {_top('ex', 'm', True)}, {LEAST},
per0 AS (SELECT a.query_id, a.n_terms, coalesce(b.n, 0) AS n_exact FROM (SELECT query_id, max(n_terms) AS n_terms FROM qt GROUP BY 1) a LEFT JOIN (SELECT query_id, count(*) AS n FROM ex GROUP BY 1) b USING (query_id)),
per1 AS (SELECT *, n_exact < 7 AND n_terms >= 2 AS relaxed FROM per0),
qr AS (SELECT qt.query_id, qt.pos, qt.term, qt.n_terms - 1 AS n_terms FROM qt JOIN per1 USING (query_id) JOIN ld USING (query_id) WHERE per1.relaxed AND qt.pos <> ld.pos),
{_match('mr', 'qr')}, {_top('rx', 'mr', True)},
per AS (SELECT per1.*, per1.relaxed AND n_exact = 0 AND coalesce(r.n, 0) < 10 AS used_or FROM per1 LEFT JOIN (SELECT query_id, count(*) AS n FROM rx GROUP BY 1) r USING (query_id)),
ox AS (SELECT query_id, source_rel, row_number() OVER (PARTITION BY query_id ORDER BY score, source_rel) AS rank FROM m WHERE query_id IN (SELECT query_id FROM per WHERE used_or)),
tiers AS (SELECT query_id, source_rel, rank, 0 AS tier FROM ex UNION ALL SELECT query_id, source_rel, rank, 1 FROM rx UNION ALL SELECT query_id, source_rel, rank, 2 FROM ox WHERE rank <= 10)"""

DAMAGED = rf"""{PG},
dm AS (SELECT page_key, section, source_rel, body AS ref,
         CASE WHEN doc_id % 101 = 0 THEN '' WHEN doc_id % 17 = 0 THEN regexp_replace(body, '\n[^\n]*$', '') ELSE body END AS md FROM pg)"""


def _frequencies(source: str = "dm", prefix: str = "") -> str:
    p = prefix
    return f"""{p}t AS (SELECT page_key, section, source_rel, regexp_extract_all(ref, {_W}) AS rt, regexp_extract_all(md, {_W}) AS mt FROM {source}),
{p}rs AS (SELECT page_key, pos, shingle FROM (SELECT page_key, i - 1 AS pos, n, concat_ws(' ', w, lead(w, 1) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v, lead(w, 4) OVER v) AS shingle FROM (SELECT page_key, lower(unnest(rt)) AS w, unnest(range(1, len(rt) + 1)) AS i, len(rt) AS n FROM {p}t)
  WINDOW v AS (PARTITION BY page_key ORDER BY i)) WHERE pos < greatest(n - 4, 1)),
{p}ms AS (SELECT page_key, pos, shingle FROM (SELECT page_key, i - 1 AS pos, n, concat_ws(' ', w, lead(w, 1) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v, lead(w, 4) OVER v) AS shingle FROM (SELECT page_key, lower(unnest(mt)) AS w, unnest(range(1, len(mt) + 1)) AS i, len(mt) AS n FROM {p}t)
  WINDOW v AS (PARTITION BY page_key ORDER BY i)) WHERE pos < greatest(n - 4, 1)),
{p}df AS (SELECT shingle, sum(r)::BIGINT AS ref_df, sum(m)::BIGINT AS md_df FROM (SELECT DISTINCT page_key, shingle, 1 AS r, 0 AS m FROM {p}rs UNION ALL SELECT DISTINCT page_key, shingle, 0, 1 FROM {p}ms) GROUP BY shingle)"""


def _clip(x: str) -> str:
    return f"CASE WHEN strlen({x}) <= 200 THEN {x} ELSE left({x}, list_max([k for k in range(50, 201) if strlen(left({x}, k)) <= 200])) || '...' END"


_CHECKABLE = "(df.ref_df <= 4 OR df.md_df >= 5)"
MISSING = f"""{DAMAGED}, {_frequencies()},
mw AS (SELECT rs.page_key, rs.pos, rs.shingle FROM rs JOIN t USING (page_key) JOIN df USING (shingle)
       WHERE len(t.rt) >= 5 AND {_CHECKABLE} AND NOT EXISTS (SELECT 1 FROM ms WHERE ms.page_key = rs.page_key AND ms.shingle = rs.shingle)),
mr AS (SELECT page_key, min(pos) AS start, count(*) AS windows FROM (SELECT *, pos - row_number() OVER (PARTITION BY page_key ORDER BY pos) AS island FROM mw) GROUP BY page_key, island HAVING count(*) >= 5),
mq AS (SELECT page_key, start, {_clip('quote')} AS quote FROM (
  SELECT mr.page_key, mr.start, array_to_string(t.rt[mr.start + 1:mr.start + mr.windows + 4], ' ') AS quote, row_number() OVER (PARTITION BY mr.page_key ORDER BY mr.start) AS k FROM mr JOIN t USING (page_key)) WHERE k <= 5)"""

_RATIO = """md0 AS (SELECT section, median(len(mt)::DOUBLE / len(rt)) AS median_ratio FROM t WHERE len(rt) >= 30 GROUP BY section),
ro AS (SELECT page_key, section, len(rt)::BIGINT AS ref_tokens, len(mt)::BIGINT AS md_tokens, len(mt)::DOUBLE / len(rt) AS ratio, len(mt)::DOUBLE / len(rt) < 0.4::DOUBLE * median_ratio AS ratio_outlier, len(mt)::DOUBLE / len(rt) < 0.25::DOUBLE * median_ratio AS ratio_gated
       FROM t JOIN md0 USING (section) WHERE len(rt) >= 30 AND median_ratio > 0)"""


def _short(t: str = "t", df: str = "df") -> str:
    inside = "list_bool_or([array_to_string([lower(x) for x in mt[i:i + len(rt) - 1]], ' ') = array_to_string([lower(x) for x in rt], ' ') for i in range(1, greatest(len(mt) - len(rt) + 1, 0) + 1)])"
    return f"""sh AS (SELECT page_key, {_clip("array_to_string(rt, ' ')")} AS quote FROM {t} JOIN {df} ON {df}.shingle = array_to_string([lower(x) for x in rt], ' ')
  WHERE len(rt) BETWEEN 1 AND 4 AND NOT coalesce({inside}, false) AND ({df}.ref_df <= 4 OR {df}.md_df >= 5))"""


FLAGS = f"""{MISSING}, {_RATIO}, {_short()},
lost AS (SELECT page_key, count(*) AS missing_span_count FROM mr GROUP BY 1),
hit AS (
  SELECT l.page_key, l.missing_span_count, (SELECT count(*) FROM mw WHERE mw.page_key = l.page_key) AS missing_shingle_count,
         (SELECT array_to_string(list(quote ORDER BY start), ' / ') FROM mq WHERE mq.page_key = l.page_key) AS samples FROM lost l
  UNION ALL SELECT page_key, 1, 1, quote FROM sh),
fl AS (SELECT t.page_key, t.section, t.source_rel, len(t.rt)::BIGINT AS ref_tokens, len(t.mt)::BIGINT AS md_tokens, round(CASE WHEN len(t.rt) > 0 THEN len(t.mt)::DOUBLE / len(t.rt) END, 9) AS derived_to_ref_token_ratio,
         coalesce(missing_shingle_count, 0)::BIGINT AS missing_shingle_count, coalesce(missing_span_count, 0)::BIGINT AS missing_span_count, coalesce(samples, '') AS missing_text_samples,
         coalesce(o.ratio_outlier, false) AS ratio_outlier, coalesce(o.ratio_gated, false) AS ratio_gated
       FROM t LEFT JOIN hit USING (page_key) LEFT JOIN (SELECT * FROM ro WHERE ratio_outlier) o USING (page_key) WHERE hit.page_key IS NOT NULL OR o.page_key IS NOT NULL)"""

BASELINE = f"""{FLAGS},
base AS (SELECT page_key, missing_span_count AS bs, missing_shingle_count AS bw, md_tokens AS bt FROM fl WHERE (missing_span_count > 0 OR ratio_gated) AND split_part(page_key, '/', 2)::BIGINT % 34 = 0
         UNION ALL SELECT 'en/unknown', 1, 5, 10),
ap AS (SELECT fl.*, (missing_span_count > 0 OR ratio_gated) AS gates,
         (missing_span_count > 0 OR ratio_gated) AND coalesce(missing_span_count <= bs AND missing_shingle_count <= bw AND md_tokens >= bt, false) AS baselined FROM fl LEFT JOIN base USING (page_key))"""

CASES = f"""el AS (SELECT section, source_rel, query FROM (SELECT section, source_rel, CASE WHEN strlen(title) < 4 THEN page_id ELSE title END AS query FROM pg) WHERE strlen(query) >= 4),
en AS (SELECT *, row_number() OVER (ORDER BY section, source_rel) - 1 AS rn, count(*) OVER () AS n FROM el)"""


def _cases(limit: int) -> str:
    return f"{CASES}, tc AS (SELECT 'generated:' || source_rel AS name, query, source_rel AS expected, section FROM en WHERE rn % greatest(n // {limit}, 1) = 0 AND rn // greatest(n // {limit}, 1) < {limit})"


BODY = f"""{PG},
bt0 AS (SELECT section, source_rel, {_terms('body')} AS t, list_concat({_terms('title')}, {_terms('page_id')}) AS banned FROM pg),
bt AS (SELECT section, source_rel, banned, unnest(range(len(t))) AS pos, unnest(t) AS term FROM bt0),
bf AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT source_rel, term FROM bt) GROUP BY term),
bw AS (SELECT section, source_rel, pos, sum(1000000 // df) OVER w AS score, sum(list_contains(banned, term)::INT) OVER w AS bad, list(term) OVER w AS ws
       FROM bt JOIN bf USING (term) WINDOW w AS (PARTITION BY source_rel ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
bq AS (SELECT section, source_rel, array_to_string(ws, ' ') AS query FROM (SELECT *, row_number() OVER (PARTITION BY source_rel ORDER BY score DESC, pos) AS k FROM bw WHERE len(ws) = 4 AND bad = 0) WHERE k = 1)"""

SUITE = f"""{INDEX}, {_cases(100)}, q AS (SELECT name AS query_id, query, section, expected FROM tc WHERE len({_terms('query')}) > 0)"""

CONCEPT = f"""{SUITE}, {_qt()}, {_match('m', 'qt')}, {_top('ex', 'm', True)}, {LEAST},
per1 AS (SELECT a.query_id, coalesce(b.n, 0) < 7 AND a.n_terms >= 2 AS relaxed, coalesce(b.n, 0) AS n_exact FROM (SELECT query_id, max(n_terms) AS n_terms FROM qt GROUP BY 1) a LEFT JOIN (SELECT query_id, count(*) AS n FROM ex GROUP BY 1) b USING (query_id)),
qr AS (SELECT qt.query_id, qt.pos, qt.term, qt.n_terms - 1 AS n_terms FROM qt JOIN per1 USING (query_id) JOIN ld USING (query_id) WHERE per1.relaxed AND qt.pos <> ld.pos),
{_match('mr', 'qr')}, {_top('rx', 'mr', True)},
oq AS (SELECT per1.query_id FROM per1 LEFT JOIN (SELECT query_id, count(*) AS n FROM rx GROUP BY 1) r USING (query_id) WHERE relaxed AND n_exact = 0 AND coalesce(r.n, 0) < 10),
ox AS (SELECT query_id, source_rel, row_number() OVER (PARTITION BY query_id ORDER BY score, source_rel) AS rank FROM m WHERE query_id IN (SELECT query_id FROM oq)),
tiers AS (SELECT query_id, source_rel, rank, 0 AS tier FROM ex UNION ALL SELECT query_id, source_rel, rank, 1 FROM rx UNION ALL SELECT query_id, source_rel, rank, 2 FROM ox WHERE rank <= 10),
h0 AS (SELECT query_id, source_rel, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS r FROM (SELECT query_id, source_rel, unnest(list(struct_pack(tier := tier, rank := rank) ORDER BY tier, rank)[1:1], recursive := true) FROM tiers GROUP BY query_id, source_rel)),
hs AS (SELECT query_id, list(source_rel ORDER BY r) AS hits FROM h0 WHERE r <= 10 GROUP BY 1),
cr AS (SELECT q.query_id, q.section, coalesce(list_contains(hs.hits, q.expected), false) AS passed, q.expected AS gold, coalesce(array_to_string(hs.hits, ' '), '') AS hits FROM q LEFT JOIN hs USING (query_id))"""

CANDIDATE = f"""{PG},
ca AS (SELECT section, page_id, page_key, source_rel, CASE WHEN doc_id % 140 = 1 THEN 'changed' ELSE title END AS title, CASE WHEN doc_id % 70 = 1 THEN body || '!' ELSE body END AS md FROM pg WHERE doc_id % 50 <> 0
       UNION ALL SELECT 'en', 'new', 'en/new', 'en/new.html', 'new', 'new'),
fm AS (SELECT p.page_key, CASE WHEN p.title <> c.title THEN 'title' WHEN p.body <> c.md THEN 'md' END AS field FROM pg p JOIN ca c USING (page_key) WHERE p.title <> c.title OR p.body <> c.md)"""

_HTML = r"hs AS (SELECT section, section || '/' || page_id || '.html' AS source_rel, html FROM (SELECT *, CASE WHEN regexp_extract(url, '/([a-z]{2})(?:/|$)', 1) = '' THEN 'en' ELSE regexp_extract(url, '/([a-z]{2})(?:/|$)', 1) END AS section FROM pages))"
_TITLE = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


def _first_line_lost(x: str) -> str:
    return rf"regexp_replace({x}, '^[^\n]*\n?', '')"


ORACLES: dict[str, str] = {
    "terms_tokenize": f"SELECT item_id, array_to_string(t, ' ') AS terms, len(t)::BIGINT AS n FROM (SELECT item_id, {_terms('text')} AS t FROM benchmark)",
    "plain_tokenize": rf"SELECT doc_id, array_to_string([lower(x) for x in regexp_extract_all(text, '[\p{{L}}\p{{Nd}}_.\-]+') if strlen(lower(x)) > 1], ' ') AS terms FROM documents",
    "word_tokens": f"SELECT doc_id, array_to_string(t, ' ') AS words, len(t)::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all(text, {_W}) AS t FROM documents)",
    "term_doc_freq": f"WITH {INDEX} SELECT term, doc, cnt FROM vocab",
    "doc_lengths": f"WITH {INDEX} SELECT source_rel, dl FROM dl",
    "index_stats": f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "postings_topterms": f"WITH {INDEX} SELECT * FROM (SELECT p.source_rel, p.term, tf_title, tf_body, dl, row_number() OVER (PARTITION BY p.source_rel ORDER BY tf_title + tf_body DESC, term) AS rank FROM post p JOIN dl USING (source_rel)) WHERE rank <= 3",
    "bm25_exact_topk": f"WITH {INDEX}, q AS (SELECT 1 AS query_id, 'the of and' AS query), {_qt()}, {_match('m', 'qt')}, {_top('ex', 'm', True)} SELECT query_id::BIGINT AS query_id, rank, ex.source_rel, section, title, round(score, 6) AS score FROM ex JOIN pg USING (source_rel)",
    "bm25_batch": f"WITH {INDEX}, {ASKED}, {_qt()}, {_match('m', 'qt')}, {_top('ex', 'm', True)} SELECT query_id, rank, source_rel, round(score, 6) AS score FROM ex",
    "bm25_or_topk": f"WITH {INDEX}, {ASKED}, {_qt()}, {_match('m', 'qt')}, {_top('ox', 'm', False)} SELECT query_id, rank, source_rel, round(score, 6) AS score FROM ox",
    "least_discriminative_term": f"WITH {INDEX}, {ASKED}, {_qt()}, {LEAST} SELECT query_id, pos, term, doc FROM ld",
    "relaxed_topk": f"WITH {INDEX}, {ASKED}, {_qt()}, {LEAST}, qr AS (SELECT qt.query_id, qt.pos, qt.term, qt.n_terms - 1 AS n_terms FROM qt JOIN ld USING (query_id) WHERE qt.n_terms >= 2 AND qt.pos <> ld.pos), {_match('mr', 'qr')}, {_top('rx', 'mr', True)} SELECT query_id, rank, source_rel, round(score, 6) AS score FROM rx",
    "search_stats": f"WITH {POLICY} SELECT query_id, (1 + relaxed::INT + used_or::INT)::BIGINT AS query_count, (CASE WHEN relaxed THEN n_terms ELSE 0 END)::BIGINT AS vocabulary_lookups, relaxed, used_or FROM per",
    "or_fallback_queries": f"WITH {POLICY} SELECT query_id FROM per WHERE used_or",
    "safe_fill": f"""WITH {POLICY}, f AS (SELECT query_id, source_rel, min(tier * 100 + rank) AS spot FROM tiers GROUP BY 1, 2)
SELECT query_id, source_rel, rank FROM (SELECT query_id, source_rel, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS rank FROM f) WHERE rank <= 10""",
    "fused_rrf": f"""WITH {POLICY}, f AS (SELECT query_id, source_rel, round(coalesce(max(CASE WHEN tier = 0 THEN 4.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN tier = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN tier = 2 THEN 0.5::DOUBLE / (60 + rank) END), 0), 12) AS score FROM tiers GROUP BY 1, 2)
SELECT query_id, source_rel, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_rel) AS rank FROM f) WHERE rank <= 10""",
    "exact_policy": f"WITH {INDEX}, {ASKED}, {_qt()}, {_match('m', 'qt')}, {_top('ex', 'm', True)} SELECT query_id, source_rel, rank FROM ex",
    "page_lookup": f"WITH {PG} SELECT page_key, body AS md FROM pg WHERE page_key = 'en/1'",
    "naive_scan_topk": rf"""WITH {PG}, {ASKED}, qp AS (SELECT query_id, [lower(x) for x in regexp_extract_all(query, '[\p{{L}}\p{{Nd}}_.\-]+') if strlen(lower(x)) > 1] AS t FROM q),
x AS (SELECT query_id, source_rel, unnest(range(len(t))) AS k, unnest(t) AS term, lower(body) AS b FROM qp CROSS JOIN pg),
y AS (SELECT query_id, source_rel, k, (length(b) - length(replace(b, term, ''))) // length(term) AS c FROM x),
z AS (SELECT query_id, source_rel, sum(c)::BIGINT AS score FROM y GROUP BY 1, 2 HAVING min(c) > 0)
SELECT * FROM (SELECT query_id, source_rel, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_rel) AS rank FROM z) WHERE rank <= 10""",
    "scan_vs_bm25_recall": rf"""WITH {INDEX}, {_cases(50)}, q AS (SELECT name AS query_id, query, section, expected FROM tc WHERE len({_terms('query')}) > 0), {_qt()}, {_match('m', 'qt')}, {_top('ex', 'm', True)},
qp AS (SELECT query_id, [lower(x) for x in regexp_extract_all(query, '[\p{{L}}\p{{Nd}}_.\-]+') if strlen(lower(x)) > 1] AS t FROM q),
x AS (SELECT query_id, source_rel, unnest(t) AS term, lower(body) AS b FROM qp CROSS JOIN pg),
z AS (SELECT query_id, source_rel, sum((length(b) - length(replace(b, term, ''))) // length(term)) AS score FROM x GROUP BY 1, 2 HAVING min((length(b) - length(replace(b, term, ''))) // length(term)) > 0),
sc AS (SELECT * FROM (SELECT query_id, source_rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_rel) AS rank FROM z) WHERE rank <= 10),
l AS (SELECT 'scan' AS lane, section, EXISTS (SELECT 1 FROM sc WHERE sc.query_id = q.query_id AND sc.source_rel = q.expected)::BIGINT AS hit FROM q
      UNION ALL SELECT 'bm25', section, EXISTS (SELECT 1 FROM ex WHERE ex.query_id = q.query_id AND ex.source_rel = q.expected)::BIGINT FROM q)
SELECT lane, section, count(*) AS cases, sum(hit)::BIGINT AS found FROM l GROUP BY 1, 2 UNION ALL SELECT lane, 'all', count(*), sum(hit)::BIGINT FROM l GROUP BY 1""",
    "shingle_df": f"WITH {DAMAGED}, {_frequencies()} SELECT * FROM df",
    "page_unique_shingles": f"WITH {DAMAGED}, {_frequencies()} SELECT * FROM df WHERE ref_df BETWEEN 1 AND 4",
    "shared_content_shingles": f"WITH {DAMAGED}, {_frequencies()} SELECT * FROM df WHERE ref_df > 4 AND md_df >= 5",
    "chrome_shingles": f"WITH {DAMAGED}, d2 AS (SELECT page_key, section, source_rel, ref, {_first_line_lost('md')} AS md FROM dm), {_frequencies('d2')} SELECT * FROM df WHERE ref_df > 4 AND md_df < 5",
    "shared_collapsed": f"WITH {DAMAGED}, {_frequencies('dm', 'a_')}, d2 AS (SELECT page_key, section, source_rel, ref, {_first_line_lost('md')} AS md FROM dm), {_frequencies('d2')} SELECT df.* FROM df JOIN a_df ON a_df.shingle = df.shingle WHERE a_df.ref_df > 4 AND a_df.md_df >= 5 AND df.ref_df > 4 AND df.md_df <= 4",
    "collapsed_quotes": f"""WITH {DAMAGED}, {_frequencies('dm', 'a_')}, d2 AS (SELECT page_key, section, source_rel, ref, {_first_line_lost('md')} AS md FROM dm), {_frequencies('d2')},
co AS (SELECT df.shingle FROM df JOIN a_df ON a_df.shingle = df.shingle WHERE a_df.ref_df > 4 AND a_df.md_df >= 5 AND df.ref_df > 4 AND df.md_df <= 4),
fi AS (SELECT rs.shingle, page_key, pos FROM rs JOIN co USING (shingle) QUALIFY row_number() OVER (PARTITION BY rs.shingle ORDER BY page_key, pos) = 1)
SELECT array_to_string(t.rt[fi.pos + 1:fi.pos + 5], ' ') AS quote FROM fi JOIN t USING (page_key)""",
    "missing_windows": f"WITH {MISSING} SELECT page_key, pos, shingle FROM mw",
    "missing_runs": f"WITH {MISSING} SELECT page_key, start, windows FROM mr",
    "missing_quotes": f"WITH {MISSING} SELECT page_key, start, quote FROM mq",
    "short_page_check": f"""WITH {PG}, dm AS (SELECT page_key, section, source_rel, body AS ref, CASE WHEN doc_id % 3 = 0 THEN '' ELSE body END AS md FROM pg),
{_frequencies()}, {_short()} SELECT page_key, quote FROM sh""",
    "ratio_median": f"WITH {DAMAGED}, {_frequencies()}, {_RATIO} SELECT section, round(median_ratio, 9) AS median_ratio FROM md0",
    "ratio_outliers": f"WITH {DAMAGED}, {_frequencies()}, {_RATIO} SELECT page_key, section, ref_tokens, md_tokens, round(ratio, 9) AS ratio, ratio_outlier, ratio_gated FROM ro WHERE ratio_outlier",
    "audit_flags": f"WITH {FLAGS} SELECT * FROM fl",
    "audit_baseline_apply": f"WITH {BASELINE} SELECT page_key, gates, baselined FROM ap",
    "audit_baseline_stale": f"WITH {BASELINE} SELECT page_key FROM base WHERE page_key NOT IN (SELECT page_key FROM ap WHERE gates)",
    "audit_verdict": f"""WITH {BASELINE}, d2 AS (SELECT page_key, section, source_rel, ref, {_first_line_lost('md')} AS md FROM dm), {_frequencies('d2', 'b_')},
sl AS (SELECT count(*)::BIGINT AS shared_loss FROM b_df JOIN df USING (shingle) WHERE df.ref_df > 4 AND df.md_df >= 5 AND b_df.ref_df > 4 AND b_df.md_df <= 4),
ps AS (SELECT (count(*) - count_if(doc_id % 50 <> 0))::BIGINT AS page_shrink FROM documents),
su AS (SELECT count_if(gates AND NOT baselined)::BIGINT AS new_flags, count_if(baselined)::BIGINT AS baselined, count_if(missing_span_count > 0)::BIGINT AS content_loss,
count_if(missing_span_count = 0 AND ratio_outlier)::BIGINT AS ratio_only FROM ap)
SELECT *, new_flags > 0 OR page_shrink > 0 OR shared_loss > 0 AS failed FROM su CROSS JOIN sl CROSS JOIN ps""",
    "page_shrink": "SELECT count(*) AS recorded, count_if(doc_id % 50 <> 0)::BIGINT AS now, (count(*) - count_if(doc_id % 50 <> 0))::BIGINT AS page_shrink FROM documents",
    "title_cases_stride": f"WITH {PG}, {_cases(100)} SELECT name, query, expected FROM tc",
    "body_query": f"WITH {BODY} SELECT section, source_rel, query FROM bq",
    "body_cases": f"""WITH {BODY}, r AS (SELECT *, row_number() OVER (ORDER BY section, source_rel) - 1 AS rn, count(*) OVER () AS n FROM bq),
i AS (SELECT unnest(range(60)) AS i) SELECT 'generated-body:' || source_rel AS name, query, source_rel AS expected FROM r JOIN i ON r.rn = i.i * n // least(60, n) WHERE i.i < least(60, n)""",
    "concept_results": f"WITH {CONCEPT} SELECT * FROM cr",
    "recall_by_section": f"WITH {CONCEPT} SELECT section, count(*) AS cases, count_if(passed)::BIGINT AS found FROM cr GROUP BY 1 UNION ALL SELECT 'all', count(*), count_if(passed)::BIGINT FROM cr",
    "nearest_rank_percentile": "SELECT lang, n AS count, n_chars AS value_p FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r = greatest(ceil(0.95::DOUBLE * n), 1)",
    "gold_missing": f"WITH {PG}, {_cases(100)} SELECT name AS query_id, expected AS source_rel FROM tc WHERE len({_terms('query')}) > 0 AND expected NOT IN (SELECT source_rel FROM pg WHERE doc_id % 10 <> 0)",
    "corpus_missing_keys": f"WITH {CANDIDATE} SELECT page_key, 'missing' AS side FROM pg WHERE page_key NOT IN (SELECT page_key FROM ca) UNION ALL SELECT page_key, 'unexpected' FROM ca WHERE page_key NOT IN (SELECT page_key FROM pg)",
    "corpus_field_mismatch": f"WITH {CANDIDATE} SELECT page_key, field FROM fm",
    "corpus_compare_summary": f"""WITH {CANDIDATE} SELECT (SELECT count(*) FROM pg) AS baseline_pages, (SELECT count(*) FROM ca) AS candidate_pages,
(SELECT count(*) FROM pg WHERE page_key NOT IN (SELECT page_key FROM ca)) AS missing_pages, (SELECT count(*) FROM ca WHERE page_key NOT IN (SELECT page_key FROM pg)) AS unexpected_pages,
(SELECT count(*) FROM fm) AS field_mismatches, 0::BIGINT AS missing_page_text, false AS passed""",
    "source_bijection": f"WITH {CANDIDATE} SELECT source_rel AS row_key, 'no source' AS rule FROM ca WHERE source_rel NOT IN (SELECT source_rel FROM pg) UNION ALL SELECT source_rel, 'no page' FROM pg WHERE source_rel NOT IN (SELECT source_rel FROM ca)",
    "duplicate_keys": f"""WITH {PG}, al AS (SELECT page_key, source_rel FROM pg UNION ALL SELECT page_key, source_rel FROM pg WHERE doc_id % 90 = 0
UNION ALL SELECT section || '/' || (doc_id - 1), source_rel FROM pg WHERE doc_id % 70 = 1)
SELECT page_key AS row_key, 'duplicate page_key' AS rule FROM al GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT source_rel, 'duplicate source_rel' FROM al GROUP BY 1 HAVING count(*) > 1""",
    "invalid_paths": rf"""WITH {PG}, v AS (SELECT page_key, section, page_id, CASE doc_id % 8 WHEN 1 THEN section || '/../x.html' WHEN 2 THEN '/' || source_rel WHEN 3 THEN section || '/a\b.html' WHEN 4 THEN section || '/x.txt' WHEN 5 THEN '' WHEN 6 THEN section || '/other.html' ELSE source_rel END AS s FROM pg)
SELECT row_key, rule FROM (SELECT page_key AS row_key, CASE WHEN s = '' THEN 'empty field' WHEN section NOT IN ('en', 'fr', 'de') THEN 'unknown section' WHEN contains(s, '\') OR starts_with(s, '/') OR contains(s, '/../') THEN 'unsafe path'
WHEN NOT starts_with(s, section || '/') OR NOT ends_with(lower(s), '.html') THEN 'outside section' WHEN page_key <> section || '/' || regexp_replace(substr(s, length(section) + 2), '\.html$', '') THEN 'key not from path' END AS rule FROM v) WHERE rule IS NOT NULL""",
    "index_parity": "SELECT count(*) AS pages, count(*) AS indexed, true AS equal FROM documents",
    "source_sha256": f"WITH {_HTML} SELECT source_rel, sha256(html) AS sha256, strlen(html)::BIGINT AS source_bytes FROM hs",
    "html_title": f"WITH {_HTML} SELECT source_rel, {_TITLE} AS title FROM hs",
    "search_index": f"WITH {PG} SELECT page_key, section, page_id, replace(title, chr(9), ' ') AS title, source_rel, '' AS canonical_url FROM pg",
    "content_links": rf"""WITH {_HTML}, l AS (SELECT source_rel, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
  unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">')))) AS i FROM hs),
f AS (SELECT source_rel, href, min(i) AS i, arg_min(text, i) AS text FROM l WHERE split_part(href, '#', 1) <> '' AND split_part(href, '#', 1) <> split_part(source_rel, '/', 2) GROUP BY 1, 2)
SELECT regexp_replace(source_rel, '\.html$', '') AS page_key, row_number() OVER (PARTITION BY source_rel ORDER BY i) - 1 AS pos, text, href FROM f""",
    "raw_html_lane": f"""WITH {_HTML}, pg AS (SELECT section, source_rel, {_TITLE} AS title, html AS body FROM hs), {_INDEX},
q AS (SELECT source_rel AS query_id, title AS query, section, source_rel AS expected FROM pg WHERE len({_terms('title')}) > 0), {_qt()}, {_match('m', 'qt')}, {_top('ex', 'm', True)},
l AS (SELECT section, EXISTS (SELECT 1 FROM ex WHERE ex.query_id = q.query_id AND ex.source_rel = q.expected)::BIGINT AS hit FROM q)
SELECT 'raw-bm25' AS lane, section, count(*) AS cases, sum(hit)::BIGINT AS found FROM l GROUP BY 2 UNION ALL SELECT 'raw-bm25', 'all', count(*), sum(hit)::BIGINT FROM l""",
    "raw_scan_lane": f"WITH {_HTML} SELECT source_rel, sha256(lower(html)) AS text_sha256, strlen(html)::BIGINT AS bytes FROM hs",
    "policy_totals": f"""WITH {POLICY} SELECT count(*) AS cases, sum(1 + relaxed::INT + used_or::INT)::BIGINT AS queries, sum(CASE WHEN relaxed THEN n_terms ELSE 0 END)::BIGINT AS lookups,
round(sum(1 + relaxed::INT + used_or::INT)::DOUBLE / count(*), 9) AS queries_per_case, round(sum(CASE WHEN relaxed THEN n_terms ELSE 0 END)::DOUBLE / count(*), 9) AS lookups_per_case FROM per""",
    "suite_leaks": f"""WITH {PG}, {_cases(100)}, c AS (SELECT name AS query_id, query, expected FROM tc WHERE len({_terms('query')}) > 0 UNION ALL SELECT 'path ' || name, replace(replace(expected, '/', ' '), '.', ' '), expected FROM tc WHERE len({_terms('query')}) > 0),
t AS (SELECT query_id, {_terms('query')} AS a, {_terms('expected')} AS b FROM c),
x AS (SELECT query_id, unnest([a[i] || ' ' || a[i + 1] for i in range(1, len(a))]) AS bigram, [b[i] || ' ' || b[i + 1] for i in range(1, len(b))] AS path FROM t)
SELECT DISTINCT query_id, bigram FROM x WHERE list_contains(path, bigram)""",
    "first_misses": f"""WITH {CONCEPT}, g AS (SELECT q.query_id, split_part(q.expected, '/', 1) AS section, split_part(q.expected, '/', 1) || '/1.html' AS gold FROM q)
SELECT g.query_id, g.section FROM g JOIN pg ON pg.source_rel = g.gold LEFT JOIN hs USING (query_id) WHERE NOT coalesce(list_contains(hs.hits, g.gold), false) ORDER BY g.query_id LIMIT 20""",
}

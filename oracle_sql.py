"""DuckDB SQL for every registered query (the correctness oracle).

These statements restate the engine's definitions in plain SQL over the
pre-registered views (``documents``, ``pages``, ``conversations``).  They are
written independently of the Spark plans: phrases are matched by exploding
positions, prefixes by a plain ``starts_with`` join, excluded folders by
string prefixes, and so on.  Only ASCII white space is used in queries, where
the two engines' white-space classes agree.
"""

from __future__ import annotations

from quarry.functions.stopwords import STOP_WORDS_EN
from quarry.plans import catalog as K
from quarry.sources import corpus as C

# Fixed values, stated here on their own so that the engine's lists are checked:
# extensions whose content is indexed, those that get a snippet, those of a
# text media type, and units of size.
INDEX_TEXT_EXTENSIONS = (
    "c conf cpp cs css csv doc docx go html ini java js json md pdf pptx py sql tsv txt xlsx xml yaml yml".split()
)
SNIPPET_TEXT_EXTENSIONS = (
    "bash babelrc c cfg clj cmake conf cpp css dockerfile editorconfig elm env eslintrc fish gitattributes gitignore go gradle h hs "
    "htm html ini java js json kt lock log m makefile maven md ml nodeversion nvmrc php pl prettierrc py r rb rs sbt scala sh sql "
    "swift tex toml txt xml yaml yml zsh".split()
)
TEXT_MEDIA_EXTENSIONS = "css htm html js mjs xml".split()
SIZE_UNITS = ("B", "KB", "MB", "GB")

WS = r"[ \t\n\r\f]"


def _s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(vals) -> str:
    return "[" + ", ".join(_s(v) for v in vals) + "]"


def trim_ws(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


MARK_CHARS = [  # joiner, marker code, classes
    (".", 1, ("L", "N")),
    ("'", 2, ("L", "N")),
    ("’", 3, ("L", "N")),
    (":", 4, ("L",)),
    (",", 5, ("N",)),
    (";", 6, ("N",)),
]
MARKERS_SQL = "chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)"
JOINERS_SQL = _s(".'’:,;")
WORD = r"[\p{L}\p{N}\p{M}_\x01-\x06]+"
WORDC = r"\p{L}\p{N}\p{M}_\x01-\x06"


def low(e: str) -> str:
    return f"lower(replace({e}, 'İ', 'i'))"


# An ideograph and its marks, set apart: no joining character joins it, no word runs through it.
IDEOGRAPH = r"[\p{Han}\p{Hiragana}]\p{M}*"


def apart(e: str) -> str:
    return f"regexp_replace({e}, '({IDEOGRAPH})', ' \\1 ', 'g')"


def mark(e: str) -> str:
    out = f"regexp_replace({e}, '[\\x01-\\x06]', ' ', 'g')"
    for ch, code, classes in MARK_CHARS:
        esc = "\\" + ch if ch in ".:" else ch.replace("'", "''")
        for cls in classes:
            pat = f"'(\\p{{{cls}}}){esc}(\\p{{{cls}}})'"
            rep = f"'\\1' || chr({code}) || '\\2'"
            for _ in range(2):
                out = f"regexp_replace({out}, {pat}, {rep}, 'g')"
    return out


def raw_tokens(e: str) -> str:
    return f"list_transform(regexp_extract_all({mark(apart(low(e)))}, '{WORD}'), lambda x: translate(x, {MARKERS_SQL}, {JOINERS_SQL}))"


STOP = _list(STOP_WORDS_EN)


def analyzed(e: str) -> str:
    return f"list_filter({raw_tokens(e)}, lambda x: NOT list_contains({STOP}, x))"


def ext(e: str) -> str:
    return f"lower(regexp_extract({e}, '\\.([^./]*)$', 1))"


def is_index_text(e: str) -> str:
    return f"list_contains({_list(INDEX_TEXT_EXTENSIONS)}, {ext(e)})"


def is_snippet_text(e: str) -> str:
    return f"list_contains({_list(SNIPPET_TEXT_EXTENSIONS + TEXT_MEDIA_EXTENSIONS)}, {ext(e)})"


def iso(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%dT%H:%M:%SZ')"


FILES = f"""files AS (
  SELECT '{C.CORPUS_ROOT}/' || source || '/' || lang || '/' ||
         CASE WHEN doc_id % {C.HIDDEN_DIR_MOD} = 0 THEN '.cache/' ELSE '' END || name AS path,
         name, false AS is_dir, CAST(strlen(text) AS BIGINT) AS size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS mod_time,
         text AS content, doc_id, source, lang
  FROM (SELECT *, CASE WHEN doc_id % {C.HIDDEN_FILE_MOD} = 0 THEN '.' ELSE '' END || 'doc' || CAST(doc_id AS VARCHAR)
               || {_list(C.FILE_EXTENSIONS)}[doc_id % 6 + 1] AS name FROM documents) d
)"""

TEXTS = """texts AS (
  SELECT '/corpus/' || source || '/' || lang || '/' || name AS path, name, CAST(strlen(text) AS BIGINT) AS size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS mod_time, text AS content, doc_id
  FROM (SELECT *, 'doc' || CAST(doc_id AS VARCHAR) || ['.txt', '.md', '.py', '.csv'][doc_id % 4 + 1] AS name FROM documents) d
)"""

# What a store holds at the end of its three runs.
EDITED = """edited AS (
  SELECT path, name, CASE WHEN doc_id % 5 = 0 THEN size + 33 ELSE size END AS size,
         CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE mod_time END AS mod_time,
         CASE WHEN doc_id % 5 = 0 THEN content || ' revised under the apache license' ELSE content END AS content, doc_id
  FROM texts
)"""

VISIBLE = f"""visible AS (
  SELECT * FROM files
  WHERE NOT is_dir AND starts_with(path, '{C.CORPUS_ROOT}/')
    AND NOT regexp_matches(substr(path, {len(C.CORPUS_ROOT) + 1}), '/[.]')
)"""

MANIFEST = """manifest AS (
  SELECT path, CASE WHEN doc_id % 5 = 0 THEN mod_time - INTERVAL 1 MINUTE ELSE mod_time END AS last_indexed
  FROM files WHERE doc_id % 3 <> 0
  UNION ALL
  SELECT '/corpus/gone/' || CAST(doc_id AS VARCHAR) || '.txt', mod_time FROM files WHERE doc_id % 50 = 0
)"""


def docs_from(src: str) -> str:
    return f"""docs AS (
  SELECT path AS id, path, name, CASE WHEN {is_index_text('name')} THEN coalesce(content, '') ELSE '' END AS content,
         size, mod_time
  FROM {src}
)"""


PAGES_FILES = """pfiles AS (
  SELECT '/pages/' || CAST(page_id AS VARCHAR) || '.html' AS path, CAST(page_id AS VARCHAR) || '.html' AS name,
         CAST(strlen(html) AS BIGINT) AS size, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS BIGINT)) AS mod_time,
         html AS content
  FROM pages
)"""

CONV_FILES = """cfiles AS (
  SELECT '/conversations/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt' AS path,
         CAST(turn AS VARCHAR) || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 100 + turn AS BIGINT)) AS mod_time,
         text AS content
  FROM conversations
)"""


INDEX = f"""tsrc AS (
  SELECT id AS doc_id, 'content' AS field, {raw_tokens('content')} AS toks FROM docs
  UNION ALL
  SELECT id, 'name', {raw_tokens('name')} FROM docs
),
tpos AS (
  SELECT doc_id, field, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM tsrc
),
kept AS (SELECT * FROM tpos WHERE NOT list_contains({STOP}, term)),
dls AS (SELECT doc_id, field, count(*) AS dl FROM kept GROUP BY doc_id, field),
postings AS (
  SELECT k.field, k.term, k.doc_id, count(*) AS tf, list(k.pos ORDER BY k.pos) AS positions, any_value(d.dl) AS dl
  FROM kept k JOIN dls d USING (doc_id, field)
  GROUP BY k.field, k.term, k.doc_id
  UNION ALL
  SELECT 'path', path, id, 1, [0], 1 FROM docs
),
term_stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
ndocs AS (SELECT count(*) AS n FROM docs)"""


def queries_values(rows) -> str:
    vals = ", ".join(f"({qid}, {_s(q)}, {pp}, {pg})" for qid, q, pp, pg in rows)
    return f"qin(query_id, query, per_page, page) AS (VALUES {vals})"


def idf(df: str) -> str:
    return f"(1.0 + ln((SELECT n FROM ndocs) / ({df} + 1.0)))"


def leaf(boost: str, df: str, tf: str, dl: str) -> str:
    i = idf(df)
    return f"({boost} * {i} * {i} * sqrt({tf}) / sqrt({dl}))"


SUBS = """subs(s, kind, field, boost, px) AS (VALUES
  (0, 'match', 'content', 3.0, false), (1, 'match', 'name', 2.0, false), (2, 'match', 'path', 1.0, false),
  (3, 'prefix', 'name', 1.5, true), (4, 'prefix', 'content', 1.5, true))"""


def search_ctes(phrase_mode: str = "as_built") -> str:
    ptext = "q" if phrase_mode == "as_built" else "ph"
    return f"""qd AS (
  SELECT query_id, query,
         CAST(CASE WHEN coalesce(per_page, 0) = 0 THEN 20 ELSE per_page END AS INTEGER) AS per_page,
         CAST(CASE WHEN coalesce(page, 0) = 0 THEN 1 ELSE page END AS INTEGER) AS page
  FROM qin
),
qvalid AS (
  SELECT * FROM qd
  WHERE coalesce(query, '') <> '' AND {trim_ws('query')} <> '' AND length(query) <= 1000
    AND per_page BETWEEN 0 AND 20 AND page >= 0
),
p1 AS (SELECT *, {low(trim_ws('query'))} AS q FROM qvalid),
p2 AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(q, '"([^"]*)"', 1), lambda x: {trim_ws('x')}), lambda x: x <> '') AS phrases,
         {trim_ws("regexp_replace(q, '\"[^\"]*\"', ' ', 'g')")} AS remaining
  FROM p1 WHERE q <> ''
),
p3 AS (
  SELECT *, CASE WHEN len(phrases) = 0 AND remaining = '' THEN q WHEN remaining <> '' THEN remaining END AS branch FROM p2
),
p4 AS (
  SELECT *, CASE WHEN branch IS NULL THEN []::VARCHAR[]
                 ELSE list_filter(regexp_split_to_array(branch, '{WS}+'), lambda x: x <> '') END AS terms FROM p3
),
prep AS (
  SELECT *, len(phrases) AS n_phr, len(terms) AS n_terms,
         len(phrases) + CASE WHEN len(terms) = 1 THEN (CASE WHEN strlen(terms[1]) >= 3 THEN 5 ELSE 3 END)
                             WHEN len(terms) > 1 THEN 2 ELSE 0 END AS n_children
  FROM p4
),
{SUBS},
groups AS (
  SELECT p.query_id, p.n_children, p.n_phr + subs.s AS c, -1 AS t, 0 AS s, subs.kind, subs.field,
         p.terms[1] AS term, subs.boost, 1 AS n_subs, 0 AS n_terms
  FROM prep p, subs WHERE p.n_terms = 1 AND (NOT subs.px OR strlen(p.terms[1]) >= 3)
  UNION ALL
  SELECT w.query_id, w.n_children, w.n_phr + 1, w.t, subs.s, subs.kind, subs.field, w.term, subs.boost,
         CASE WHEN strlen(w.term) >= 3 THEN 5 ELSE 3 END, w.n_terms
  FROM (SELECT query_id, n_children, n_phr, n_terms, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS t
        FROM prep WHERE n_terms > 1) w, subs
  WHERE NOT subs.px OR strlen(w.term) >= 3
),
gtok AS (
  SELECT g.*, {analyzed('g.term')} AS toks FROM groups g WHERE g.kind = 'match' AND g.field <> 'path'
),
exact AS (
  SELECT query_id, n_children, c, t, s, n_subs, n_terms, field, boost, len(toks) AS n_leaves, unnest(toks) AS lterm FROM gtok
  UNION ALL
  SELECT query_id, n_children, c, t, s, n_subs, n_terms, field, boost, 1, term FROM groups WHERE kind = 'match' AND field = 'path'
),
pexp AS (
  SELECT g.query_id, g.n_children, g.c, g.t, g.s, g.n_subs, g.n_terms, g.field, g.boost, ts.term AS lterm, ts.df
  FROM groups g JOIN term_stats ts ON ts.field = g.field AND starts_with(ts.term, g.term)
  WHERE g.kind = 'prefix'
),
leaves AS (
  SELECT e.*, ts.df FROM exact e JOIN term_stats ts ON ts.field = e.field AND ts.term = e.lterm
  UNION ALL
  SELECT query_id, n_children, c, t, s, n_subs, n_terms, field, boost,
         count(*) OVER (PARTITION BY query_id, c, t, s) AS n_leaves, lterm, df FROM pexp
),
lhits AS (
  SELECT l.query_id, p.doc_id, l.n_children, l.c, l.t, l.s, l.n_subs, l.n_terms, l.n_leaves,
         {leaf('l.boost', 'l.df', 'p.tf', 'p.dl')} AS leaf,
         CASE WHEN l.field = 'content' THEN p.positions[1] END AS lpos,
         CASE WHEN l.field = 'content' THEN l.lterm END AS lterm
  FROM leaves l JOIN postings p ON p.field = l.field AND p.term = l.lterm
),
grp AS (
  SELECT query_id, doc_id, n_children, c, t, s, n_subs, n_terms, n_leaves,
         sum(leaf) * count(*) / n_leaves AS gscore, min(lpos) AS lpos, arg_min(lterm, lpos) AS lterm
  FROM lhits GROUP BY query_id, doc_id, n_children, c, t, s, n_subs, n_terms, n_leaves
),
wrd AS (
  SELECT query_id, doc_id, n_children, c, t, n_subs, n_terms, sum(gscore) * count(*) / n_subs AS wscore,
         min(lpos) AS lpos, arg_min(lterm, lpos) AS lterm
  FROM grp WHERE t >= 0 GROUP BY query_id, doc_id, n_children, c, t, n_subs, n_terms
),
conj AS (
  SELECT query_id, doc_id, n_children, c, sum(wscore) AS cscore, min(lpos) AS lpos, arg_min(lterm, lpos) AS lterm
  FROM wrd GROUP BY query_id, doc_id, n_children, c, n_terms HAVING count(*) = n_terms
),
phr AS (
  SELECT query_id, n_children, c, {ptext} AS text, 6.0 AS boost
  FROM (SELECT query_id, n_children, q, unnest(phrases) AS ph, generate_subscripts(phrases, 1) - 1 AS c FROM prep) x
  UNION ALL
  SELECT query_id, n_children, n_phr, CASE WHEN n_phr = 0 AND remaining = '' THEN q ELSE remaining END, 5.0
  FROM prep WHERE n_terms > 1
),
ptok0 AS (
  SELECT query_id, n_children, c, boost, len({analyzed('text')}) AS k, {raw_tokens('text')} AS rt FROM phr
),
ptok AS (
  SELECT * FROM (
    SELECT query_id, n_children, c, boost, k, unnest(rt) AS lterm, generate_subscripts(rt, 1) - 1 AS off FROM ptok0
  ) x WHERE NOT list_contains({STOP}, lterm)
),
pj AS (
  SELECT t.query_id, t.n_children, t.c, t.k, t.off, t.lterm, p.doc_id, p.positions,
         {leaf('t.boost', 'ts.df', 'p.tf', 'p.dl')} AS leaf
  FROM ptok t JOIN term_stats ts ON ts.field = 'content' AND ts.term = t.lterm
  JOIN postings p ON p.field = 'content' AND p.term = t.lterm
),
pstart AS (
  SELECT query_id, c, doc_id, k, off, unnest(positions) - off AS st FROM pj
),
pok AS (
  SELECT DISTINCT query_id, c, doc_id FROM (
    SELECT query_id, c, doc_id, st FROM pstart GROUP BY query_id, c, doc_id, st, k HAVING count(DISTINCT off) = k
  ) x
),
pch AS (
  SELECT j.query_id, j.doc_id, j.n_children, j.c, sum(j.leaf) AS cscore,
         min(j.positions[1]) AS lpos, arg_min(j.lterm, j.positions[1]) AS lterm
  FROM pj j JOIN pok USING (query_id, c, doc_id)
  GROUP BY j.query_id, j.doc_id, j.n_children, j.c
),
children AS (
  SELECT query_id, doc_id, n_children, c, gscore AS cscore, lpos, lterm FROM grp WHERE t < 0
  UNION ALL SELECT query_id, doc_id, n_children, c, cscore, lpos, lterm FROM conj
  UNION ALL SELECT query_id, doc_id, n_children, c, cscore, lpos, lterm FROM pch
),
matches AS (
  SELECT query_id, doc_id, CAST(CAST(sum(cscore) * count(*) / n_children AS FLOAT) AS DOUBLE) AS score,
         min(lpos) AS lpos, arg_min(lterm, lpos) AS lterm
  FROM children GROUP BY query_id, doc_id, n_children
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ASC) AS rnk FROM matches
),
tot AS (SELECT query_id, count(*) AS total_results, max(score) AS max_score FROM matches GROUP BY query_id),
pagehits AS (
  SELECT r.*, p.per_page, p.page FROM ranked r JOIN prep p USING (query_id)
  WHERE r.rnk > (p.page - 1) * p.per_page AND r.rnk <= p.page * p.per_page
),
hits AS (
  SELECT h.query_id, CAST(h.rnk AS BIGINT) AS rank, d.id, d.path, d.name, h.score, d.size, {iso('d.mod_time')} AS mod_time,
         d.content, h.lterm
  FROM pagehits h JOIN docs d ON d.id = h.doc_id
)"""


def snippet_bytes_sql(content: str, name: str, term: str) -> str:
    """Windows of 100 bytes: the longest stretches of whole characters that fit on both sides."""
    pat = f"'(?s)^(|.*?[^{WORDC}])\\Q' || translate({term}, {JOINERS_SQL}, {MARKERS_SQL}) || '\\E(?:[^{WORDC}]|$)'"
    start = f"length(regexp_extract({mark(low(content))}, {pat}, 1))"
    parts = f"""SELECT *, substring(content, 1, st) AS pre, substring(content, st + 1, length({term})) AS mid,
    substring(content, st + length({term}) + 1) AS post FROM (SELECT *, {start} AS st FROM hits) h"""
    before = "list_max(list_filter(range(0, 101), lambda k: k <= length(pre) AND strlen(right(pre, k)) <= 100))"
    after = "list_max(list_filter(range(0, 101), lambda k: k <= length(post) AND strlen(left(post, k)) <= 100))"
    body = f"right(pre, {before}) || mid || left(post, {after})"
    win = f"""(CASE WHEN strlen(pre) > 100 THEN '...' ELSE '' END || {trim_ws(body)}
    || CASE WHEN strlen(post) > 100 THEN '...' ELSE '' END)"""
    return f"""SELECT query_id, rank, path, CASE WHEN {term} IS NOT NULL AND {is_snippet_text(name)}
    AND coalesce({content}, '') <> '' THEN {win} ELSE '' END AS snippet FROM ({parts}) p"""


def snippet_sql(content: str, name: str, term: str) -> str:
    marked = mark(low(content))
    mterm = f"translate({term}, {JOINERS_SQL}, {MARKERS_SQL})"
    pat = f"'(?s)^(|.*?[^{WORDC}])\\Q' || {mterm} || '\\E(?:[^{WORDC}]|$)'"
    start = f"length(regexp_extract({marked}, {pat}, 1))"
    n = f"length({content})"
    s0 = f"greatest(0, {start} - 100)"
    s1 = f"least({n}, {start} + length({term}) + 100)"
    body = f"substring({content}, {s0} + 1, {s1} - {s0})"
    win = f"(CASE WHEN {s0} > 0 THEN '...' ELSE '' END || {trim_ws(body)} || CASE WHEN {s1} < {n} THEN '...' ELSE '' END)"
    return f"CASE WHEN {term} IS NOT NULL AND {is_snippet_text(name)} AND coalesce({content}, '') <> '' THEN {win} ELSE '' END"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CORPUS_SEARCH_PREFIX = (TEXTS, docs_from("texts"), INDEX)

HITS_COLS = "SELECT query_id, rank, path, name, score, size, mod_time FROM hits"
MATCH_COLS = "SELECT query_id, doc_id AS path, score FROM matches"


def _one(query: str, per_page: int = 0, page: int = 0) -> str:
    return _with(*CORPUS_SEARCH_PREFIX, queries_values([(1, query, per_page, page)]), search_ctes())


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    out["listing_visible"] = _with(FILES, VISIBLE) + "SELECT path, name, size FROM visible"
    ex_cond = " OR ".join(f"starts_with(path, {_s(e + '/')})" for e in C.CORPUS_EXCLUDES)
    out["listing_excluded"] = _with(FILES, VISIBLE) + f"SELECT path FROM visible WHERE NOT ({ex_cond})"
    out["text_class"] = _with(FILES) + (
        f"SELECT path, {is_index_text('name')} AS is_text, {is_snippet_text('name')} AS is_snippet_text FROM files"
    )
    changed = """changed AS (
  SELECT v.*, m.last_indexed, CASE WHEN m.path IS NULL THEN 'new' ELSE 'changed' END AS reason
  FROM visible v LEFT JOIN manifest m USING (path)
  WHERE m.path IS NULL OR v.mod_time > m.last_indexed
)"""
    gone = """gone AS (
  SELECT path FROM manifest WHERE starts_with(path, '/corpus/') AND path NOT IN (SELECT path FROM files)
)"""
    prev = f"""prevsrc AS (
  SELECT v.path, v.name, v.size, m.last_indexed AS mod_time, v.content FROM visible v JOIN manifest m USING (path)
  UNION ALL
  SELECT m.path, regexp_extract(m.path, '([^/]*)$', 1), 0, m.last_indexed, '' FROM manifest m
  WHERE m.path NOT IN (SELECT path FROM visible)
),
prev AS (
  SELECT path AS id, name, size, mod_time,
         CASE WHEN {is_index_text('name')} THEN coalesce(content, '') ELSE '' END AS content FROM prevsrc
)"""
    base = (FILES, VISIBLE, MANIFEST)
    out["changed_files"] = _with(*base, changed) + "SELECT path, reason FROM changed"
    out["deleted_files"] = _with(*base, gone) + "SELECT path FROM gone"
    out["upsert_documents"] = _with(*base, changed, prev) + f"""SELECT id, name, size, {iso('mod_time')} AS mod_time,
  CAST(length(content) AS BIGINT) AS n_chars FROM (
  SELECT * FROM prev WHERE id NOT IN (SELECT path FROM changed)
  UNION ALL
  SELECT path, name, size, mod_time, CASE WHEN {is_index_text('name')} THEN content ELSE '' END FROM changed
) u"""
    out["delete_documents"] = _with(*base, gone, prev) + "SELECT id FROM prev WHERE id NOT IN (SELECT path FROM gone)"
    out["manifest_upsert"] = _with(*base, changed, gone) + f"""SELECT path, {iso('last_indexed')} AS last_indexed FROM (
  SELECT path, last_indexed FROM manifest
  WHERE path NOT IN (SELECT path FROM gone) AND path NOT IN (SELECT path FROM changed)
  UNION ALL
  SELECT path, TIMESTAMP '{K.RUN_TS}' FROM changed
) u"""
    out["manifest_lookup"] = _with(*base) + f"""SELECT f.path, m.path IS NOT NULL AS found, {iso('m.last_indexed')} AS last_indexed
FROM files f LEFT JOIN manifest m ON m.path = f.path AND m.path <> '' WHERE f.path <> ''"""
    frac = "regexp_replace(strftime(last_indexed, '%f'), '0+$', '')"
    out["manifest_json"] = _with(*base) + f"""SELECT 'files' AS bucket, path AS key,
  '{{"last_indexed":"' || strftime(last_indexed, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END || 'Z"}}' AS value
FROM manifest"""
    out["manifest_buckets"] = _with(*base, changed, gone) + """SELECT path AS key, 'files' AS bucket FROM manifest
WHERE path NOT IN (SELECT path FROM gone)
UNION ALL SELECT path, 'default' FROM changed"""
    out["run_progress"] = _with(TEXTS, docs_from("texts")) + """, ledger AS (
  SELECT regexp_extract(id, '^(.*)/[^/]*$', 1) AS batch, count(*) AS n_done FROM docs GROUP BY 1
), run AS (
  SELECT batch, n_done, sum(n_done) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_done,
         sum(n_done) OVER () AS n_total FROM ledger
)
SELECT batch, CAST(n_done AS BIGINT) AS n_done, CAST(cum_done AS BIGINT) AS cum_done,
  CAST(CASE WHEN cum_done = 0 OR n_total = 0 THEN 20 WHEN cum_done >= n_total THEN 100
       ELSE trunc(20.0 + (cum_done::DOUBLE / n_total::DOUBLE) * 80.0) END AS BIGINT) AS progress
FROM run"""
    out["doc_count"] = _with(TEXTS, docs_from("texts")) + "SELECT CAST(count(*) AS BIGINT) AS n_docs FROM docs"
    cap = K.CONTENT_CAP_TEST_BYTES
    out["content_cap"] = _with(FILES, VISIBLE) + f"""SELECT path, CAST(CASE WHEN strlen(content) <= {cap} THEN strlen(content)
    ELSE (SELECT max(strlen(content[:i])) FROM range({cap} // 4, {cap} + 1) t(i) WHERE strlen(content[:i]) <= {cap}) END AS BIGINT) AS capped_bytes,
  size > {cap} AS truncated FROM visible WHERE {is_index_text('name')}"""
    idx = CORPUS_SEARCH_PREFIX
    out["term_frequencies"] = _with(*idx) + """SELECT field, term, doc_id, CAST(tf AS BIGINT) AS tf,
  array_to_string(list_transform(positions, lambda x: CAST(x AS VARCHAR)), ',') AS positions FROM postings"""
    out["field_lengths"] = _with(TEXTS, docs_from("texts")) + f"""SELECT 'content' AS field, id AS doc_id, CAST(len({analyzed('content')}) AS BIGINT) AS len FROM docs
UNION ALL SELECT 'name', id, CAST(len({analyzed('name')}) AS BIGINT) FROM docs
UNION ALL SELECT 'path', id, 1 FROM docs"""
    out["doc_frequencies"] = _with(*idx) + "SELECT field, term, CAST(df AS BIGINT) AS df FROM term_stats"
    bq = ", ".join(f"({qid}, {_s(q)})" for qid, q, _, _ in K.BATCH_QUERIES)
    out["parse_queries"] = f"""WITH qs AS (
  SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations
  UNION ALL SELECT * FROM (VALUES {bq}) v(query_id, query)
), p AS (SELECT query_id, {low(trim_ws('query'))} AS q FROM qs),
p2 AS (
  SELECT query_id, q,
    list_filter(list_transform(regexp_extract_all(q, '"([^"]*)"', 1), lambda x: {trim_ws('x')}), lambda x: x <> '') AS phrases,
    {trim_ws("regexp_replace(q, '\"[^\"]*\"', ' ', 'g')")} AS remaining
  FROM p
)
SELECT query_id, q, array_to_string(phrases, '|') AS phrases, CAST(len(phrases) AS BIGINT) AS n_phrases, remaining,
  CAST(len(list_filter(regexp_split_to_array(remaining, '{WS}+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM p2"""
    out["search_term"] = _one(K.SINGLE_TERM) + MATCH_COLS
    out["search_prefix"] = _one(K.SINGLE_PREFIX) + MATCH_COLS
    out["search_filename"] = _one(K.SINGLE_FILENAME) + MATCH_COLS
    out["search_phrase"] = _one(K.SINGLE_PHRASE) + MATCH_COLS
    out["search_quoted"] = _one(K.SINGLE_QUOTED) + MATCH_COLS
    phrases = _with(*CORPUS_SEARCH_PREFIX, queries_values(K.PHRASE_QUERIES), search_ctes("per_phrase"))
    out["search_per_phrase"] = phrases + MATCH_COLS
    out["search_and"] = _one(K.SINGLE_AND) + MATCH_COLS
    out["search_ranked_topk"] = _one(K.SINGLE_TERM, 10, 1) + HITS_COLS
    out["search_page"] = _one(K.SINGLE_PREFIX, 5, 2) + HITS_COLS
    batch = _with(*CORPUS_SEARCH_PREFIX, queries_values(K.BATCH_QUERIES), search_ctes())
    out["search_batch"] = batch + HITS_COLS
    out["page_details"] = batch + """SELECT p.query_id, CAST(coalesce(t.total_results, 0) AS BIGINT) AS total_results,
  CAST(coalesce(t.max_score, 0.0) AS DOUBLE) AS max_score,
  CAST(p.page AS BIGINT) AS current_page, CAST(p.per_page AS BIGINT) AS page_size,
  CAST(greatest(ceil(coalesce(t.total_results, 0) / p.per_page), 1) AS BIGINT) AS total_pages,
  p.page < greatest(ceil(coalesce(t.total_results, 0) / p.per_page), 1) AS has_next_page,
  p.page > 1 AS has_prev_page
FROM prep p LEFT JOIN tot t USING (query_id)"""
    out["snippets_bytes"] = batch + snippet_bytes_sql("content", "name", "lterm")
    turned = "translate(coalesce(text, ''), " + ", ".join(map(_s, K.IDEOGRAPH_LETTERS)) + ")"
    out["ideograph_tokens"] = f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, {raw_tokens(turned)} AS t FROM documents) d"""
    out["snippets"] = batch + f"SELECT query_id, rank, path, {snippet_sql('content', 'name', 'lterm')} AS snippet FROM hits"
    out["search_deep_pages"] = _with(*CORPUS_SEARCH_PREFIX, queries_values(K.DEEP_QUERIES), search_ctes()) + HITS_COLS
    blank = [q for q in K.BLANK_QUERIES if not q[1].strip()]
    other = [q for q in K.BLANK_QUERIES if q[1].strip()]
    pages = ", ".join(f"({i}, {per}, {page})" for i, _, per, page in blank)
    out["search_match_all"] = _with(*CORPUS_SEARCH_PREFIX, queries_values(other), search_ctes()) + f"""{HITS_COLS}
UNION ALL
SELECT b.query_id, d.rank, d.path, d.name, 1.0, d.size, {iso('d.mod_time')}
FROM (VALUES {pages}) b(query_id, per_page, page)
JOIN (SELECT *, row_number() OVER (ORDER BY id) AS rank FROM docs) d
  ON d.rank > (b.page - 1) * b.per_page AND d.rank <= b.page * b.per_page"""
    done = (TEXTS, EDITED, docs_from("edited"), INDEX)
    out["store_documents"] = _with(TEXTS, EDITED) + f"""SELECT path AS id, name, size, {iso('mod_time')} AS mod_time,
  CAST(length(content) AS BIGINT) AS n_chars, false AS truncated FROM edited"""
    out["store_manifest"] = _with(TEXTS) + """SELECT path,
  CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN '2031-01-01T00:00:00Z' ELSE '2029-01-01T00:00:00Z' END AS last_indexed FROM texts"""
    out["store_term_stats"] = _with(*done) + "SELECT field, term, CAST(df AS BIGINT) AS df FROM term_stats"
    out["store_search"] = _with(*done, queries_values(K.STORE_QUERIES), search_ctes()) + MATCH_COLS
    out["store_ledger"] = _with(TEXTS) + """SELECT run_id, CAST(100 AS BIGINT) AS status, CAST(n_done AS BIGINT) AS n_done,
  CAST(n_total AS BIGINT) AS n_total, CAST(3 AS BIGINT) AS n_records FROM (
  SELECT 'run1' AS run_id, count(*) FILTER (doc_id % 3 <> 0) + count(*) FILTER (doc_id % 50 = 0) AS n_done, n_done AS n_total FROM texts
  UNION ALL SELECT 'run2', count(*) FILTER (doc_id % 3 = 0 OR doc_id % 5 = 0) AS n, n FROM texts
  UNION ALL SELECT 'run3', 0, 0) r"""
    out["store_compacted"] = _with(*done) + (
        "SELECT field, term, doc_id, CAST(tf AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl FROM postings"
    )
    out["search_pages"] = _with(PAGES_FILES, docs_from("pfiles"), INDEX, queries_values(K.PAGE_QUERIES), search_ctes()) + HITS_COLS
    out["search_conversations"] = (
        _with(CONV_FILES, docs_from("cfiles"), INDEX, queries_values(K.CONVERSATION_QUERIES), search_ctes()) + HITS_COLS
    )
    out["validate_queries"] = f"""WITH req AS (
  SELECT conv_id * 1000 + turn AS query_id, CASE WHEN role = 'system' THEN '   ' ELSE text END AS query,
         CAST(turn * 3 - 2 AS INTEGER) AS per_page, CAST(conv_id % 4 - 1 AS INTEGER) AS page FROM conversations
), d AS (
  SELECT query_id, query, CASE WHEN coalesce(per_page, 0) = 0 THEN 20 ELSE per_page END AS per_page,
         CASE WHEN coalesce(page, 0) = 0 THEN 1 ELSE page END AS page FROM req
)
SELECT query_id, CAST(per_page AS BIGINT) AS per_page, CAST(page AS BIGINT) AS page,
  CASE WHEN coalesce(query, '') = '' THEN 'missing required field ''query'''
       WHEN {trim_ws("coalesce(query, '')")} = '' THEN 'invalid query'
       WHEN length(query) > 1000 THEN 'value or length of field ''query'' is not in the expected range'
       WHEN per_page < 0 OR per_page > 20 THEN 'value or length of field ''per_page'' is not in the expected range'
       WHEN page < 0 THEN 'value or length of field ''page'' is not in the expected range'
  END AS error
FROM d"""
    out["validate_excludes"] = _with(FILES) + f""", existing AS (
  SELECT path FROM files
  UNION SELECT DISTINCT '/corpus/' || source FROM files
  UNION SELECT DISTINCT '/corpus/' || source || '/' || lang FROM files
  UNION SELECT DISTINCT '/corpus/' || source || '/' || lang || '/.cache' FROM files WHERE doc_id % 41 = 0
  UNION SELECT '/corpus'
  UNION SELECT '/'
), req AS (
  SELECT DISTINCT source || '/' || lang AS request_id, '/corpus/' || source AS path,
    '/corpus/' || source || '/' || lang || ' , ,' ||
    CASE WHEN lang = 'en' THEN '/corpus/src1' WHEN lang = 'de' THEN '/corpus/' || source
         WHEN lang = 'fr' THEN 'relative/path'
         WHEN lang = 'es' THEN '/corpus/' || source || '/es/' ELSE '' END AS exclude_text
  FROM files
), r2 AS (
  SELECT *, list_filter(list_transform(string_split(exclude_text, ','), lambda x: {trim_ws('x')}), lambda x: x <> '') AS excludes FROM req
), items AS (
  SELECT request_id, path, unnest(excludes) AS ex, generate_subscripts(excludes, 1) AS i FROM r2
), itemflags AS (
  SELECT request_id, i,
    (ex = '' OR ({trim_ws('ex')} <> '' AND strpos(ex, chr(0)) = 0 AND starts_with(ex, '/') AND regexp_replace(ex, '(.)/+$', '\\1') IN (SELECT path FROM existing))) AS ok,
    CASE WHEN ex = path THEN 'path to exclude cannot be the same as index path'
         WHEN NOT starts_with(ex, path) THEN 'path to exclude must begin with the index path' END AS sem_err
  FROM items
), flags AS (
  SELECT request_id, bool_and(ok) AS all_ok, arg_min(sem_err, CASE WHEN sem_err IS NOT NULL THEN i END) AS sem_err
  FROM itemflags GROUP BY request_id
)
SELECT r.request_id, array_to_string(r.excludes, '|') AS excludes,
  CASE WHEN r.path = '' THEN 'missing required field ''path'''
       WHEN NOT (r.path IN (SELECT path FROM existing) AND starts_with(r.path, '/')) THEN 'invalid path'
       WHEN NOT coalesce(f.all_ok, true) THEN 'invalid exclude path(s)'
       ELSE f.sem_err END AS error
FROM r2 r LEFT JOIN flags f USING (request_id)"""
    units = _list(SIZE_UNITS)
    e = "CAST(least(floor(ln(greatest(size, 1)) / ln(1024)), 3) AS INTEGER)"
    out["format_size"] = _with(FILES) + f"""SELECT path, size,
  CASE WHEN size = 0 THEN '0 B'
       ELSE regexp_replace(printf('%.1f', round(size / pow(1024, {e}), 1)), '\\.0$', '') || ' ' || {units}[{e} + 1] END AS size_text
FROM files"""
    return out

"""The SQL each registered query of the core is checked against, for DuckDB over the same tables."""

SQL: dict[str, str] = {}

_TOKEN = r"[a-zA-Z_][\p{L}\p{N}_]*"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_SPACE = "[^" + _SPACE[1:]
_W = r"[\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+\z', '')"


def _count_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_NOT_SPACE}+'))"


# Shared parts: the tables that several queries build on.

_VEC = """
vec AS (SELECT chunk_id, project_id, embedding FROM chunk_vectors
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_VECTORS = f"""{_VEC},
asked AS (SELECT i.item_id AS query_id, i.query, i.expected_files, i.expected_names, v.embedding
          FROM eval_items i LEFT JOIN (SELECT chunk_id - 1 AS query_id, min(embedding) AS embedding FROM vec GROUP BY 1) v ON v.query_id = i.item_id)"""

_BM25 = f"""
tok AS MATERIALIZED (SELECT chunk_id, regexp_extract_all(lower(coalesce(content, '')), '{_TOKEN}') AS ts FROM chunks),
len AS MATERIALIZED (SELECT chunk_id, len(ts) AS dl FROM tok),
post AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
freq AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT count(*) AS n, coalesce(avg(dl), 1.0) AS avg_dl FROM len),
qt AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{_TOKEN}')) AS term FROM asked) GROUP BY ALL),
score AS MATERIALIZED (SELECT q.query_id, p.chunk_id, round(sum(q.qtf * ln((c.n - f.df + 0.5) / (f.df + 0.5) + 1) * (p.tf * 2.5) / (p.tf + 1.5 * (1 - 0.75 + 0.75 * t.dl / c.avg_dl))), 9) AS score
          FROM qt q JOIN freq f USING (term) JOIN post p USING (term) JOIN len t ON t.chunk_id = p.chunk_id CROSS JOIN corpus c GROUP BY ALL),
words AS MATERIALIZED (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank
          FROM (SELECT a.query_id, t.chunk_id, coalesce(s.score, 0.0) AS score FROM asked a CROSS JOIN len t LEFT JOIN score s ON s.query_id = a.query_id AND s.chunk_id = t.chunk_id)
          QUALIFY rank < 20)"""


def _near(k: int) -> str:
    return f"""
near AS MATERIALIZED (SELECT query_id, chunk_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, chunk_id) - 1 AS rank
         FROM (SELECT a.query_id, v.chunk_id, min(round(list_sum(list_transform(list_zip(a.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 9)) AS d2
               FROM asked a CROSS JOIN vec v WHERE a.embedding IS NOT NULL GROUP BY ALL)
         QUALIFY rank < {k})"""


def _fused(lists: str) -> str:
    return f"""
fused AS (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen) - 1 AS rank
          FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (61 + rank)), 12) AS rrf_score, min((list, rank)) AS seen FROM ({lists}) GROUP BY ALL))"""


_LISTS = "SELECT query_id, chunk_id, rank, 0 AS list FROM near UNION ALL SELECT query_id, chunk_id, rank, 1 FROM words"
_CUT_LISTS = "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, chunk_id) - 1 AS rank, 0 AS list FROM near WHERE d2 < 2.0 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM words"


def _hybrid(final_k: int) -> str:
    return f"WITH {_VECTORS}, {_BM25}, {_near(20)}, {_fused(_CUT_LISTS)}, hits AS (SELECT query_id, rank, chunk_id, rrf_score FROM fused WHERE rank < {final_k})"


def _judged(hits: str) -> str:
    return f"""
good AS (SELECT h.query_id, h.rank,
         coalesce(len(list_filter(a.expected_files, lambda e: contains(coalesce(c.file_name, ''), e))) > 0, false)
         OR coalesce(len(list_filter(a.expected_names, lambda e: contains(lower(coalesce(c.name, '')), lower(e)) OR contains(lower(coalesce(c.content, '')), lower(e)))) > 0, false) AS good
         FROM {hits} h JOIN chunks c USING (chunk_id) JOIN asked a ON a.query_id = h.query_id),
judged AS (SELECT a.query_id, coalesce(count(*) FILTER (good AND rank < 1), 0) / 1.0::DOUBLE AS p_at_1, count(*) FILTER (good AND rank < 3) / 3.0::DOUBLE AS p_at_3,
           count(*) FILTER (good AND rank < 5) / 5.0::DOUBLE AS p_at_5, coalesce(1.0::DOUBLE / (min(rank) FILTER (good) + 1), 0.0) AS reciprocal_rank, count(rank) AS results
           FROM asked a LEFT JOIN good g USING (query_id) GROUP BY a.query_id)"""


_REPORT = "count(*) AS queries, round_even(avg(p_at_1), 4) AS p_at_1, round_even(avg(p_at_3), 4) AS p_at_3, round_even(avg(p_at_5), 4) AS p_at_5, round_even(avg(reciprocal_rank), 4) AS mrr"

SQL["tokenize_terms"] = f"WITH {_VECTORS}, {_BM25} SELECT chunk_id, term, tf FROM post"
SQL["bm25_stats"] = f"WITH {_VECTORS}, {_BM25} SELECT n, round(avg_dl, 6) AS avg_dl, (SELECT count(*) FROM freq) AS terms, (SELECT max(df) FROM freq) AS max_df, (SELECT sum(df)::BIGINT FROM freq) AS postings FROM corpus"
SQL["bm25_scores"] = f"WITH {_VECTORS}, {_BM25} SELECT query_id, chunk_id, round(score, 4) AS score FROM score"
SQL["bm25_topk"] = f"WITH {_VECTORS}, {_BM25} SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM words"
SQL["vector_topk"] = f"WITH {_VECTORS}, {_near(20)} SELECT query_id, rank, chunk_id, round(d2, 4) AS d2 FROM near"
SQL["vector_threshold"] = f"WITH {_VECTORS}, {_near(20)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, chunk_id) - 1 AS rank, chunk_id, round(d2, 4) AS d2 FROM near WHERE d2 < 1.5 QUALIFY rank < 5"
SQL["embeddings_topk"] = f"WITH vec AS (SELECT vec_id AS chunk_id, embedding FROM embeddings), asked AS (SELECT vec_id AS query_id, embedding FROM embeddings), {_near(10)} SELECT query_id, rank, chunk_id, round(d2, 4) AS d2 FROM near"
SQL["rrf_fusion"] = f"WITH {_VECTORS}, {_BM25}, {_near(20)}, {_fused(_LISTS)} SELECT query_id, rank, chunk_id, round(rrf_score, 6) AS rrf_score FROM fused"
SQL["hybrid_search"] = f"{_hybrid(5)} SELECT h.query_id, h.rank, h.chunk_id, round_even(h.rrf_score, 4) AS rrf_score, round_even(coalesce(s.score, 0.0), 4) AS bm25_score FROM hits h LEFT JOIN score s USING (query_id, chunk_id)"
SQL["keyword_rerank"] = f"""{_hybrid(5)}, over AS (
  SELECT h.query_id, h.rank AS was, h.chunk_id, len(list_filter(list_distinct(regexp_extract_all(lower(a.query), '{_NOT_SPACE}+')), lambda w: contains(lower(coalesce(c.content, '')), w))) AS overlap
  FROM hits h JOIN chunks c USING (chunk_id) JOIN asked a ON a.query_id = h.query_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, was) - 1 AS rank, chunk_id, overlap FROM over QUALIFY rank < 3"""
SQL["eval_precision_mrr"] = f"{_hybrid(10)}, {_judged('hits')} SELECT query_id, round(p_at_1, 6) AS p_at_1, round(p_at_3, 6) AS p_at_3, round(p_at_5, 6) AS p_at_5, round(reciprocal_rank, 6) AS reciprocal_rank, results FROM judged"
SQL["eval_report"] = f"{_hybrid(10)}, {_judged('hits')} SELECT {_REPORT} FROM judged"
SQL["eval_ab"] = f"""WITH v AS (WITH {_VECTORS}, {_near(10)}, {_judged('near')} SELECT {_REPORT} FROM judged), h AS ({_hybrid(10)}, {_judged('hits')} SELECT {_REPORT} FROM judged)
SELECT 'vector_only' AS run, v.*, 0.0::DOUBLE AS mrr_delta FROM v UNION ALL SELECT 'hybrid', h.*, round_even(h.mrr - v.mrr, 4) FROM h, v"""

_LATEST = "latest AS (SELECT * FROM sessions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, project_id DESC NULLS LAST, owner_id DESC NULLS LAST, created_at DESC NULLS LAST) = 1)"
_ONCE = "once AS (SELECT * FROM messages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_ROLE = f"lower({_strip('coalesce(role, chr(39) || chr(39))')})".replace("chr(39) || chr(39)", "''")
_TURNS = f"""said AS (SELECT session_id, id, {_ROLE} AS role, content, created_at FROM once WHERE session_id IS NOT NULL AND created_at IS NOT NULL),
back AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back FROM said WHERE role IN ('user', 'assistant'))"""


def _turns(n: int) -> str:
    return f"{_ONCE}, {_TURNS}, turns AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS pos, id, role, content FROM back WHERE back <= {n})"


SQL["session_list"] = f"WITH {_LATEST} SELECT id, title, project_id, owner_id, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated FROM latest"
SQL["owner_filter"] = f"WITH {_LATEST} SELECT owner_id, count(*) AS sessions, count(DISTINCT project_id) AS projects FROM latest WHERE owner_id IS NOT NULL GROUP BY 1"
SQL["last_n_turns"] = f"WITH {_turns(20)} SELECT session_id, pos, id, role, md5(content) AS content FROM turns"
SQL["query_rewrite"] = f"""WITH {_turns(10)}, last AS (SELECT session_id, max_by(content, pos) AS query, max(pos) AS at FROM turns WHERE role = 'user' GROUP BY 1),
topic AS (SELECT t.session_id, max_by(t.content, ({_count_words('t.content')} > 3, t.pos)) AS topic FROM turns t JOIN last l USING (session_id) WHERE t.role = 'user' AND t.pos < l.at GROUP BY 1)
SELECT l.session_id, CASE WHEN {_count_words('l.query')} < 3 AND topic IS NOT NULL THEN topic || ' ' || {_strip('l.query')} ELSE {_strip('l.query')} END AS rewritten FROM last l LEFT JOIN topic USING (session_id)"""
SQL["auto_title"] = f"""WITH {_ONCE}, {_TURNS}, first AS (SELECT session_id, {_strip('min_by(content, (created_at, id))')} AS q FROM said WHERE role = 'user' GROUP BY 1)
SELECT session_id, CASE WHEN length(q) > 50 THEN regexp_replace(left(q, 50), ' [^ ]*\\z', '') || '...' ELSE q END AS title FROM first"""
SQL["delete_cascade"] = f"""WITH {_LATEST}, {_ONCE} SELECT {_ROLE} AS role, count(*) AS messages FROM once
WHERE session_id IS NULL OR session_id NOT IN (SELECT id FROM latest WHERE owner_id IS NULL) GROUP BY 1"""
SQL["project_set_null"] = f"WITH {_LATEST} SELECT l.id, CASE WHEN p.id IS NULL THEN l.project_id END AS project_id FROM latest l LEFT JOIN (SELECT id FROM projects WHERE coalesce(language, '') = '') p ON p.id = l.project_id"
SQL["session_touch"] = f"""WITH {_LATEST}, {_ONCE}, m AS (SELECT session_id, max(created_at) AS m FROM once WHERE session_id IS NOT NULL GROUP BY 1)
SELECT id, strftime(greatest(updated_at, m) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated FROM latest LEFT JOIN m ON m.session_id = id"""

_FILES = r"files AS (SELECT project_id, path, file_name, regexp_replace(content, '\r\n?', chr(10), 'g') AS content, doc_id FROM documents WHERE path IS NOT NULL AND content IS NOT NULL)"

SQL["file_listing"] = """WITH f AS (SELECT project_id, path, min_by(file_name, chunk_id) AS file_name, count(*) AS chunks FROM chunks GROUP BY ALL),
t AS (SELECT project_id, path, type, min(chunk_id) AS seen FROM chunks WHERE coalesce(type, '') <> '' GROUP BY ALL),
j AS (SELECT project_id, path, string_agg(type, ',' ORDER BY seen) AS types FROM t GROUP BY ALL)
SELECT f.project_id, f.path, f.file_name, f.chunks, coalesce(j.types, '') AS types FROM f LEFT JOIN j USING (project_id, path)"""
SQL["file_source"] = f"""WITH {_FILES} SELECT project_id, path, length(content) - length(replace(content, chr(10), '')) + 1 AS lines, md5(content) AS content
FROM files SEMI JOIN chunks USING (project_id, path)"""

_SCRIPT = rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s"
_C_LIKE = rf"(?:(?:public|private|protected|static|virtual|async)?\s*(?:class|struct|enum|interface|func|fn)\s|{_W}+[\s*&]+{_W}+\s*\()"
_OTHER = r"(?:def |class |function |const |export |module\.exports)"


def _infer(x: str) -> str:
    return (
        rf"coalesce(nullif(regexp_extract({x}, '(?:def|function|class|struct|enum|interface)\s+({_W}+)', 1), ''), "
        rf"nullif(regexp_extract({x}, '(?:const|let|var)\s+({_W}+)', 1), ''), left({x}, 40))"
    )


SQL["infer_name"] = f"SELECT chunk_id, {_infer(_strip('split_part(content, chr(10), 1)'))} AS name FROM chunks"
SQL["split_chunks"] = f"""WITH {_FILES},
src AS (SELECT doc_id, file_name, content, CASE WHEN regexp_matches(lower(file_name), '.\\.(js|ts|jsx|tsx)$') THEN '^{_SCRIPT}' WHEN regexp_matches(lower(file_name), '.\\.(java|cpp|c|h|go|rs)$') THEN '^{_C_LIKE}' ELSE '^{_OTHER}' END AS pat
        FROM files WHERE NOT ends_with(lower(file_name), '.py')),
lines AS (SELECT doc_id, pat, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS off FROM lines),
marked AS (SELECT *, (i > 1 AND regexp_matches(substr(content, (off + 1)::BIGINT), pat))::INT AS cut FROM placed),
parts AS (SELECT doc_id, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS part, i, line FROM marked),
joined AS (SELECT doc_id, part, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS content, min(i) AS start_line, max(i) AS end_line FROM parts GROUP BY ALL),
kept AS (SELECT * FROM joined WHERE length(content) > 50)
SELECT doc_id, 'chunk' AS type, {_infer(_strip("split_part(content, chr(10), 1)"))} AS name, start_line::INT AS start_line, end_line::INT AS end_line, md5(content) AS content FROM kept
UNION ALL SELECT doc_id, 'file', file_name, 1, (length(content) - length(replace(content, chr(10), '')) + 1)::INT, md5(content) FROM src WHERE length({_strip('content')}) > 50 AND doc_id NOT IN (SELECT doc_id FROM kept)"""


def _exploded(name: str, where: str, found: str) -> str:
    return f"WITH {_FILES}, {name} AS (SELECT doc_id, {found} AS found FROM files WHERE {where}) SELECT doc_id, (generate_subscripts(found, 1) - 1)::INT AS pos, unnest(found) AS module FROM {name}"


_IS_SCRIPT = r"regexp_matches(lower(file_name), '\.(js|ts|jsx|tsx)$')"
_SCRIPT_FOUND = (
    r"list_concat(regexp_extract_all(content, '(?:import\s+[^\n]*?\s+from\s+|import\s*\(|require\s*\()\s*[''\x22]([^''\x22]+)[''\x22]', 1), "
    r"regexp_extract_all(content, 'export\s+[^\n]*?\s+from\s+[''\x22]([^''\x22]+)[''\x22]', 1))"
)
SQL["import_regex_js"] = _exploded("s", _IS_SCRIPT, _SCRIPT_FOUND)
SQL["import_regex_go"] = _exploded("s", "ends_with(lower(file_name), '.go')", r"list_filter(regexp_extract_all(content, '\x22([^\x22]+)\x22', 1), lambda v: contains(v, '/') OR v IN ('fmt', 'os', 'io', 'net', 'log', 'sync', 'math', 'sort'))")
SQL["import_regex_python"] = _exploded("s", "ends_with(lower(file_name), '.py')", rf"regexp_extract_all(content, '(?m)^\s*(?:from|import)\s+([\p{{L}}\p{{N}}_.]+)', 1)")

_STEM = r"regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\.[^.]+$', '\1')"
# The steps `.` and `..` are taken out of a path by rewriting from the left until nothing is left to rewrite; paths here climb two folders at most.
_FOLDER = "regexp_extract(src, '^(.*)/[^/]*$', 1)"


def _normal(x: str) -> str:
    x = rf"regexp_replace('/' || {x} || '/', '/(\./)+', '/', 'g')"
    for _ in range(4):
        x = rf"regexp_replace({x}, '/[^/]+/\.\./', '/')"
    x = rf"regexp_replace({x}, '^(/\.\.)+/', '/')"
    return f"trim({x}, '/')"


_RESOLVED = rf"""
script_asked AS (SELECT DISTINCT project_id, path AS src, module FROM (SELECT project_id, path, unnest({_SCRIPT_FOUND}) AS module FROM files WHERE {_IS_SCRIPT})),
based AS (SELECT *, CASE WHEN starts_with(module, '.') AND {_FOLDER} <> '' THEN {_normal(_FOLDER + " || '/' || module")} ELSE module END AS base FROM script_asked),
tries AS (SELECT project_id, src, module, t, base || e AS cand FROM based, (VALUES (0, ''), (1, '.js'), (2, '.ts'), (3, '.jsx'), (4, '.tsx'), (5, '/index.js'), (6, '/index.ts')) s(t, e)),
resolved AS (SELECT t.project_id, t.src, t.module, min_by(f.path, (t.t, f.doc_id)) AS dst FROM tries t JOIN files f ON f.project_id IS NOT DISTINCT FROM t.project_id AND f.project_id IS NOT NULL
             AND (ends_with(f.path, t.cand) OR {_STEM.format('f.path')} = {_STEM.format('t.cand')}) GROUP BY ALL)"""
SQL["resolve_imports"] = f"WITH {_FILES}, {_RESOLVED} SELECT project_id, src, module, dst FROM resolved"

# Python imports as SQL can see them: one statement a line, as in these tables; the parser's other cases are tested on fixtures.
_GRAPH = rf"""{_RESOLVED},
py_asked AS (SELECT DISTINCT project_id, src, module, regexp_extract(module, '([^.]*)$', 1) AS last FROM (
  SELECT project_id, path AS src, ltrim(unnest(regexp_extract_all(content, '(?m)^\s*(?:from|import)\s+([\p{{L}}\p{{N}}_.]+)', 1)), '.') AS module FROM files WHERE ends_with(lower(file_name), '.py')) WHERE module <> ''),
py_tries AS (SELECT project_id, src, module, last, 0 AS t, replace(module, '.', '/') || '.py' AS cand FROM py_asked UNION ALL SELECT project_id, src, module, last, 1, replace(module, '.', '/') || '/__init__.py' FROM py_asked
             UNION ALL SELECT project_id, src, module, last, 2, last || '.py' FROM py_asked),
py_resolved AS (SELECT t.project_id, t.src, t.module, min_by(f.path, (t.t, f.doc_id)) AS dst FROM py_tries t JOIN files f ON f.project_id = t.project_id AND (ends_with(f.path, t.cand) OR {_STEM.format('f.path')} = t.last) GROUP BY ALL),
edges AS (SELECT DISTINCT project_id, src, dst FROM (SELECT project_id, src, dst FROM resolved UNION ALL SELECT project_id, src, dst FROM py_resolved) WHERE src <> dst)"""
SQL["graph_edges"] = f"WITH {_FILES}, {_GRAPH} SELECT project_id, src, dst FROM edges"
SQL["graph_totals"] = f"""WITH {_FILES}, {_GRAPH}, m AS (SELECT project_id, count(*) AS total_edges FROM edges GROUP BY 1)
SELECT f.project_id, count(DISTINCT f.path) AS total_files, coalesce(any_value(m.total_edges), 0) AS total_edges FROM files f LEFT JOIN m USING (project_id) GROUP BY 1"""
SQL["graph_context"] = f"""WITH {_FILES}, {_GRAPH}, near AS (SELECT project_id, src AS path, dst AS related FROM edges UNION SELECT project_id, dst, src FROM edges),
first AS (SELECT project_id, path, min(chunk_id) AS chunk_id FROM chunks GROUP BY ALL)
SELECT f.doc_id AS query_id, c.chunk_id, n.related AS path, row_number() OVER (PARTITION BY f.doc_id ORDER BY c.chunk_id) - 1 AS rank
FROM files f JOIN near n ON n.project_id = f.project_id AND n.path = f.path JOIN first c ON c.project_id = f.project_id AND c.path = n.related WHERE n.related <> f.path QUALIFY rank < 2"""

SQL["graph_export"] = rf"""WITH {_FILES}, {_GRAPH}, o AS (SELECT project_id, src AS path, string_agg(dst, ',' ORDER BY dst) AS dependencies FROM edges GROUP BY ALL), b AS (SELECT project_id, dst AS path, string_agg(src, ',' ORDER BY src) AS dependents FROM edges GROUP BY ALL)
SELECT f.project_id, f.path, regexp_extract(f.path, '([^/]*)$', 1) AS name, array_to_string(CASE WHEN {_IS_SCRIPT} THEN {_SCRIPT_FOUND}
  WHEN ends_with(lower(file_name), '.py') THEN regexp_extract_all(content, '(?m)^\s*(?:from|import)\s+([\p{{L}}\p{{N}}_.]+)', 1)
  WHEN ends_with(lower(file_name), '.go') THEN list_filter(regexp_extract_all(content, '\x22([^\x22]+)\x22', 1), lambda v: contains(v, '/') OR v IN ('fmt', 'os', 'io', 'net', 'log', 'sync', 'math', 'sort')) ELSE [] END, ',') AS imports,
  coalesce(o.dependencies, '') AS dependencies, coalesce(b.dependents, '') AS dependents FROM files f LEFT JOIN o USING (project_id, path) LEFT JOIN b USING (project_id, path)"""

_PARTS = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL), n AS (SELECT src AS path, dst AS related FROM e UNION SELECT dst, src FROM e)"
SQL["graph_neighbors"] = f"WITH {_PARTS} SELECT path, count(*) AS degree, min(related) AS first, max(related) AS last FROM n GROUP BY 1"
SQL["graph_bfs"] = f"""WITH {_PARTS}, s AS (SELECT 's' || s_suppkey AS path FROM supplier WHERE s_suppkey IS NOT NULL),
one AS (SELECT s.path, n.related FROM s JOIN n USING (path)),
two AS (SELECT DISTINCT o.path, n.related FROM one o JOIN n ON n.path = o.related WHERE n.related <> o.path AND NOT EXISTS (SELECT 1 FROM one x WHERE x.path = o.path AND x.related = n.related))
SELECT path, 1 AS steps, count(*) AS nodes FROM one GROUP BY 1 UNION ALL SELECT path, 2, count(*) FROM two GROUP BY 1"""

_BLOCK = """'--- FILE: ' || coalesce(c.file_name, '') || CASE WHEN coalesce(c.start_line, 0) <> 0 THEN ' (lines ' || c.start_line || '-' || coalesce(c.end_line::VARCHAR, '?') || ')' ELSE '' END
|| CASE WHEN coalesce(c.name, '') <> '' AND c.name <> c.file_name THEN ' | ' || coalesce(c.type, 'chunk') || ': ' || c.name ELSE '' END || ' ---' || chr(10) || left(coalesce(c.content, ''), 1000)"""
_CONTEXT = f"context AS (SELECT h.query_id, string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank) AS context FROM hits h JOIN chunks c USING (chunk_id) GROUP BY 1)"
SQL["build_context"] = f"{_hybrid(5)}, {_CONTEXT} SELECT query_id, length(context)::INT AS chars, md5(context) AS context FROM context"


def _messages_sql() -> str:
    from quarry.operators.prompt import SYSTEM

    system = SYSTEM.replace("'", "''")
    asked = "'Use ONLY the provided code context to answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(c.context, '') || chr(10) || chr(10) || 'Question: ' || a.query"
    return f"{_hybrid(5)}, {_CONTEXT} SELECT a.query_id, 2 AS turns, md5('{system}') AS system, md5({asked}) AS asked FROM asked a LEFT JOIN context c ON c.query_id = a.query_id"


SQL["build_messages"] = _messages_sql()
SQL["chat_messages"] = f"""WITH {_turns(10)}, h AS (SELECT session_id, role, content, pos, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS b FROM turns WHERE session_id IN (SELECT session_id FROM turns WHERE role = 'user')),
k AS (SELECT * FROM h WHERE b <= 6)
SELECT session_id, (count(*) + 2)::INT AS turns, 'system,' || string_agg(role, ',' ORDER BY pos) || ',user' AS roles, md5(min_by(content, pos)) AS first FROM k GROUP BY 1"""
SQL["sources_json"] = f"{_hybrid(5)} SELECT h.query_id, h.rank, c.file_name AS file, coalesce(c.start_line::VARCHAR, '?') || '-' || coalesce(c.end_line::VARCHAR, '?') AS lines, coalesce(c.name, c.file_name) AS name FROM hits h JOIN chunks c USING (chunk_id)"

SQL["retrieve_sources"] = f"""{_hybrid(5)}, {_FILES}, {_GRAPH}, near_files AS (SELECT project_id, src AS path, dst AS related FROM edges UNION SELECT project_id, dst, src FROM edges),
over AS (SELECT h.query_id, h.rank AS was, h.chunk_id, c.project_id, c.path, len(list_filter(list_distinct(regexp_extract_all(lower(a.query), '{_NOT_SPACE}+')), lambda w: contains(lower(coalesce(c.content, '')), w))) AS overlap
  FROM hits h JOIN chunks c USING (chunk_id) JOIN asked a ON a.query_id = h.query_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, was) - 1 AS rank FROM over QUALIFY rank < 3),
first AS (SELECT project_id, path, min(chunk_id) AS chunk_id FROM chunks GROUP BY ALL),
extra AS (SELECT DISTINCT b.query_id, f.chunk_id FROM best b JOIN near_files n ON n.project_id = b.project_id AND n.path = b.path JOIN first f ON f.project_id = n.project_id AND f.path = n.related
  WHERE NOT EXISTS (SELECT 1 FROM best x WHERE x.query_id = b.query_id AND x.project_id = n.project_id AND x.path = n.related))
SELECT query_id, rank, chunk_id, false AS is_graph FROM best UNION ALL
SELECT query_id, 999 + row_number() OVER (PARTITION BY query_id ORDER BY chunk_id), chunk_id, true FROM extra QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 2"""

_LOG = "log AS (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6 AS t FROM events WHERE {0} IS NOT NULL AND ts IS NOT NULL)"
SQL["rate_limit"] = f"""WITH RECURSIVE {_LOG.format('user_id')}, run AS (
  SELECT user_id, event_id, i, [t] AS q, true AS allowed FROM log WHERE i = 1
  UNION ALL
  SELECT l.user_id, l.event_id, l.i, CASE WHEN len(list_filter(r.q, lambda v: v > l.t - 86400.0)) < 2 THEN list_append(list_filter(r.q, lambda v: v > l.t - 86400.0), l.t) ELSE list_filter(r.q, lambda v: v > l.t - 86400.0) END,
         len(list_filter(r.q, lambda v: v > l.t - 86400.0)) < 2
  FROM run r JOIN log l ON l.user_id = r.user_id AND l.i = r.i + 1)
SELECT user_id, event_id, allowed FROM run"""
_LRU = f"""{_LOG.format('event_type')}, prev AS (SELECT *, lag(i) OVER (PARTITION BY event_type, user_id ORDER BY i) AS p FROM log),
lru AS (SELECT a.event_type, a.event_id, a.p IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM prev b WHERE b.event_type = a.event_type AND b.i > a.p AND b.i < a.i) < 64 AS hit FROM prev a)"""
SQL["lru_hits"] = f"WITH {_LRU} SELECT event_type, event_id, hit FROM lru"
SQL["cache_stats"] = f"WITH {_LRU} SELECT event_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round_even(count(*) FILTER (hit) / count(*)::DOUBLE, 4) AS hit_rate FROM lru GROUP BY 1"
SQL["ttl_hits"] = f"""WITH RECURSIVE {_LOG.format('event_type')}, k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY i) AS j FROM log), run AS (
  SELECT event_type, user_id, event_id, j, t AS put, false AS hit FROM k WHERE j = 1
  UNION ALL SELECT k.event_type, k.user_id, k.event_id, k.j, CASE WHEN k.t - r.put < 172800.0 THEN r.put ELSE k.t END, k.t - r.put < 172800.0
  FROM run r JOIN k ON k.event_type = r.event_type AND k.user_id = r.user_id AND k.j = r.j + 1)
SELECT event_type, event_id, hit FROM run"""
SQL["index_stats"] = """WITH c AS (SELECT project_id, count(DISTINCT path) AS files, count(*) AS chunks FROM chunks GROUP BY 1), v AS (SELECT project_id, count(DISTINCT chunk_id) AS vectors FROM chunk_vectors GROUP BY 1)
SELECT c.project_id, files, chunks, coalesce(vectors, 0) AS vectors FROM c LEFT JOIN v USING (project_id)"""
SQL["eval_json"] = f"""WITH v AS (WITH {_VECTORS}, {_near(10)}, {_judged('near')} SELECT 'vector_only' AS run, {_REPORT} FROM judged), h AS ({_hybrid(10)}, {_judged('hits')} SELECT 'hybrid' AS run, {_REPORT} FROM judged),
r AS (SELECT * FROM v UNION ALL SELECT * FROM h)
SELECT run, printf('{{"queries":%d,"p_at_1":%s,"p_at_3":%s,"p_at_5":%s,"mrr":%s}}', queries, p_at_1::VARCHAR, p_at_3::VARCHAR, p_at_5::VARCHAR, mrr::VARCHAR) AS json FROM r"""
SQL["cache_key_sha"] = "SELECT DISTINCT title, project_id, substr(sha256(coalesce(nullif(project_id, ''), 'default') || ':' || title), 1, 16) AS key FROM sessions WHERE title IS NOT NULL"
SQL["embed_chunks"] = rf"""WITH t AS (SELECT DISTINCT content FROM chunks WHERE content IS NOT NULL),
h AS (SELECT content, ('0x' || left(md5(tok), 8))::BIGINT AS h FROM (SELECT content, unnest(regexp_extract_all(lower(content), '{_W}+')) AS tok FROM t)),
v AS (SELECT content, (h >> 1) % 384 AS place, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL HAVING x <> 0),
e AS (SELECT t.content, CASE WHEN count(v.place) = 0 THEN 1 ELSE count(*) FILTER (x > 0) END AS above, count(*) FILTER (x < 0) AS below, coalesce(sum(CASE WHEN x > 0 THEN place ELSE -place END), 0) AS places FROM t LEFT JOIN v USING (content) GROUP BY 1)
SELECT chunk_id, CASE WHEN content IS NOT NULL THEN 384 END::INT AS dim, CASE WHEN content IS NOT NULL THEN 1.0::DOUBLE END AS norm, above::INT AS above, below::INT AS below, places::INT AS places FROM chunks LEFT JOIN e USING (content)"""
SQL["cache_invalidation"] = f"""WITH {_LOG.format('user_id')}, era AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY i) AS era FROM log),
seen AS (SELECT *, row_number() OVER (PARTITION BY user_id, era, event_type ORDER BY i) > 1 AS hit FROM era WHERE event_type <> 'signup')
SELECT event_type, count(*) FILTER (hit) AS hits, count(*) AS accesses FROM seen GROUP BY 1"""

SQL["eval_retrieved"] = f"""{_hybrid(10)} SELECT a.query_id, coalesce(string_agg(coalesce(c.file_name, ''), '|' ORDER BY h.rank) FILTER (h.rank < 5), '') AS retrieved_files,
coalesce(string_agg(coalesce(c.name, ''), '|' ORDER BY h.rank) FILTER (h.rank < 5), '') AS retrieved_names FROM asked a LEFT JOIN hits h USING (query_id) LEFT JOIN chunks c USING (chunk_id) GROUP BY 1"""
SQL["resolve_python"] = f"WITH {_FILES}, {_GRAPH} SELECT project_id, src, module, dst FROM py_resolved"
SQL["request_checks"] = """SELECT 'query' AS what, coalesce(length(content) BETWEEN 1 AND 2000, false) AS valid, count(*) AS rows FROM messages GROUP BY ALL
UNION ALL SELECT 'client', coalesce(regexp_full_match(owner_id, '[A-Za-z0-9-]{16,64}'), false), count(*) FROM sessions GROUP BY ALL"""
SQL["retrieve_history"] = f"""WITH {_turns(10)}, numbers AS (SELECT session_id, row_number() OVER (ORDER BY session_id) - 1 AS number FROM (SELECT DISTINCT session_id FROM turns)),
topic AS (SELECT n.number AS query_id, max_by(t.content, ({_count_words('t.content')} > 3, t.pos)) AS topic FROM turns t JOIN numbers n USING (session_id) WHERE t.role = 'user' GROUP BY 1), {_VEC},
given AS (SELECT chunk_id AS n, min(embedding) AS embedding FROM vec GROUP BY 1),
short AS (SELECT item_id AS query_id, string_split(query, ' ')[-1] AS original FROM eval_items),
new AS (SELECT query_id, original, CASE WHEN {_count_words('original')} < 3 AND topic IS NOT NULL THEN topic || ' ' || {_strip('original')} ELSE {_strip('original')} END AS query FROM short LEFT JOIN topic USING (query_id)),
asked AS (SELECT query_id, query, original, embedding FROM new LEFT JOIN given ON n = length(query)), {_BM25}, {_near(20)}, {_fused(_CUT_LISTS)}, hits AS (SELECT query_id, rank, chunk_id FROM fused WHERE rank < 5),
over AS (SELECT h.query_id, h.rank AS was, h.chunk_id, len(list_filter(list_distinct(regexp_extract_all(lower(a.original), '{_NOT_SPACE}+')), lambda w: contains(lower(coalesce(c.content, '')), w))) AS overlap
  FROM hits h JOIN chunks c USING (chunk_id) JOIN asked a ON a.query_id = h.query_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, was) - 1 AS rank, chunk_id FROM over QUALIFY rank < 3"""
# As for the graph: in these tables an import is one statement a line, so the lines show what the parser finds.
SQL["py_imports"] = rf"""WITH {_FILES}, s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(content, '(?m)^\s*(?:from|import)\s+([\p{{L}}\p{{N}}_.]+)', 1), lambda m: ltrim(m, '.')), lambda m: m <> '') AS found FROM files WHERE ends_with(lower(file_name), '.py'))
SELECT doc_id, (generate_subscripts(found, 1) - 1)::INT AS pos, unnest(found) AS module FROM s"""

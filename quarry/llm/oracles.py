"""SQL for the pN_ queries that SQL can express; the others are tested against brute force in tests/llm."""

SQL: dict[str, str] = {}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

SQL["p1_found"] = """WITH v AS (
  SELECT DISTINCT chunk_id, embedding FROM chunk_vectors WHERE chunk_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.9"""

_TOLD = rf"""m AS (SELECT * REPLACE (lower(regexp_replace(regexp_replace(coalesce(role, ''), '^{_SPACE}+', ''), '{_SPACE}+\z', '')) AS role) FROM messages
  WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1),
rows AS (SELECT *, regexp_matches(coalesce(content, ''), '[\p{{L}}\p{{Nd}}]') AS says FROM m WHERE session_id IS NOT NULL),
said AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, lead(says) OVER w AS after_says FROM rows WHERE role <> 'system' WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
own AS (SELECT session_id, bool_or(says AND role <> 'system') AS says, bool_or(created_at IS NULL OR (role <> 'system' AND role NOT IN ('user', 'assistant'))) AS odd FROM rows GROUP BY 1),
flow AS (SELECT session_id, bool_or(role = 'assistant' AND coalesce(before, 'assistant') = 'assistant') AS disorder, bool_or(role = 'user' AND NOT coalesce(after = 'assistant' AND after_says, false)) AS unanswered FROM said GROUP BY 1),
ids AS (SELECT id AS session_id FROM sessions WHERE id IS NOT NULL UNION SELECT session_id FROM messages WHERE session_id IS NOT NULL),
reasons AS (SELECT i.session_id, CASE WHEN NOT coalesce(o.says, false) THEN 'empty'
  WHEN i.session_id NOT IN (SELECT id FROM sessions WHERE id IS NOT NULL) OR o.odd OR f.disorder THEN 'broken' WHEN f.unanswered THEN 'missing_reply' END AS reason
  FROM ids i LEFT JOIN own o USING (session_id) LEFT JOIN flow f USING (session_id))"""
SQL["p6_found"] = f"WITH {_TOLD} SELECT session_id, reason FROM reasons WHERE reason IS NOT NULL"
SQL["p6_conversations"] = f"""WITH {_TOLD} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS turn, id, role, created_at AT TIME ZONE 'UTC' AS created_at, content
FROM rows WHERE role <> 'system' AND session_id IN (SELECT session_id FROM reasons WHERE reason IS NULL)"""

SQL["p7_found"] = """SELECT chunk_id, CASE WHEN list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) <= 1600 THEN 'lines' ELSE 'inside' END AS cut
FROM chunks WHERE chunk_id IS NOT NULL AND length(content) > 1600"""

SQL["p8_found"] = rf"SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')) > 2048"
_TOKENS = SQL["p8_found"].partition(" AND ")[2].partition(" > 2048")[0]
SQL["p8_documents"] = f"SELECT doc_id, greatest(1, (tokens + 2047) // 2048) AS parts, tokens, true AS holds FROM (SELECT doc_id, coalesce({_TOKENS}, 0) AS tokens FROM documents WHERE doc_id IS NOT NULL)"
SQL["p7_whole"] = "SELECT chunk_id, md5(content) AS content, true AS bounded FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL"

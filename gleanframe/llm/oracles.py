"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


ODD_SKETCH = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS w
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), sized AS (
    SELECT doc_id, len(s)::BIGINT AS n_shingles, s FROM sets
), flat AS (
    SELECT doc_id, n_shingles, unnest(s) AS x FROM sized
), shared AS (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common, any_value(p.n_shingles) AS n, any_value(q.n_shingles) AS m
    FROM flat p JOIN flat q ON p.x = q.x AND p.doc_id <> q.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM shared WHERE 100 * common >= 85 * (n + m - common)
), reach(seen, least_id) AS (
    SELECT doc_id, doc_id FROM sized
    UNION
    SELECT l.b, r.least_id FROM reach r JOIN links l ON l.a = r.seen
), least_ids AS (
    SELECT seen AS doc_id, min(least_id) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept
FROM sized JOIN least_ids USING (doc_id)
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), steps AS (
    SELECT *, lag(role, 1, 'start') OVER w AS before, last_value(role) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
        replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), ']: ', ']\: '), '##', '#\#') AS half
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), marked AS (
    SELECT *, replace(half, '##', '#\#') AS safe,
        CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### [' || role || ']: ' END AS mark
    FROM steps
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(mark) + length(safe) + length(' </turn>') + 1)::BIGINT AS formatted_chars,
    bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
        AND any_value(final) = 'assistant' AS valid
FROM marked GROUP BY conv_id
"""

FLAT_GRAPH = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(seen, least_id) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT l.b, r.least_id FROM reach r JOIN links l ON l.a = r.seen
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT seen, min(least_id) AS component_id FROM reach GROUP BY 1) c ON c.seen = v.vec_id
"""

SQL = {"op9_flat_graph_dedup": FLAT_GRAPH, "op1_chat_segments": CHAT, "op10_odd_sketch_dedup": ODD_SKETCH}

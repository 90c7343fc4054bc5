"""DuckDB SQL for the registered queries. It reads the tables only, never rendered pages."""

from __future__ import annotations

ORDERS = """
    SELECT o.*, c_name, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
           o_orderdate + to_minutes(o_orderkey % 1440) AS published
    FROM orders o JOIN customer ON c_custkey = o_custkey
"""

# What happened in the run of each user, as in checks.queries._event_outcomes.
OUTCOMES = """
    SELECT 'user ' || user_id AS source, user_id || '/' || CAST(ts AS DATE) AS day_source,
           event_id, ts, props,
           CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'inserted'
               WHEN 'signup' THEN 'updated' WHEN 'purchase' THEN 'attachment' ELSE 'error' END AS step,
           CASE WHEN event_type = 'error' THEN
               CASE WHEN value > 60 THEN 'discover' WHEN value > 10 THEN 'detail' ELSE 'database' END END AS stage
    FROM events
"""

SUMMARY = f"""
    WITH o AS ({OUTCOMES}),
    c AS (
        SELECT source, count(*) FILTER (step = 'discovered') AS discovered,
            count(*) FILTER (step IN ('inserted', 'updated')) AS processed,
            count(*) FILTER (step = 'inserted') AS inserted,
            count(*) FILTER (step = 'updated') AS updated,
            count(*) FILTER (step = 'attachment') AS attachments_downloaded,
            count(*) FILTER (step = 'error') AS errors,
            CASE WHEN bool_or(coalesce(stage = 'discover', false)) THEN 0 ELSE 1 END AS keep
        FROM o GROUP BY source
    )
    SELECT source, CAST(discovered * keep AS BIGINT) AS discovered, CAST(processed * keep AS BIGINT) AS processed,
        CAST(inserted * keep AS BIGINT) AS inserted, CAST(updated * keep AS BIGINT) AS updated,
        CAST(attachments_downloaded * keep AS BIGINT) AS attachments_downloaded,
        CAST(errors AS BIGINT) AS errors, errors = 0 AS ok
    FROM c
"""

MERGED = """
    WITH stored AS (
        SELECT 'customers' AS source, CAST(c_custkey AS VARCHAR) AS external_id, 'purchase' AS kind,
            CAST(c_custkey AS VARCHAR) AS number, c_name AS title, c_mktsegment AS description,
            CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS published_at,
            CAST(c_acctbal AS DECIMAL(18,2)) AS price, '/c/' || c_custkey AS url,
            TIMESTAMP '2025-01-01' AS first_seen_at
        FROM customer
        UNION ALL
        SELECT 'documents', CAST(doc_id AS VARCHAR), 'product', NULL, 'labelled', NULL, CAST(quality AS VARCHAR),
            NULL, NULL, '/d/' || doc_id, TIMESTAMP '2025-02-02'
        FROM labels
    ),
    sent AS (
        SELECT 'customers' AS source, CAST(o_custkey AS VARCHAR) AS external_id, 'purchase' AS kind,
            CAST(o_orderkey AS VARCHAR) AS number, o_orderpriority AS title,
            nullif(o_orderstatus, 'P') AS description, o_orderdate AS published_at,
            CAST(o_totalprice AS DECIMAL(18,2)) AS price, '/o/' || o_orderkey AS url, o_orderkey AS pos
        FROM orders
        UNION ALL
        SELECT 'documents', CAST(doc_id AS VARCHAR), 'product', NULL, lang, source, NULL,
            CAST(n_chars AS DECIMAL(18,2)), '/d/' || doc_id, doc_id
        FROM documents
    ),
    new AS (
        SELECT *, count(*) OVER (PARTITION BY source, external_id) AS batch_rows
        FROM sent QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY pos DESC) = 1
    ),
    merged AS (
        SELECT coalesce(n.source, s.source) AS source, coalesce(n.external_id, s.external_id) AS external_id,
            CASE WHEN n.source IS NULL THEN s.kind ELSE n.kind END AS kind,
            CASE WHEN n.source IS NULL THEN s.number ELSE n.number END AS number,
            CASE WHEN n.source IS NULL THEN s.title ELSE n.title END AS title,
            CASE WHEN n.source IS NULL THEN s.description ELSE n.description END AS description,
            CASE WHEN n.source IS NULL THEN s.status END AS status,
            CASE WHEN n.source IS NULL THEN s.published_at ELSE n.published_at END AS published_at,
            CASE WHEN n.source IS NULL THEN s.price ELSE n.price END AS price,
            CASE WHEN n.source IS NULL THEN s.url ELSE n.url END AS url,
            coalesce(s.first_seen_at, TIMESTAMP '2026-03-01 12:00:00') AS first_seen_at,
            CASE WHEN n.source IS NULL THEN s.first_seen_at ELSE TIMESTAMP '2026-03-01 12:00:00' END AS updated_at,
            CASE WHEN n.source IS NULL THEN NULL WHEN s.source IS NULL THEN 'inserted' ELSE 'updated' END AS change,
            coalesce(n.batch_rows, 0) AS batch_rows
        FROM stored s FULL OUTER JOIN new n ON s.source = n.source AND s.external_id = n.external_id
    )
"""

MERGED_FILES = """
    WITH new AS (
        SELECT d.doc_id, lang <> 'en' AS good1, l.doc_id IS NOT NULL AS twice, coalesce(toxic = 0, false) AS good2,
            lang, n_chars, quality
        FROM documents d LEFT JOIN labels l USING (doc_id)
    ),
    merged AS (
        SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS external_id, '/f/' || doc_id AS source_url,
            CASE WHEN twice THEN 'lab-' ELSE 'doc-' END || doc_id || '.txt' AS filename,
            CASE WHEN twice THEN NULL ELSE lang END AS content_type,
            CAST(CASE WHEN good2 THEN doc_id * 2 WHEN good1 THEN n_chars WHEN twice THEN quality END AS BIGINT) AS size,
            CASE WHEN good2 THEN 'second' WHEN good1 THEN 'first' WHEN twice THEN 'old' END AS sha256,
            CASE WHEN good2 THEN 'files/second.txt' WHEN good1 THEN 'files/first.txt'
                WHEN twice THEN 'files/old.txt' END AS local_path,
            CASE WHEN twice THEN CASE WHEN good2 THEN 'downloaded' ELSE 'failed' END
                WHEN good1 THEN 'downloaded' ELSE 'failed' END AS status,
            CASE WHEN twice THEN CASE WHEN good2 THEN NULL ELSE 'gone' END
                WHEN good1 THEN NULL ELSE left(repeat('no answer ', 300), 2000) END AS error,
            CASE WHEN good1 OR good2 THEN TIMESTAMP '2026-03-01 12:00:00'
                WHEN twice THEN TIMESTAMP '2025-01-01' END AS downloaded_at
        FROM new
    )
"""

FETCHES = """
    WITH log AS (
        SELECT 'https://H' || user_id || '.example/' || CAST(ts AS DATE) AS url,
            CASE WHEN value > 20 THEN 'browser' ELSE 'http' END AS transport, ts AS requested_at,
            CASE event_type WHEN 'view' THEN 'ok' WHEN 'signup' THEN 'blocked' ELSE 'transient' END AS class
        FROM events
    ),
    tried AS (
        SELECT *, row_number() OVER (PARTITION BY transport, url ORDER BY requested_at) AS attempt_no FROM log
    ),
    final AS (
        SELECT transport, url, min(attempt_no) FILTER (class <> 'transient') AS final_at,
            count(*) AS tries, count(*) FILTER (attempt_no > 3) AS over_budget
        FROM tried GROUP BY transport, url
    ),
    outcomes AS (
        SELECT f.transport, f.url,
            coalesce(t.class, CASE WHEN tries >= 3 THEN 'exhausted' ELSE 'pending' END) AS outcome,
            coalesce(final_at, tries) AS attempts, over_budget
        FROM final f LEFT JOIN tried t
            ON t.transport = f.transport AND t.url = f.url AND t.attempt_no = f.final_at
    )
"""

_PAGE_TEXT = """
    trim(regexp_replace(
        replace(replace(replace(replace(
            regexp_replace(
                regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'),
                '<[^>]*>', ' ', 'g'),
            '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
        '\\s+', ' ', 'g'))
"""


def _unescaped(x: str) -> str:
    return f"replace(replace({x}, '&quot;', '\"'), '&amp;', '&')"


def oracle_sql() -> dict[str, str]:
    money = "CAST(o_totalprice AS DECIMAL(18,2))"
    minute = "o_orderdate + to_minutes(o_orderkey % 1440)"
    size_text = "CASE p_size % 3 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' ELSE 'on_order' END"
    found = {
        "money_texts": f"""
            SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN -{money} ELSE {money} END AS amount FROM orders""",
        "date_texts": f"""
            SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN {minute} END AS "at" FROM orders""",
        "flat_labels": f"""
            SELECT o_orderkey, c_name || '; Состояние: ' || o_orderstatus AS customer, o_orderstatus AS status,
                o_orderpriority || ' Размещено ' || o_orderkey AS price,
                CAST(o_orderkey AS VARCHAR) AS published, CAST(NULL AS VARCHAR) AS deadline
            FROM ({ORDERS})""",
        "clean_documents": """
            SELECT doc_id, md5(trim(regexp_replace(text, '[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS text_md5
            FROM documents""",
        "cursor_urls": """
            SELECT page_id, regexp_extract(url, '^[^?#]*') || '?' ||
                CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '\\?([^#]*)', 1) || '&' ELSE '' END ||
                'publishDateFrom=29.02.2024&publishDateTo=' || regexp_extract(url, '#.*$') AS list_url
            FROM pages""",
        "page_facts": f"""
            SELECT page_id,
                trim({_unescaped("regexp_extract(html, '<title>([^<]*)', 1)")}) AS title,
                trim({_unescaped("regexp_extract(html, '<h1>([^<]*)', 1)")}) AS heading,
                md5({_PAGE_TEXT}) AS text_md5,
                CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links
            FROM pages""",
        "page_links": f"""
            WITH l AS (
                SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)', 1)) AS href,
                    unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1)) AS label,
                    unnest(range(len(regexp_extract_all(html, '<a href=')))) AS pos
                FROM pages
            )
            SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(url, '^https?://[^/]*') || href AS link,
                trim({_unescaped("label")}) AS text, substr(href, 2) AS link_id,
                trim(regexp_replace(substr(href, 2), '[^\\pL\\pN_.-]+', '-', 'g'), '.- ') AS file_name,
                regexp_extract(url, '^https?://([^/?#]*)', 1) AS host
            FROM l""",
        "purchase_extract": f"""
            SELECT 'notices' AS source, 'purchase' AS kind, CAST(o_orderkey AS VARCHAR) AS external_id,
                CAST(o_orderkey AS VARCHAR) AS number, 'Закупка ' || o_orderkey AS title,
                o_orderpriority AS description, c_name AS customer_name, o_orderstatus AS status,
                published AS published_at, published + INTERVAL 7 DAY AS deadline_at, amount AS price,
                'RUB' AS currency, 'https://n.example/epz/order/notice/' || o_orderkey || '?print=1' AS url,
                '{{"source":"notices","number":"' || o_orderkey || '","title":"Закупка ' || o_orderkey ||
                    '","customer":"' || c_name || '","status":"' || o_orderstatus || '"}}' AS raw_payload,
                CAST(2 AS INTEGER) AS attachment_count
            FROM ({ORDERS})""",
        "product_extract": f"""
            SELECT 'shop' AS source, 'product' AS kind, 'P-' || p_partkey AS external_id, p_name AS title,
                p_type AS description, 'shop' AS customer_name, {size_text} AS status,
                CAST(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS TIMESTAMP) AS published_at,
                CAST(p_retailprice AS DECIMAL(18,2)) AS price, 'RUB' AS currency,
                'https://s.example/products/item-' || p_partkey || '/' AS url,
                'https://s.example/img/' || p_partkey || '.jpg https://s.example/manual/' || p_partkey || '.pdf' AS files
            FROM part""",
        "attachment_plan": """
            WITH f AS (
                SELECT o_orderkey, unnest([0, 1]) AS item FROM orders
            ),
            u AS (
                SELECT o_orderkey, item, CASE item
                    WHEN 0 THEN 'https://n.example/docs/%D0%A2%D0%97%20' || o_orderkey || '.PDF'
                    ELSE 'https://n.example/files?id=' || o_orderkey END AS source_url
                FROM f
            )
            SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CAST(item AS INTEGER) AS item, source_url,
                CASE item WHEN 0 THEN 'ТЗ ' || o_orderkey || '.PDF' ELSE 'files' END AS page_filename,
                CASE item WHEN 0 THEN 'application/pdf' END AS page_type,
                CASE item WHEN 0 THEN 'ТЗ-' || o_orderkey || '.PDF' ELSE 'files' END AS filename,
                'data/files/notices/' || o_orderkey || '/' || left(sha1(source_url), 12) || '-' ||
                    CASE item WHEN 0 THEN 'ТЗ-' || o_orderkey || '.PDF' ELSE 'files' END AS local_path
            FROM u""",
        "purchase_refs": f"""
            SELECT CAST(o_custkey AS VARCHAR) AS external_id, CAST(o_orderkey // 50 AS INTEGER) AS page_no,
                'https://n.example/epz/order/notice/' || o_orderkey || '?print=1' AS url,
                published AS published_at, o_orderpriority AS title_hint
            FROM ({ORDERS}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
        "product_refs": """
            SELECT CASE WHEN p_partkey < 50 THEN 'https://s.example/katalog/'
                    ELSE 'https://s.example/katalog/?page=' || p_partkey // 50 END AS page_url,
                CAST(p_partkey % 50 AS INTEGER) AS pos, 'item-' || p_partkey AS external_id,
                'https://s.example/products/item-' || p_partkey || '/' AS url,
                CAST(NULL AS TIMESTAMP) AS published_at, p_name AS title_hint
            FROM part""",
        "page_chains": """
            WITH RECURSIVE page AS (
                SELECT DISTINCT o_orderkey // 50 AS page FROM orders
            ),
            edge AS (
                SELECT page // 25 AS s, page % 25 AS p, CASE WHEN page % 25 = 24 THEN 10 ELSE page % 25 + 1 END AS n
                FROM page
            ),
            walk AS (
                SELECT s, p, 0 AS depth FROM edge WHERE p = 0
                UNION ALL
                SELECT w.s, e.n, depth + 1 FROM walk w JOIN edge e ON e.s = w.s AND e.p = w.p WHERE depth < 99
            )
            SELECT CAST(s AS VARCHAR) AS source, 'https://n.example/list/' || s || '?page=' || p AS page_url,
                CAST(min(depth) AS INTEGER) AS page_no
            FROM walk GROUP BY s, p""",
        "incremental_refs": """
            WITH r AS (
                SELECT o_custkey, 30000 - (year(o_orderdate) * 12 + month(o_orderdate)) AS page_no,
                    row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate)
                        ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos,
                    o_orderpriority || o_orderstatus AS id, '/o/' || o_orderkey AS url, o_orderdate,
                    DATE '1996-01-01' + c_nationkey * 60 AS since
                FROM orders JOIN customer ON c_custkey = o_custkey
            ),
            d AS (
                SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey, page_no, id ORDER BY pos) = 1
            ),
            old AS (
                SELECT o_custkey, page_no FROM d GROUP BY o_custkey, page_no
                HAVING bool_and(o_orderdate < since)
            ),
            stop AS (SELECT o_custkey, min(page_no) AS stop_no FROM old GROUP BY o_custkey),
            kept AS (
                SELECT d.* FROM d LEFT JOIN stop USING (o_custkey)
                WHERE (stop_no IS NULL OR page_no <= stop_no) AND o_orderdate >= since
            ),
            first AS (
                SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY o_custkey, id ORDER BY page_no, pos) = 1
            )
            SELECT 'c' || o_custkey AS source, CAST(page_no AS INTEGER) AS page_no, CAST(pos AS INTEGER) AS pos,
                id AS external_id, url, o_orderdate AS published_at
            FROM first QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY page_no, pos) <= 3""",
        "listing_upsert": f"""{MERGED}
            SELECT source, external_id, kind, number, title, description, status, published_at, price, url,
                first_seen_at, updated_at, change, CAST(batch_rows AS BIGINT) AS batch_rows
            FROM merged""",
        "upsert_counts": f"""{MERGED}
            SELECT source, CAST(count(*) FILTER (change = 'inserted') AS BIGINT) AS inserted,
                CAST(sum(batch_rows) - count(*) FILTER (change = 'inserted') AS BIGINT) AS updated
            FROM merged WHERE change IS NOT NULL GROUP BY source""",
        "counts_by_kind": f"""{MERGED}
            SELECT source, kind, count(*) AS listings FROM merged GROUP BY source, kind""",
        "newest_listings": f"""{MERGED}
            SELECT source, kind, external_id, title, price, CAST(NULL AS VARCHAR) AS currency, published_at, url,
                first_seen_at
            FROM merged ORDER BY first_seen_at DESC, source, external_id LIMIT 20""",
        "newest_payload": f"""{MERGED}
            SELECT source, external_id, '{{' || chr(10) || '  "doc_id" : ' || external_id || ',' || chr(10) ||
                '  "text" : {{' || chr(10) || '    "lang" : "' || title || '"' || chr(10) || '  }}' || chr(10) || '}}' AS payload
            FROM merged ORDER BY first_seen_at DESC, source, external_id LIMIT 1""",
        "attachment_merge": f"{MERGED_FILES} SELECT * FROM merged",
        "newest_attachments": f"""{MERGED_FILES}
            SELECT source, external_id, source_url, filename, status, size, sha256, local_path, error
            FROM merged ORDER BY downloaded_at DESC NULLS LAST, source, external_id, source_url LIMIT 20""",
        "attachment_count": "SELECT count(*) AS attachments FROM documents JOIN labels USING (doc_id)",
        "digest_audit": """
            WITH d AS (
                SELECT d.doc_id, lang, n_chars, octet_length(encode(text)) AS bytes, sha256(text) AS digest,
                    l.doc_id IS NOT NULL AS kept, quality, '/f/' || d.doc_id || '.txt' AS source_url
                FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
            ),
            e AS (
                SELECT *, CASE WHEN kept THEN NULL
                    WHEN n_chars > 20000 THEN 'declared size over the limit'
                    WHEN bytes > 20000 THEN 'size over the limit'
                    WHEN bytes <> n_chars THEN 'size differs from the reported one: ' || source_url END AS error
                FROM d
            )
            SELECT 'docs.example' AS source, CAST(doc_id AS VARCHAR) AS external_id, source_url,
                CASE WHEN error IS NULL THEN 'doc-' ELSE 'doc ' END || doc_id || '.txt' AS filename,
                CASE WHEN lang = 'de' THEN 'text/plain' WHEN error IS NULL AND NOT kept THEN lang END AS content_type,
                CAST(CASE WHEN error IS NULL THEN CASE WHEN kept THEN quality + 7 ELSE bytes END END AS BIGINT) AS size,
                CASE WHEN error IS NULL THEN CASE WHEN kept THEN sha256(CAST(doc_id AS VARCHAR)) ELSE digest END END AS sha256,
                CASE WHEN error IS NULL THEN 'files/docs_example/' || doc_id || '/' || left(sha1(source_url), 12) ||
                    '-doc-' || doc_id || '.txt' END AS local_path,
                CASE WHEN error IS NULL THEN 'downloaded' ELSE 'failed' END AS status, error
            FROM e""",
        "cursor_advance": f"""
            WITH o AS ({OUTCOMES})
            SELECT day_source AS source,
                CASE WHEN newest IS NULL THEN TIMESTAMP '2030-01-01' ELSE newest END AS cursor_at,
                CASE WHEN newest IS NULL THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2026-03-01 12:00:00' END AS saved_at
            FROM (
                SELECT day_source, CASE WHEN count(*) FILTER (step = 'error') = 0
                    THEN max(ts) FILTER (step IN ('inserted', 'updated')) END AS newest
                FROM o GROUP BY day_source
            )""",
        "run_summary": SUMMARY,
        "run_errors": f"""
            SELECT source, CAST(event_id AS VARCHAR) AS external_id, stage, props AS message,
                CAST(0 AS INTEGER) AS page_no, CAST(event_id AS INTEGER) AS pos, CAST(0 AS INTEGER) AS item
            FROM ({OUTCOMES}) WHERE step = 'error'""",
        "all_totals": f"""
            SELECT coalesce(source, 'all') AS source, CAST(sum(discovered) AS BIGINT) AS discovered,
                CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(inserted) AS BIGINT) AS inserted,
                CAST(sum(updated) AS BIGINT) AS updated,
                CAST(sum(attachments_downloaded) AS BIGINT) AS attachments_downloaded,
                CAST(sum(errors) AS BIGINT) AS errors, sum(errors) = 0 AS ok
            FROM ({SUMMARY}) s GROUP BY ROLLUP (source)""",
        "exit_code": "SELECT CAST(max(CAST(event_type = 'error' AS INTEGER)) AS INTEGER) AS exit_code FROM events",
        "constraint_check": """
            WITH r AS (
                SELECT o_orderkey, o_orderstatus, o_orderpriority,
                    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,2)) * 40000000000 AS price
                FROM orders
            )
            SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'title must not be null'
                    WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown kind: ' || o_orderstatus
                    WHEN price >= 10000000000000000 THEN
                        'price out of range: ' || CAST(CAST(price AS DECIMAL(38,10)) AS VARCHAR) END AS violation,
                CASE WHEN price < 10000000000000000 THEN CAST(price AS DECIMAL(18,2)) END AS price
            FROM r""",
        "duplicate_keys": """
            SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem
            GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "ambiguous_ids": """
            SELECT 'customers' AS source, CAST(o_custkey AS VARCHAR) AS external_id, count(*) AS "rows",
                min('/o/' || o_orderkey) AS first_url, max('/o/' || o_orderkey) AS last_url
            FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
        "orphans_and_cascade": """
            SELECT 'customers without orders' AS part, count(*) AS "rows", CAST(sum(c_custkey) AS BIGINT) AS key_sum
            FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
            UNION ALL SELECT 'orders kept', count(*), CAST(sum(o_orderkey) AS BIGINT)
            FROM orders WHERE o_orderstatus <> 'P'
            UNION ALL SELECT 'lines kept', count(*), CAST(sum(l_orderkey) AS BIGINT)
            FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
        "fetch_outcomes": f"{FETCHES} SELECT transport, url, outcome, CAST(attempts AS BIGINT) AS attempts, over_budget FROM outcomes",
        "fetch_classes": """
            SELECT o_orderkey, CASE WHEN c IN (401, 403, 429) THEN 'blocked'
                WHEN c IN (408, 425) OR c >= 500 THEN 'transient' WHEN c >= 400 THEN 'permanent' ELSE 'ok' END AS class
            FROM (SELECT o_orderkey, o_orderkey % 400 + 200 AS c FROM orders)""",
        "retry_due": f"""{FETCHES}
            SELECT transport, url, CAST(attempt_no + 1 AS INTEGER) AS attempt_no,
                requested_at + CASE attempt_no WHEN 1 THEN INTERVAL 1 SECOND ELSE INTERVAL 2 SECOND END AS due_at
            FROM tried WHERE class = 'transient' AND attempt_no < 3""",
        "refetch": f"""{FETCHES}
            SELECT url FROM outcomes WHERE transport = 'http' AND outcome = 'blocked'
                AND url NOT IN (SELECT url FROM outcomes WHERE transport = 'browser')""",
        "url_outcomes": f"""{FETCHES}
            SELECT url, CASE WHEN h = 'ok' OR b = 'ok' THEN 'ok' WHEN h IS NOT NULL THEN h ELSE b END AS outcome
            FROM (
                SELECT url, max(outcome) FILTER (transport = 'http') AS h,
                    max(outcome) FILTER (transport = 'browser') AS b
                FROM outcomes GROUP BY url
            )""",
        "host_slots": """
            WITH RECURSIVE r AS (
                SELECT event_id, 'h' || user_id || '.example' AS host, (epoch_us(ts) // 1000) AS a, 36000000 + event_id % 750 AS g,
                    row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn
                FROM events
            ),
            s AS (
                SELECT event_id, host, a AS slot, g, rn FROM r WHERE rn = 1
                UNION ALL
                SELECT r.event_id, r.host, greatest(r.a, s.slot + s.g), r.g, r.rn
                FROM s JOIN r ON r.host = s.host AND r.rn = s.rn + 1
            )
            SELECT event_id, host, CAST(slot AS BIGINT) AS slot_ms FROM s""",
        "size_gate": """
            SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'declared size over the limit'
                WHEN octet_length(encode(text)) > 5000 THEN 'size over the limit' END AS violation
            FROM documents""",
        "harvest_run": """
            SELECT 'notices' AS source, count(*) AS discovered, count(*) AS processed, count(*) AS inserted,
                CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS errors, count(*) AS stored,
                CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS price_sum
            FROM orders
            UNION ALL
            SELECT 'shop', count(*), count(*), count(*), 0, 0, count(*),
                CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(28,2))
            FROM part""",
        "stream_run": f"""
            SELECT 'shop' AS source, 'P-' || p_partkey AS external_id, p_name AS title,
                CAST(p_retailprice AS DECIMAL(18,2)) AS price, {size_text} AS status,
                TIMESTAMP '2026-03-01 12:00:00' AS first_seen_at
            FROM part""",
        "rerun_newest_fetch": """
            SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN p WHEN o_orderkey % 5 = 0 THEN NULL
                    WHEN o_orderkey % 3 = 0 THEN p ELSE p + 1000 END AS DECIMAL(18,2)) AS price,
                CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 'detail' END AS stage, false AS cursor_moved
            FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)""",
        "stream_replay": """
            SELECT 'P-' || p_partkey AS external_id,
                CAST(CAST(p_retailprice AS DECIMAL(18,2)) + CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN 7 ELSE 0 END AS DECIMAL(18,2)) AS price,
                CASE WHEN p_partkey % 7 = 0 THEN 'detail' END AS stage
            FROM part""",
    }
    # Pages of all orders as bytes in two charsets and three ways: the records of purchase_extract.
    found["charset_extract"] = found["purchase_extract"]
    found["harvest_attachments"] = """
        WITH f AS (
            SELECT o_orderkey, 'https://n.example/docs/%D0%A2%D0%97%20' || o_orderkey || '.PDF' AS source_url,
                CASE o_orderkey % 4 WHEN 0 THEN 'stored' WHEN 1 THEN 'ok' WHEN 2 THEN 'size' ELSE 'error' END AS way,
                1000 + o_orderkey AS kept, 2000 + o_orderkey AS fresh
            FROM orders
            UNION ALL
            SELECT o_orderkey, 'https://n.example/files?id=' || o_orderkey,
                CASE o_orderkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'large' ELSE 'ok' END, NULL, 3000 + o_orderkey
            FROM orders
        )
        SELECT o_orderkey, source_url,
            CASE WHEN way IN ('stored', 'ok') THEN 'downloaded' ELSE 'failed' END AS status,
            CAST(CASE way WHEN 'stored' THEN kept WHEN 'ok' THEN fresh END AS BIGINT) AS size,
            CASE way WHEN 'stored' THEN sha256('stored ' || o_orderkey) WHEN 'ok' THEN sha256(source_url) END AS sha256,
            CASE way WHEN 'size' THEN 'size differs from the reported one: ' || source_url WHEN 'error' THEN 'HTTP 500'
                WHEN 'missing' THEN 'not downloaded: ' || source_url WHEN 'large' THEN 'declared size over the limit' END AS error,
            way IN ('stored', 'ok') AS has_path
        FROM f"""
    found["run_document"] = f"""
        WITH s AS ({SUMMARY}),
        e AS (SELECT source, 'ошибка: ' || props AS m, event_id FROM ({OUTCOMES}) WHERE step = 'error'),
        per AS (SELECT source, count(*) AS n, md5(string_agg(m, chr(10) ORDER BY event_id)) AS d FROM e GROUP BY source)
        SELECT s.source, discovered, processed, inserted, updated, attachments_downloaded,
            CAST(coalesce(n, 0) AS BIGINT) AS errors, coalesce(d, md5('')) AS digest
        FROM s LEFT JOIN per USING (source)
        UNION ALL
        SELECT 'all', CAST(sum(discovered) AS BIGINT), CAST(sum(processed) AS BIGINT), CAST(sum(inserted) AS BIGINT),
            CAST(sum(updated) AS BIGINT), CAST(sum(attachments_downloaded) AS BIGINT),
            (SELECT count(*) FROM e), (SELECT coalesce(md5(string_agg(m, chr(10) ORDER BY source, event_id)), md5('')) FROM e)
        FROM s"""
    url = "'https://n.example/epz/order/notice/' || o_orderkey || '?print=1'"
    found["detail_causes"] = f"""
        SELECT o_orderkey, 'detail' AS stage, 'detail page not available: ' || {url} || ' (' || CASE o_orderkey % 3
                WHEN 0 THEN 'blocked: origin rejected the request (HTTP 403): ' || {url}
                WHEN 1 THEN 'permanent: HTTP 404: ' || {url}
                ELSE 'transient: timed out' END || ')' AS message
        FROM orders WHERE o_orderkey % 5 = 0"""
    return found

"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from quire.llm.lookalikes import form_sql, p3_forms, p3_found
from quire.llm.packing import p6_packed
from quire.llm.repeated_lines import p4_clean, p4_found
from quire.llm.scan_noise import p1_found, p1_repaired
from quire.llm.splitting import p2_found, p2_pieces
from quire.llm.shared_spans import p7_found, p7_members, p7_shared, p7_stretches
from quire.llm.tokens import p5_ids

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_repaired, p2_found, p2_pieces, p3_found, p3_forms, p4_found, p4_clean, p5_ids, p6_packed, p7_found, p7_stretches, p7_members, p7_shared)
}

_RECORDS = f"""
r AS (SELECT DISTINCT book, id, s FROM (SELECT book, bookmark_id AS id, title AS s FROM bookmarks UNION ALL SELECT book, chunk_id, title FROM chunks UNION ALL SELECT book, figure_id, caption FROM figures)),
f AS (SELECT book, id, s, {form_sql()} AS form FROM r)"""
_REPEATED = r"""
line AS (
  SELECT book, chunk_id, u.line, u.line_no
  FROM (SELECT DISTINCT book, chunk_id, string_split(text, chr(10)) AS lines FROM chunks WHERE text IS NOT NULL),
       LATERAL (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no) u),
keyed AS (
  SELECT book, chunk_id, CAST(line_no AS INTEGER) AS line_no,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '<*>', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS key
  FROM line WHERE length(line) <= 400 AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 8),
often AS (
  SELECT book, key FROM keyed JOIN (SELECT book, count(DISTINCT chunk_id) AS docs FROM chunks GROUP BY book) USING (book)
  GROUP BY book, key, docs HAVING count(DISTINCT chunk_id) >= 4 AND count(DISTINCT chunk_id) >= 0.2 * docs),
gone AS (SELECT DISTINCT chunk_id, line_no FROM keyed JOIN often USING (book, key))"""

ORACLE: dict[str, str] = {
    "p3_found": f"WITH {_RECORDS} SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM f a JOIN f b ON a.book = b.book AND a.form = b.form AND a.s <> b.s AND a.id < b.id WHERE a.s <> '' AND b.s <> '' AND a.form <> ''",
    "p3_forms": f"WITH {_RECORDS} SELECT id, form FROM (SELECT DISTINCT id, s, form FROM f)",
    "p4_clean": f"WITH {_REPEATED} SELECT chunk_id, book, CASE WHEN text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.line_no) FROM line l WHERE l.chunk_id = c.chunk_id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.chunk_id = l.chunk_id AND g.line_no = l.line_no)), '') END AS text FROM chunks c",
    # every window of 200 characters of every text
    "p7_found": """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
p AS (SELECT doc_id, substring(text, CAST(a AS BIGINT), 2199) AS part FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198, 2000)) AS a FROM d)),
w AS (SELECT DISTINCT doc_id, md5(substring(part, CAST(k AS BIGINT), 200)) AS h FROM (SELECT doc_id, part, unnest(range(1, length(part) - 198)) AS k FROM p)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM (SELECT * FROM w SEMI JOIN s USING (h)) a JOIN (SELECT * FROM w SEMI JOIN s USING (h)) b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p2_found": """
WITH page AS (
  SELECT book, page, max_by(length(coalesce(extracted, layer, '')), (coalesce(extracted_at, TIMESTAMP '1900-01-01'), coalesce(loaded_at, TIMESTAMP '1900-01-01'))) // 4 AS size
  FROM page_texts GROUP BY book, page),
s AS (SELECT DISTINCT span_id, book, page_start, page_end, max_tokens FROM spans JOIN budgets USING (budget))
SELECT span_id, CASE WHEN max(size) > max_tokens THEN 'inside' ELSE 'page' END AS cut
FROM s JOIN page p ON p.book = s.book AND p.page BETWEEN s.page_start AND s.page_end
GROUP BY span_id, max_tokens HAVING sum(size) > max_tokens
""",
    "p4_found": f"WITH {_REPEATED} SELECT chunk_id, line_no FROM gone",
}

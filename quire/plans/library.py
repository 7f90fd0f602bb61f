"""Queries on pages, outlines, plans and figures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import mathfont
from quire.functions import text as T
from quire.operators import cleaning, figures, listing, notes, outline, plan, planning, titles
from quire.operators.pages import holding, page_text, scanned_pages
from quire.session import cut, table
from quire.sources import html

Q: dict = {}
SQL: dict[str, str] = {}

# the row of a page that holds, as SQL
PAGES = """
pages AS (SELECT book, page, max_by(coalesce(extracted, layer, ''), (coalesce(extracted_at, TIMESTAMP '1900-01-01'), coalesce(loaded_at, TIMESTAMP '1900-01-01'))) AS text
          FROM page_texts WHERE book IS NOT NULL AND page IS NOT NULL GROUP BY book, page)"""
OUTLINE = """
o AS (SELECT DISTINCT book, idx, title, level, page FROM bookmarks WHERE page IS NOT NULL AND trim(title) <> '')"""
B = r"[ \t\n\r\f\x{0B}\x{A0}]"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark, d):
    rows = table(spark, d, "page_texts")
    return holding(rows.withColumn("text", page_text(rows)), F.col("text"))


def entries(spark, d):
    return outline.entries(table(spark, d, "bookmarks"))


@query(f"WITH {PAGES} SELECT book, page, length(text) AS chars, md5(text) AS digest FROM pages")
def q_page_text(spark, d):
    return pages(spark, d).select("book", "page", F.length("text").alias("chars"), F.md5("text").alias("digest"))


_CONTENTS = r"""(len(regexp_extract_all(text, '(?m)^[^\n]*?(?:\. ?){4,} *[0-9]{1,4}[ \t]*$')) >= 5
 OR coalesce(length(list_aggregate(regexp_extract_all(text, '(?m)^[^\n]*?(?:\. ?){4,} *[0-9]{1,4}[ \t]*$'), 'string_agg', '')) >= length(text) * 0.5, false))"""


@query(f"""WITH {PAGES} SELECT chunk_id, md5(string_agg(p.text, chr(10) || chr(10) ORDER BY p.page)) AS digest, count(*) AS pages
FROM chunks c JOIN (SELECT * FROM pages WHERE NOT {_CONTENTS}) p ON p.book = c.book AND p.page BETWEEN c.page_start AND c.page_end WHERE p.text <> '' GROUP BY chunk_id""")
def q_range_text(spark, d):
    return cleaning.range_texts(table(spark, d, "chunks"), pages(spark, d), "chunk_id").select("chunk_id", F.md5("text").alias("digest"), "pages")


@query(rf"""WITH {PAGES} SELECT book, page, length(regexp_replace(text, '^{B}+|{B}+$', '', 'g')) AS chars FROM pages
WHERE length(regexp_replace(text, '^{B}+|{B}+$', '', 'g')) < 180""")
def q_ocr_needed(spark, d):
    return cleaning.needing_ocr(pages(spark, d))


@query("SELECT DISTINCT book, unnest(ocr_pages) AS page FROM extract_results WHERE book IS NOT NULL")
def q_scanned_pages(spark, d):
    return scanned_pages(table(spark, d, "extract_results"))


@query(rf"""WITH {PAGES} SELECT book, page FROM pages WHERE len(regexp_extract_all(text, '(?m)^[^\n]*?(?:\. ?){{4,}} *[0-9]{{1,4}}[ \t]*$')) >= 5
OR length(list_aggregate(regexp_extract_all(text, '(?m)^[^\n]*?(?:\. ?){{4,}} *[0-9]{{1,4}}[ \t]*$'), 'string_agg', '')) >= length(text) * 0.5""")
def q_contents_page(spark, d):
    return pages(spark, d).where(T.is_contents_page(F.col("text"))).select("book", "page")


# every page with as many dotted entries below it as its number says
@query(rf"""WITH {PAGES}, v AS (SELECT book, page, text || repeat(chr(10) || 'An entry of the contents ..... ' || page, CAST(page % 8 AS INTEGER)) AS text FROM pages)
SELECT book, page, len(regexp_extract_all(text, '(?m)^[^\n]*?(?:\. ?){{4,}} *[0-9]{{1,4}}[ \t]*$')) >= 5
 OR coalesce(length(list_aggregate(regexp_extract_all(text, '(?m)^[^\n]*?(?:\. ?){{4,}} *[0-9]{{1,4}}[ \t]*$'), 'string_agg', '')) >= length(text) * 0.5, false) AS contents FROM v""")
def q_contents_predicate(spark, d):
    entry = F.concat(F.lit("\nAn entry of the contents ..... "), F.col("page").cast("string"))
    return pages(spark, d).select("book", "page", T.is_contents_page(F.concat("text", F.repeat(entry, (F.col("page") % 8).cast("int")))).alias("contents"))


_BAD = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]"


# every page as it is, and with some of its letters unreadable
@query(rf"""WITH {PAGES}, v AS (SELECT book, page, text, translate(text, 'aeio', chr(1) || chr(2) || chr(65533) || chr(127)) AS broken FROM pages)
SELECT book, page, length(text) > 0 AND length(text) - length(regexp_replace(text, '{_BAD}', '', 'g')) >= length(text) * 0.2 AS bad,
 length(broken) > 0 AND length(broken) - length(regexp_replace(broken, '{_BAD}', '', 'g')) >= length(broken) * 0.2 AS broken_bad FROM v""")
def q_garbled(spark, d):
    broken = F.translate("text", "aeio", "\x01\x02\ufffd\x7f")
    return pages(spark, d).select("book", "page", T.garbled(F.col("text")).alias("bad"), T.garbled(broken).alias("broken_bad"))


_LINES = f"""WITH {PAGES},
ln AS (SELECT book, page, pos, line FROM (SELECT book, page, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM pages),
       LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS pos) u),
k AS (SELECT *, regexp_replace(lower(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '[0-9]+', '0', 'g') AS key,
      regexp_replace(line, '^{B}+|{B}+$', '', 'g') AS bare FROM ln),
e AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY pos) AS a, row_number() OVER (PARTITION BY book, page ORDER BY pos DESC) AS z FROM k WHERE bare <> ''),
f AS (SELECT book, key, count(DISTINCT page) AS on_pages FROM e WHERE (a <= 3 OR z <= 3) AND length(regexp_replace(key, '[0-9]', '', 'g')) >= 3 GROUP BY book, key),
furniture AS (SELECT f.* FROM f JOIN (SELECT book, count(*) AS n FROM pages GROUP BY book HAVING count(*) >= 10) USING (book) WHERE on_pages >= 0.1 * n)
"""


@query(_LINES + "SELECT * FROM furniture")
def q_furniture(spark, d):
    return cleaning.furniture(pages(spark, d), share=0.1)


@query(_LINES + """SELECT book, page, md5(coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM k WHERE k.book = p.book AND k.page = p.page
 AND NOT EXISTS (SELECT 1 FROM furniture x WHERE x.book = k.book AND x.key = k.key)), '')) AS digest FROM pages p""")
def q_without_furniture(spark, d):
    held = cut(pages(spark, d))
    clean = cleaning.without_furniture(held, cleaning.furniture(held, share=0.1))
    return clean.select("book", "page", F.md5("text").alias("digest"))


@query(rf"""WITH {PAGES}, t AS (SELECT DISTINCT book, page, unnest(regexp_extract_all(text, '\b[A-Z]{{2}}-[0-9]{{4}}\b')) AS token FROM pages),
n AS (SELECT book, count(*) AS n FROM pages GROUP BY book)
SELECT book, token, count(*) AS on_pages FROM t JOIN n USING (book) GROUP BY book, token, n HAVING count(*) >= greatest(2, least(3, n))""")
def q_watermark(spark, d):
    return cleaning.watermarks(pages(spark, d), r"\b[A-Z]{2}-[0-9]{4}\b")


@query(rf"""WITH {PAGES}, t AS (SELECT DISTINCT book, page, unnest(regexp_extract_all(text, '\b[A-Z]{{2}}-[0-9]{{4}}\b')) AS token FROM pages),
n AS (SELECT book, count(*) AS n FROM pages GROUP BY book), m AS (SELECT book, token FROM t JOIN n USING (book) GROUP BY book, token, n HAVING count(*) >= greatest(2, least(3, n))),
x AS (SELECT book, page, string_agg(token, '|') AS marks FROM t JOIN m USING (book, token) GROUP BY book, page)
SELECT p.book, p.page, md5(CASE WHEN marks IS NULL THEN text ELSE regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \t]*\b(?:' || marks || ')\b[ \t]*', '', 'g'), '[ \t]*\b(?:' || marks || ')\b[ \t]*(?m:$)', '', 'g'), '[ \t]*\b(?:' || marks || ')\b[ \t]*', ' ', 'g') END) AS digest
FROM pages p LEFT JOIN x ON x.book = p.book AND x.page = p.page""")
def q_without_watermarks(spark, d):
    clean = cleaning.without_watermarks(cut(pages(spark, d)), r"\b[A-Z]{2}-[0-9]{4}\b")
    return clean.select("book", "page", F.md5("text").alias("digest"))


@query(r"""SELECT doc_id, md5(list_aggregate(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\|[^\n]*\|[ \t\r]*$') THEN regexp_replace(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), '-{4,}', '---', 'g') ELSE x END), 'string_agg', chr(10))) AS digest
FROM documents WHERE text IS NOT NULL""")
def q_compact_tables(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(cleaning.compact_tables(F.col("text"))).alias("digest"))


@query(rf"""WITH {PAGES}, b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages),
h AS (SELECT book, substring(text, 1, CAST(200000 - before AS BIGINT)) AS t FROM b WHERE before < 200000),
c AS (SELECT book, sum(length(regexp_replace(t, '[^ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]', '', 'g'))) AS polish, sum(length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))) AS letters FROM h GROUP BY book)
SELECT book, CAST(polish AS BIGINT) AS polish, CAST(letters AS BIGINT) AS letters, coalesce((SELECT max(lower(language)) FROM books WHERE slug = book), CASE WHEN letters > 0 AND polish >= 0.02 * letters THEN 'pl' ELSE 'en' END) AS language FROM c""")
def q_language(spark, d):
    return cleaning.language(cut(pages(spark, d)), settings=table(spark, d, "books").select(F.col("slug").alias("book"), "language"))


@query("SELECT chunk_id, length(text) // 4 AS tokens, max_tokens FROM chunks c JOIN books b ON b.slug = c.book JOIN budgets USING (budget) WHERE length(text) // 4 > max_tokens")
def q_oversized(spark, d):
    return planning.oversized(table(spark, d, "chunks"), table(spark, d, "budgets"), table(spark, d, "books"))


@query(rf"""SELECT DISTINCT bookmark_id, trim(regexp_replace(title, '{B}+', ' ', 'g')) AS squeezed, lower(regexp_replace(title, '[^\p{{L}}\p{{N}}]', '', 'g')) AS key,
 coalesce(nullif(regexp_replace(regexp_replace(translate(lower(title), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug
FROM bookmarks WHERE title IS NOT NULL""")
def q_title_keys(spark, d):
    t = F.col("title")
    rows = table(spark, d, "bookmarks").where("title IS NOT NULL")
    return rows.select("bookmark_id", T.squeeze(t).alias("squeezed"), T.letters_key(t).alias("key"), T.slugify(t).alias("slug")).distinct()


@query(rf"""WITH s AS (SELECT DISTINCT bookmark_id, title, trim(regexp_replace(title, '{B}+', ' ', 'g')) AS t FROM bookmarks WHERE title IS NOT NULL),
n AS (SELECT *, nullif(regexp_extract(t, '{T.SECTION}', 1), '') AS section, coalesce(nullif(regexp_extract(t, '{T.SECTION}', 2), ''), t) AS name FROM s)
SELECT bookmark_id, section, name, TRY_CAST(nullif(regexp_extract(title, '{T.CHAPTER_NUMBER}', 1), '') AS INTEGER) AS chapter,
 coalesce(nullif(regexp_replace(regexp_replace(title, '{T.CHAPTER_PREFIX}', ''), '^{B}+|{B}+$', '', 'g'), ''), regexp_replace(title, '^{B}+|{B}+$', '', 'g')) AS chapter_name,
 list_aggregate(list_transform(string_split(section, '.'), lambda x: CASE WHEN length(x) < 2 THEN lpad(x, 2, '0') ELSE x END), 'string_agg', '.') AS padded FROM n""")
def q_section_parts(spark, d):
    t = F.col("title")
    rows = table(spark, d, "bookmarks").where("title IS NOT NULL").select("bookmark_id", "title").distinct()
    section = T.section_number(t)
    return rows.select(
        "bookmark_id", section.alias("section"), T.section_title(t).alias("name"), T.chapter_number(t).alias("chapter"),
        T.chapter_name(t).alias("chapter_name"), T.padded_section(section).alias("padded"),
    )


# the ranges of a book's chunks, written down with all marks that may stand between
@query("""SELECT chunk_id, CAST(page_start AS INTEGER) AS first, CAST(page_end AS INTEGER) AS last FROM chunks WHERE page_start >= 1 AND page_start <= page_end
UNION ALL SELECT chunk_id, CAST(page_end AS INTEGER), CAST(page_end AS INTEGER) FROM chunks WHERE page_start >= 1 AND page_start <= page_end""")
def q_page_ranges(spark, d):
    rows = table(spark, d, "chunks").where("page_start >= 1 AND page_start <= page_end")
    dash = F.when(F.col("chunk_id") % 2 == 0, " – ").otherwise("-")
    written = F.concat(F.col("page_start").cast("string"), dash, F.col("page_end").cast("string"), F.when(F.col("chunk_id") % 3 == 0, ";\n").otherwise(", "), F.col("page_end").cast("string"))
    return rows.select("chunk_id", F.inline(T.page_ranges(written)))


LAST = """
own AS (SELECT book, max(page) AS page FROM (SELECT slug AS book, page_count AS page FROM books UNION ALL SELECT book, page FROM page_texts) WHERE book IS NOT NULL AND page IS NOT NULL GROUP BY book),
last AS (SELECT book, coalesce(own.page, max(b.page)) AS last FROM bookmarks b LEFT JOIN own USING (book) WHERE b.page IS NOT NULL GROUP BY book, own.page)"""


def last_pages(spark, d):
    return outline.last_pages(table(spark, d, "books"), table(spark, d, "page_texts"), table(spark, d, "bookmarks"))


@query(f"""WITH {OUTLINE}, {LAST}, n AS (SELECT a.*, (SELECT arg_min(b.page, b.idx) FROM o b WHERE b.book = a.book AND b.idx > a.idx AND b.page >= a.page) AS next_page FROM o a)
SELECT book, idx, page AS page_start, CASE WHEN next_page IS NULL THEN greatest(page, last) ELSE greatest(page, next_page - 1) END AS page_end FROM n JOIN last USING (book)""")
def q_spans(spark, d):
    return outline.spans(entries(spark, d), last_pages(spark, d))


@query(f"""WITH {OUTLINE} SELECT a.book, a.idx, (SELECT max(b.idx) FROM o b WHERE b.book = a.book AND b.idx < a.idx AND b.level < a.level) AS parent FROM o a""")
def q_outline_parents(spark, d):
    return outline.parents(entries(spark, d))


@query(f"""WITH {OUTLINE} SELECT a.book, a.idx, (SELECT min(b.idx) FROM o b WHERE b.book = a.book AND b.idx > a.idx AND b.level <= a.level) AS end_idx FROM o a""")
def q_subtree_ends(spark, d):
    return outline.subtree_ends(entries(spark, d))


_APPARATUS = "(regexp_replace(lower(regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')), '^[0-9]+', '') IN (" + ", ".join(f"'{x}'" for x in T.APPARATUS) + f") OR regexp_matches(regexp_replace(lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '^[0-9]+', ''), '^(?:{'|'.join(T.APPARATUS_BEGINS)})'))"
_NUMBERED = f"""WITH RECURSIVE {OUTLINE}, t AS (SELECT *, nullif(regexp_extract(trim(regexp_replace(title, '{B}+', ' ', 'g')), '{T.SECTION}', 1), '') AS section,
 TRY_CAST(nullif(regexp_extract(title, '{T.CHAPTER_NUMBER}', 1), '') AS INTEGER) AS chapter, chapter IS NOT NULL AND NOT regexp_matches(title, '{T.CHAPTER_SECTION}') AS heads, {_APPARATUS} AS apparatus FROM o)
"""


@query(_NUMBERED + """, s AS (SELECT *, lead(page) OVER (PARTITION BY book ORDER BY idx) < page AS back FROM t),
c AS (SELECT book, count(*) AS entries, count(*) FILTER (WHERE back) AS backwards, count(*) FILTER (WHERE section IS NOT NULL) AS numbered FROM s GROUP BY book)
SELECT *, list_filter([CASE WHEN backwards > 0 THEN backwards || ' of ' || entries || ' entries are followed by one on an earlier page' END, CASE WHEN numbered = 0 THEN 'no entry has a section number' END], lambda x: x IS NOT NULL) AS problems FROM c""")
def q_outline_problems(spark, d):
    return outline.problems(entries(spark, d))


@query(_NUMBERED + """, n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, idx) AS n FROM t),
f AS (SELECT book, n, page, CASE WHEN chapter IS NOT NULL THEN chapter END AS now, CASE WHEN heads THEN level ELSE 0 END AS lv FROM n WHERE n = 1 UNION ALL
 SELECT n.book, n.n, n.page, CASE WHEN n.chapter IS NOT NULL THEN n.chapter WHEN n.level <= f.lv THEN NULL ELSE f.now END, CASE WHEN n.heads THEN n.level ELSE f.lv END FROM f JOIN n ON n.book = f.book AND n.n = f.n + 1),
p AS (SELECT book, page, arg_max(coalesce(now, -1), n) AS now FROM f GROUP BY book, page)
SELECT t.book, idx, nullif(p.now, -1) AS chapter FROM t JOIN p ON p.book = t.book AND p.page = t.page""")
def q_outline_chapter(spark, d):
    return outline.chapters(entries(spark, d))


@query(_NUMBERED + """, a AS (SELECT *, bool_or(section IS NOT NULL OR (level = 0 AND heads)) OVER (PARTITION BY book) AS numbered, coalesce(lead(level) OVER (PARTITION BY book ORDER BY idx) > 0, false) AS parent FROM t),
b AS (SELECT *, coalesce(idx >= min(idx) FILTER (WHERE level = 0 AND parent AND NOT apparatus) OVER (PARTITION BY book), false) AS begun FROM a),
c AS (SELECT *, level = 0 AND begun AND NOT apparatus AS opens, (SELECT max(z.idx) FROM t z WHERE z.book = b.book AND z.level = 0 AND z.idx <= b.idx) AS top FROM b),
d AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY book ORDER BY idx) AS n, max(CASE WHEN idx = top THEN opens END) OVER (PARTITION BY book, top) AS within FROM c),
e AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book, top ORDER BY idx) AS k FROM d)
SELECT book, idx, CASE WHEN numbered THEN NULL WHEN opens THEN CAST(n AS VARCHAR) WHEN level = 1 AND within THEN n || '.' || k END AS number,
 NOT numbered AND level = 0 AND NOT begun AND NOT apparatus AND NOT parent AS dropped FROM e""")
def q_number_outline(spark, d):
    return outline.number_outline(entries(spark, d))


@query(_NUMBERED + f""", {LAST}, n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, idx) AS n FROM t),
f AS (SELECT book, n, title, section, level, page, 1 AS run, section AS own, level AS lv, true AS opens FROM n WHERE n = 1 UNION ALL
 SELECT n.book, n.n, n.title, n.section, n.level, n.page, f.run + CAST(x.opens AS INTEGER), CASE WHEN x.opens THEN n.section ELSE f.own END, CASE WHEN x.opens THEN n.level ELSE f.lv END, x.opens
 FROM f JOIN n ON n.book = f.book AND n.n = f.n + 1, LATERAL (SELECT CASE WHEN n.section IS NULL THEN n.apparatus AND n.level <= f.lv ELSE n.section IS DISTINCT FROM f.own END AS opens) x),
g AS (SELECT *, lead(page) OVER (PARTITION BY book ORDER BY run) AS following FROM f WHERE opens)
SELECT book, CAST(run AS BIGINT) AS run, title, section, level, page AS page_start, CASE WHEN following IS NULL THEN greatest(page, last) ELSE greatest(page, following - 1) END AS page_end FROM g JOIN last USING (book)""")
def q_section_ranges(spark, d):
    return outline.section_ranges(entries(spark, d), last_pages(spark, d))


@query(_NUMBERED + """, u AS (SELECT a.book, a.section IS NULL AND EXISTS (SELECT 1 FROM t b WHERE b.book = a.book AND b.section LIKE '%.%' AND b.idx < a.idx AND b.level < a.level AND NOT EXISTS
  (SELECT 1 FROM t m WHERE m.book = a.book AND m.idx > b.idx AND m.idx < a.idx AND m.level <= b.level)) AS under FROM t a)
SELECT book, bool_or(under) AS deep FROM u GROUP BY book""")
def q_deep_outline(spark, d):
    return outline.deep(entries(spark, d))


@query(f"""WITH {OUTLINE}, m AS (SELECT *, min(level) OVER (PARTITION BY book ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM o)
SELECT book, idx, level FROM m WHERE least IS NULL OR level <= least""")
def q_outermost(spark, d):
    return outline.outermost(entries(spark, d))


def _sizes(spark, d):
    rows = table(spark, d, "page_texts")
    return cut(holding(rows.withColumn("length", F.length(page_text(rows))), F.col("length")))


def _opening(spark, d):
    return cut(pages(spark, d).select("book", "page", F.length("text").alias("length"), T.opens_section(F.col("text")).alias("opens")))


# a line that opens a section: its title begins with a letter or digit that isn't in lower case and has no leader dots; a digit apart belongs to the number
_OPENS = rf"""len(list_filter(list_transform(list_zip(regexp_extract_all(text, '{T.NUMBERED_LINE}', 1), regexp_extract_all(text, '{T.NUMBERED_LINE}', 2)),
 lambda h: CASE WHEN regexp_full_match(h[1], '[0-9]+[.][0-9]') AND regexp_matches(h[2], '^[0-9]\s+\S') THEN regexp_replace(h[2], '^[0-9]\s+', '') ELSE h[2] END),
 lambda t: regexp_matches(t, '^[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}]') AND NOT regexp_matches(t, '(?:\.\s?){{4,}}'))) > 0"""
_SLICES = f"""WITH RECURSIVE {PAGES}, s AS (SELECT book, page, CASE WHEN text <> '' THEN length(text) + 2 ELSE 0 END AS size, {_OPENS} AS opens, row_number() OVER (PARTITION BY book ORDER BY page) AS n FROM pages),
g AS (SELECT book, page, n, size AS held, size, 0 AS slice FROM s WHERE n = 1 UNION ALL
 SELECT s.book, s.page, s.n, CASE WHEN x.new THEN s.size ELSE g.held + s.size END, s.size, g.slice + CAST(x.new AS INTEGER)
 FROM g JOIN s ON s.book = g.book AND s.n = g.n + 1, LATERAL (SELECT g.held > 0 AND (g.held + s.size > 24000 OR (g.held >= {{least}} AND s.opens)) AS new) x)
SELECT book, slice, min(page) AS first_page, max(page) AS last_page, CAST(sum(size) AS BIGINT) AS chars FROM g GROUP BY book, slice"""


@query(_SLICES.replace("{least}", "24000"))
def q_slice_pages(spark, d):
    return planning.slice_pages(_opening(spark, d))


@query(_SLICES.replace("{least}", "12000"))
def q_slice_sections(spark, d):
    return planning.slice_pages(_opening(spark, d), 6000, 3000)


# every ceiling that is tried, from an even share on, and the greedy one; of those with as few slices as greedy the lowest holds
@query(f"""WITH RECURSIVE {PAGES}, s AS (SELECT book, page, CASE WHEN text <> '' THEN length(text) + 2 ELSE 0 END AS size, {_OPENS} AS opens, row_number() OVER (PARTITION BY book ORDER BY page) AS n FROM pages),
a AS (SELECT book, n, size AS held, 0 AS slice FROM s WHERE n = 1 UNION ALL
 SELECT s.book, s.n, CASE WHEN x.new THEN s.size ELSE a.held + s.size END, a.slice + CAST(x.new AS INTEGER) FROM a JOIN s ON s.book = a.book AND s.n = a.n + 1, LATERAL (SELECT a.held > 0 AND (a.held + s.size > 24000 OR (a.held >= 12000 AND s.opens)) AS new) x),
m AS (SELECT book, max(slice) + 1 AS slices, greatest(any_value(t.total) - 2, 0) // 4 // (max(slice) + 1) AS share FROM a JOIN (SELECT book, sum(size) AS total FROM s GROUP BY book) t USING (book) GROUP BY book),
c AS (SELECT book, CAST(share AS BIGINT) AS ceiling FROM m WHERE slices > 1 AND share < 6000 UNION ALL SELECT book, CAST(ceiling + greatest(1, ceiling // 20) AS BIGINT) FROM c WHERE ceiling + greatest(1, ceiling // 20) < 6000),
e AS (SELECT * FROM c UNION ALL SELECT book, CAST(6000 AS BIGINT) FROM m),
g AS (SELECT s.book, e.ceiling, s.n, s.size AS held, s.page, s.size, 0 AS slice FROM s JOIN e USING (book) WHERE n = 1 UNION ALL
 SELECT s.book, g.ceiling, s.n, CASE WHEN x.new THEN s.size ELSE g.held + s.size END, s.page, s.size, g.slice + CAST(x.new AS INTEGER)
 FROM g JOIN s ON s.book = g.book AND s.n = g.n + 1, LATERAL (SELECT g.held > 0 AND (g.held + s.size > 4 * g.ceiling OR (g.held >= 4 * least(3000, g.ceiling) AND s.opens)) AS new) x),
b AS (SELECT book, min(ceiling) AS ceiling FROM (SELECT g.book, g.ceiling, max(slice) + 1 AS made FROM g GROUP BY g.book, g.ceiling) JOIN m USING (book) WHERE made = slices GROUP BY book)
SELECT book, slice, min(page) AS first_page, max(page) AS last_page, CAST(sum(size) AS BIGINT) AS chars FROM g JOIN b USING (book, ceiling) GROUP BY book, slice""")
def q_balanced(spark, d):
    return planning.balanced_slices(_opening(spark, d))


# units of the outline: an entry with its subtree in its chapter, if that fits; groups by the rules of fold_units
_UNITS = """WITH RECURSIVE s0 AS (SELECT DISTINCT book, idx, coalesce(level, 0) AS level, coalesce(outline_chapter, -1) AS chapter, coalesce(tokens, 0) AS tokens FROM spans WHERE book IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY idx) AS n, sum(tokens) OVER (PARTITION BY book ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4, count(*) OVER (PARTITION BY book) AS entries, sum(tokens) OVER (PARTITION BY book) AS total FROM s0),
e AS (SELECT a.*, coalesce((SELECT min(z.n) FROM s z WHERE z.book = a.book AND z.n > a.n AND (z.level <= a.level OR z.chapter <> a.chapter)), entries + 1) AS stop FROM s a),
p AS (SELECT e.*, coalesce(z.b4, CASE WHEN e.stop > e.entries THEN e.total ELSE 0 END) - coalesce(e.b4, 0) AS whole FROM e LEFT JOIN s z ON z.book = e.book AND z.n = e.stop),
q AS (SELECT book, idx, n, level, chapter, stop, entries, CASE WHEN whole <= 6000 THEN stop ELSE n + 1 END AS unit_end, CASE WHEN whole <= 6000 THEN whole ELSE tokens END AS size FROM p),
u AS (SELECT book, n, unit_end, size, chapter, CAST(size AS BIGINT) AS held, size < 3000 AS open, 0 AS grp, chapter AS gchapter FROM q WHERE n = 1 UNION ALL
 SELECT q.book, q.n, q.unit_end, q.size, q.chapter, CASE WHEN x.apart THEN q.size ELSE u.held + q.size END, (CASE WHEN x.apart THEN q.size ELSE u.held + q.size END) < 3000, u.grp + CAST(x.apart AS INTEGER), CASE WHEN x.apart THEN q.chapter ELSE u.gchapter END
 FROM u JOIN q ON q.book = u.book AND q.n = u.unit_end, LATERAL (SELECT NOT u.open OR q.stop > q.unit_end OR q.chapter <> u.gchapter OR u.held + q.size > 6000 OR (q.size >= 3000 AND u.held >= 150) AS apart) x),
m AS (SELECT s.book, s.idx, s.tokens, u.grp, u.gchapter FROM s JOIN u ON u.book = s.book AND s.n >= u.n AND s.n < u.unit_end),
t AS (SELECT book, grp, any_value(gchapter) AS chapter, sum(tokens) AS tokens FROM m GROUP BY book, grp),
r AS (SELECT book, grp, chapter, tokens, grp AS into_grp, chapter AS ichapter FROM t WHERE grp = 0 UNION ALL
 SELECT t.book, t.grp, t.chapter, t.tokens, CASE WHEN t.tokens < 150 AND r.ichapter = t.chapter THEN r.into_grp ELSE t.grp END, t.chapter FROM r JOIN t ON t.book = r.book AND t.grp = r.grp + 1),
k AS (SELECT *, sum(tokens) OVER (PARTITION BY book, into_grp) AS together FROM r)
SELECT m.book, m.idx, m.grp, CASE WHEN k.together >= 50 THEN k.into_grp END AS "into" FROM m JOIN k USING (book, grp)"""


@query(_UNITS)
def q_group_units(spark, d):
    rows = table(spark, d, "spans").where("book IS NOT NULL").select("book", "idx", "level", F.col("outline_chapter").alias("chapter"), "tokens").distinct()
    return planning.group_units(rows, 6000, 3000)


@query(_UNITS.rpartition("SELECT m.book")[0] + "SELECT book, idx, grp FROM m")
def q_group_spans(spark, d):
    return q_group_units(spark, d).select("book", "idx", "grp")


@query(_UNITS.rpartition("SELECT m.book")[0] + """SELECT book, grp, into_grp AS "into" FROM k WHERE together >= 50""")
def q_fold_small(spark, d):
    return q_group_units(spark, d).where("`into` IS NOT NULL").select("book", "grp", "into").distinct()


def plan_parts(spark, d):
    """The pages of all spans of all books, trimmed."""
    rows = table(spark, d, "page_texts")
    held = cut(holding(rows.withColumn("text", page_text(rows)), F.col("text"), F.col("layer")))
    clean = plan.readable(held, cleaning.furniture(held))
    spans = plan.planned_spans(entries(spark, d), last_pages(spark, d))
    return cut(plan.span_pages(spans, clean))


@query()
def q_plan(spark, d):
    parts = plan_parts(spark, d)
    chunks = cut(plan.plan(parts))
    texts = plan.chunk_texts(chunks, parts).select("book", "ord", F.md5("text").alias("digest"), F.length("text").alias("chars"))
    return chunks.drop("pages").join(texts, ["book", "ord"], "left")


@query(_NUMBERED + "SELECT book, idx, apparatus, heads, coalesce(TRY_CAST(regexp_extract(section, '^([0-9]+)', 1) AS INTEGER), chapter) AS owner FROM t")
def q_outline_titles(spark, d):
    title = F.col("title")
    return entries(spark, d).select("book", "idx", T.is_apparatus(title).alias("apparatus"), T.is_chapter_heading(title).alias("heads"), T.owner_chapter(title, F.lit(None).cast("int")).alias("owner"))


@query(f"""WITH {OUTLINE} SELECT book, idx, repeat('    ', level) || title || '  (p. ' || page || ')' AS label, regexp_replace(title, '^{B}+|{B}+$', '', 'g') AS back FROM o""")
def q_outline_labels(spark, d):
    return outline.labels(entries(spark, d)).withColumn("back", outline.label_title(F.col("label")))


_HEADS = rf"""WITH {{base}}, z AS (SELECT {{keys}}, u.pos, u.number, replace(u.title, '&amp;', '&') AS title FROM (SELECT {{keys}}, regexp_extract_all(text, '{T.NUMBERED_LINE}', 1) AS ns, regexp_extract_all(text, '{T.NUMBERED_LINE}', 2) AS ts FROM {{rows}}),
  LATERAL (SELECT unnest(ns) AS number, unnest(ts) AS title, generate_subscripts(ns, 1) - 1 AS pos) u),
y AS (SELECT *, regexp_full_match(number, '[0-9]+[.][0-9]') AND regexp_matches(title, '^[0-9][ \t]+[^ \t]') AS apart FROM z),
x AS (SELECT {{keys}}, CAST(pos AS INTEGER) AS pos, CASE WHEN apart THEN number || title[1] ELSE number END AS number, CASE WHEN apart THEN regexp_replace(title, '^[0-9][ \t]+', '') ELSE title END AS title FROM y),
h AS (SELECT * FROM x WHERE NOT regexp_matches(title, '(?:\. ?){{{{4,}}}}') AND regexp_matches(title, '^[\p{{{{Lu}}}}\p{{{{Lt}}}}\p{{{{Lo}}}}\p{{{{N}}}}]'))
"""


def _heads_sql(base: str, keys: str, rows: str) -> str:
    return _HEADS.replace("{base}", base).replace("{keys}", keys).replace("{rows}", rows).replace("{{", "{").replace("}}", "}")


@query(_heads_sql(PAGES, "book, page", "pages") + "SELECT * FROM h")
def q_numbered_heads(spark, d):
    return notes.numbered_heads(pages(spark, d), ["book", "page"])


# the head a chunk shows most, of its own chapter where that is known
@query(_heads_sql("cc AS (SELECT chunk_id, any_value(chapter) AS chapter, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id)", "chunk_id, chapter", "cc") + """,
g AS (SELECT chunk_id, number, count(*) AS n, min(pos) AS first_pos, arg_min(title, pos) AS title FROM h WHERE chapter IS NULL OR CAST(split_part(number, '.', 1) AS INTEGER) = chapter GROUP BY chunk_id, number)
SELECT chunk_id, number, title FROM g QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, first_pos) = 1""")
def q_chunk_head(spark, d):
    rows = table(spark, d, "chunks").where("text IS NOT NULL").select("chunk_id", "chapter", "text").dropDuplicates(["chunk_id"])
    heads = notes.numbered_heads(rows, ["chunk_id", "chapter"])
    own = heads.where(F.col("chapter").isNull() | (F.substring_index("number", ".", 1).cast("int") == F.col("chapter")))
    often = own.groupBy("chunk_id", "number").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by("title", "pos").alias("title"))
    best = often.groupBy("chunk_id").agg(F.max_by(F.struct("number", "title"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("chunk_id", "b.number", "b.title")


@query("""WITH t AS (SELECT book, chapter, arg_min(coalesce(title, ''), ord) FILTER (WHERE section = CAST(chapter AS VARCHAR)) AS title FROM chunks WHERE chapter IS NOT NULL GROUP BY book, chapter)
SELECT book, chapter, coalesce(title, '') AS title FROM t""")
def q_chapter_titles(spark, d):
    return plan.chapter_titles(table(spark, d, "chunks"))


@query("""WITH RECURSIVE b AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, coalesce(length(text), 0) AS length, coalesce(text LIKE '# %', false) AS target FROM documents WHERE source IS NOT NULL),
g AS (SELECT doc, pos, CAST(length AS BIGINT) AS held, 1 AS page FROM b WHERE pos = 0 UNION ALL
 SELECT b.doc, b.pos, CASE WHEN g.held >= 3000 OR b.target THEN b.length ELSE g.held + b.length END, g.page + CASE WHEN g.held >= 3000 OR b.target THEN 1 ELSE 0 END FROM g JOIN b ON b.doc = g.doc AND b.pos = g.pos + 1)
SELECT doc, CAST(pos AS INTEGER) AS pos, page FROM g""")
def q_paginate(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL")
    pos = F.row_number().over(figures.Window.partitionBy("source").orderBy("doc_id")) - 1
    blocks = rows.select(F.col("source").alias("doc"), pos.alias("pos"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.coalesce(F.col("text").startswith("# "), F.lit(False)).alias("target"))
    return planning.paginate(blocks)


# in order: a name that is used gets the first free number
@query("""WITH RECURSIVE c AS (SELECT book, chunk_id, section, row_number() OVER (PARTITION BY book ORDER BY chunk_id) AS n FROM (SELECT DISTINCT book, chunk_id, section FROM chunks WHERE section IS NOT NULL)),
w AS (SELECT book, chunk_id, n, section AS made, [section] AS used FROM c WHERE n = 1 UNION ALL
 SELECT c.book, c.chunk_id, c.n, x.made, list_append(w.used, x.made) FROM w JOIN c ON c.book IS NOT DISTINCT FROM w.book AND c.n = w.n + 1,
 LATERAL (SELECT CASE WHEN NOT list_contains(w.used, c.section) THEN c.section ELSE c.section || '-' || (SELECT min(k) FROM range(2, len(w.used) + 3) t(k) WHERE NOT list_contains(w.used, c.section || '-' || k)) END AS made) x)
SELECT chunk_id, made AS unique_name FROM w UNION ALL SELECT chunk_id, NULL FROM chunks WHERE section IS NULL GROUP BY chunk_id""")
def q_unique_suffix(spark, d):
    return planning.unique_names(table(spark, d, "chunks"), "book", "section", "chunk_id").select("chunk_id", "unique_name")


@query(f"""WITH {PAGES}, e AS (SELECT book, min(page) AS a, max(page) AS z FROM pages GROUP BY book), b AS (SELECT book, z, unnest(generate_series(a, z, 40)) AS f FROM e)
SELECT book, CAST(f AS INTEGER) AS first_page, CAST(least(z, f + 39) AS INTEGER) AS last_page FROM b""")
def q_batches(spark, d):
    return planning.batches(_sizes(spark, d))


_FIGS = "f AS (SELECT * FROM figures QUALIFY row_number() OVER (PARTITION BY figure_id ORDER BY figure_id) = 1)"


def _figures(spark, d):
    return figures.distinct_figures(table(spark, d, "figures"))


# figures as glyphs: those whose middle lies in another figure's box of the page
@query(f"""WITH {_FIGS}, b AS (SELECT figure_id, book, page, least(bbox.l, bbox.r) AS l, greatest(bbox.l, bbox.r) AS r, least(bbox.t, bbox.b) AS bo, greatest(bbox.t, bbox.b) AS t FROM f)
SELECT g.figure_id AS id, b.figure_id AS box FROM b g JOIN b ON b.book = g.book AND b.page = g.page WHERE (g.l + g.r) / 2 BETWEEN b.l - 2 AND b.r + 2 AND (g.bo + g.t) / 2 BETWEEN b.bo - 2 AND b.t + 2""")
def q_glyphs_inside(spark, d):
    low, high = (lambda a, b: F.least(f"bbox.{a}", f"bbox.{b}")), (lambda a, b: F.greatest(f"bbox.{a}", f"bbox.{b}"))
    rows = _figures(spark, d)
    glyphs = rows.select(F.col("figure_id").alias("id"), "book", "page", low("l", "r").alias("left"), high("l", "r").alias("right"), low("t", "b").alias("bottom"), high("t", "b").alias("top"))
    boxes = rows.select(F.col("figure_id").alias("box"), "book", "page", low("l", "r").alias("l"), high("l", "r").alias("r"), low("t", "b").alias("b"), high("t", "b").alias("t"))
    return listing.inside(glyphs, boxes).select("id", "box")


@query(f"""SELECT slug AS book, coalesce(lower(trim(domain)) IN ({", ".join(f"'{x}'" for x in listing.LISTING_DOMAINS)}), false) AS listings,
 NOT coalesce(lower(trim(domain)) IN ({", ".join(f"'{x}'" for x in listing.LISTING_DOMAINS)}), false) OR coalesce(lower(trim(domain)) IN ({", ".join(f"'{x}'" for x in listing.FORMULA_DOMAINS)}), false) AS formulas FROM books""")
def q_listing_wanted(spark, d):
    domain = F.col("domain")
    return table(spark, d, "books").select(F.col("slug").alias("book"), listing.wanted(domain).alias("listings"), listing.formulas_wanted(domain).alias("formulas"))


@query(f"WITH {_FIGS} SELECT figure_id, abs(bbox.r - bbox.l) AS width FROM f WHERE coalesce(caption, '') = '' AND abs(bbox.r - bbox.l) <= 80")
def q_decoration(spark, d):
    return figures.decorations(_figures(spark, d))


@query(f"WITH {_FIGS} SELECT chunk_id, figure_id FROM f JOIN chunks c ON c.book = f.book AND f.page BETWEEN c.page_start AND c.page_end")
def q_figures_range(spark, d):
    return figures.in_chunks(_figures(spark, d), table(spark, d, "chunks"))


@query(f"WITH {_FIGS} SELECT figure_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, figure_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM f")
def q_carry_heading(spark, d):
    return figures.carried_heading(_figures(spark, d))


@query(f"""WITH {_FIGS}, c AS (SELECT figure_id, book, page, bbox.l AS l, floor(bbox.t / 2) + i AS ct, floor(bbox.b / 2) + j AS cb FROM f, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
k AS (SELECT book, l, ct, cb FROM c GROUP BY book, l, ct, cb HAVING count(DISTINCT page) >= 2) SELECT DISTINCT figure_id FROM c JOIN k USING (book, l, ct, cb)""")
def q_bands(spark, d):
    return figures.bands(_figures(spark, d), pages=2)


@query(f"""WITH {_FIGS} SELECT figure_id, CAST(greatest(round_even((least(bbox.l, bbox.r) - 6) * 200 / 72, 0), 0) AS INTEGER) AS "left", CAST(greatest(round_even((792 - greatest(bbox.t, bbox.b) - 6) * 200 / 72, 0), 0) AS INTEGER) AS top,
 CAST(greatest(round_even((greatest(bbox.l, bbox.r) + 6) * 200 / 72, 0), 0) AS INTEGER) AS "right", CAST(greatest(round_even((792 - least(bbox.t, bbox.b) + 6) * 200 / 72, 0), 0) AS INTEGER) AS bottom FROM f""")
def q_bbox_pixels(spark, d):
    box = F.struct(F.least("bbox.l", "bbox.r").alias("l"), F.col("bbox.t").alias("t"), F.greatest("bbox.l", "bbox.r").alias("r"), F.col("bbox.b").alias("b"))
    return _figures(spark, d).select("figure_id", T.bbox_to_pixels(box, 792.0).alias("b")).select("figure_id", "b.*")


def _sightings(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("label").cast("string").alias("book"), F.col("vec_id").alias("id"), figures.sign_hash(F.col("embedding")).alias("hash"))


@query("""WITH h AS (SELECT label, vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(list_zip(a.s, b.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS apart
FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.s, b.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 20""")
def q_same_picture(spark, d):
    return figures.same_pictures(_sightings(spark, d), bits=20)


# in page order every picture goes to the first it looks like, or is a first itself
@query("""WITH RECURSIVE h AS (SELECT CAST(label AS VARCHAR) AS book, vec_id AS id, CAST(vec_id % 60 AS INTEGER) AS page, list_transform(embedding, lambda x: x > 0) AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id % 60, vec_id) AS n FROM embeddings),
g AS (SELECT book, id, page, n, [s] AS firsts, 0 AS kind FROM h WHERE n = 1 UNION ALL
 SELECT h.book, h.id, h.page, h.n, CASE WHEN x.at IS NULL THEN list_append(g.firsts, h.s) ELSE g.firsts END, CAST(coalesce(x.at - 1, len(g.firsts)) AS INTEGER)
 FROM g JOIN h ON h.book = g.book AND h.n = g.n + 1, LATERAL (SELECT nullif(list_position(list_transform(g.firsts, lambda f: list_sum(list_transform(list_zip(f, h.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 20), true), 0) AS at) x),
k AS (SELECT book, kind FROM g GROUP BY book, kind HAVING count(DISTINCT page) >= 3 AND max(page) - min(page) >= 20)
SELECT book, id FROM g JOIN k USING (book, kind)""")
def q_repeated_figures(spark, d):
    rows = _sightings(spark, d).withColumn("page", (F.col("id") % 60).cast("int")).withColumn("width", F.lit(10.0)).withColumn("height", F.lit(10.0))
    return figures.repeated(rows, bits=20)


@query(f"""WITH {_FIGS} SELECT figure_id, '![[' || book || '/' || id || '.png]]' || chr(10) || '*' || coalesce(nullif(trim(regexp_replace(caption, '{B}+', ' ', 'g')), ''), 'caption pending') || '*' AS embed FROM f""")
def q_figure_embeds(spark, d):
    return figures.embeds(_figures(spark, d))


_KEY = lambda x: rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_NAME = lambda x: f"coalesce(nullif(regexp_extract(trim(regexp_replace({x}, '{B}+', ' ', 'g')), '{T.SECTION}', 2), ''), trim(regexp_replace({x}, '{B}+', ' ', 'g')))"


@query(f"""WITH {PAGES}, ln AS (SELECT book, page, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY book, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
 FROM (SELECT book, page, string_split(text, chr(10)) AS l FROM pages), LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS pos) u),
k AS (SELECT book, page, off, {_KEY('line')} AS found, regexp_matches(line, '^[ \\t\\r]*#') AS heading, {_KEY(_NAME("regexp_replace(line, '^[ \\t\\r]*#*', '')"))} AS unnumbered FROM ln),
w AS (SELECT DISTINCT span_id AS id, book, page_start AS page, {_KEY('title')} AS wanted, {_KEY(_NAME('title'))} AS name FROM spans WHERE title IS NOT NULL),
r AS (SELECT id, off, CASE WHEN found = wanted AND heading THEN 0 WHEN found = wanted THEN 1 WHEN heading AND length(found) >= 6 AND starts_with(wanted, found) THEN 2 WHEN unnumbered = name THEN 3 END AS rank
 FROM w JOIN k USING (book, page) WHERE found <> '' AND wanted <> '')
SELECT id, CAST(off AS BIGINT) AS "offset", rank FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, off) = 1""")
def q_title_offset(spark, d):
    spans = table(spark, d, "spans").where("title IS NOT NULL").select(F.col("span_id").alias("id"), "book", F.col("page_start").alias("page"), "title").distinct()
    return titles.title_offsets(spans, pages(spark, d))


# pages set in the broken font: a letter of mathematics on every other one, without which nothing is touched
@query(rf"""WITH {PAGES}, v AS (SELECT book, page, translate(text, 'ABCabc123', '{"".join(map(chr, (0xBBA, 0xBBB, 0xBBC, 0xBD4, 0xBD5, 0xBD6, 0xB35, 0xB36, 0xB37)))}') AS broken, text, page % 2 = 0 AS shows FROM pages)
SELECT book, page, md5(CASE WHEN shows THEN text || chr(119909) || '(' ELSE broken END) AS digest FROM v""")
def q_math_font(spark, d):
    broken = F.translate("text", "ABCabc123", "".join(map(chr, (0xBBA, 0xBBB, 0xBBC, 0xBD4, 0xBD5, 0xBD6, 0xB35, 0xB36, 0xB37))))
    shown = F.when(F.col("page") % 2 == 0, F.concat(broken, F.lit(chr(119909) + chr(0x123A)))).otherwise(broken)
    return pages(spark, d).select("book", "page", F.md5(mathfont.restore(shown)).alias("digest"))


_S = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


# every document set as HTML: a heading, and its paragraphs with their signs escaped
@query(rf"""WITH p AS (SELECT doc_id AS id, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT id, n, trim(regexp_replace(raw, '{_S}', ' ', 'g')) AS text FROM p), h AS (SELECT doc_id AS id, 0 AS n, 'Document ' || doc_id AS text FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM s WHERE text <> '')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS pos, CASE WHEN n = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN n = 0 THEN 2 ELSE 0 END AS level, text FROM h""")
def q_html_blocks(spark, d):
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split("text", "\n\n", -1), lambda x: F.concat(F.lit("<p>"), escaped(x))), "")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("<h2>Document "), F.col("doc_id").cast("string"), F.lit("</h2>"), body).alias("html"))
    return html.blocks(rows, "doc_id", "html").drop("anchors")


@query("""SELECT 1 AS box, 'if x:' || chr(10) || '    y = 1' AS text""")
def q_listing_layout(spark, d):
    rows = [("b", 1, 1, c, 10 + 6.0 * x, 100 - 10.0 * y, 16 + 6.0 * x, 108 - 10.0 * y, False) for y, line in enumerate(("if x:", "    y = 1")) for x, c in enumerate(line) if c != " "]
    glyphs = spark.createDataFrame(rows, "book string, page int, box int, text string, left double, bottom double, right double, top double, space_before boolean")
    return listing.layout(glyphs).select("box", "text")


@query()
def q_generate(spark, d):
    from quire.operators.stages import ExtractiveModel, generate, render

    chunks = table(spark, d, "chunks")
    prompt = render("Write a note on {{title}}.\n\n# Source\n\n{{text}}", title=F.col("title"), text=F.col("text"))
    work = chunks.select(F.col("chunk_id").alias("id"), prompt.alias("prompt"), F.col("text").alias("source"))
    return generate(work, ExtractiveModel).select("id", "status", "error", F.size("sections").alias("sections"))

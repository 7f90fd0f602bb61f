"""Queries on notes, verification, the index and the state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import figures, files, notes, stages, state, verify
from quire.session import table
from quire.sources import log
from quire.streaming.queue import status_counts, windowed_table

Q: dict = {}
SQL: dict[str, str] = {}
B = r"[ \t\n\r\f\x{0B}\x{A0}]"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL")


_LN = """ln AS (SELECT doc_id AS id, pos - 1 AS pos, line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
  LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS pos) u),
fl AS (SELECT *, starts_with(regexp_replace(line, '^[ \\t]+', ''), '```') AS fence FROM ln),
fm AS (SELECT *, (sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos)) % 2 = 1 OR fence AS inside FROM fl)
"""


@query(f"""WITH {_LN} SELECT id, CAST(pos AS INTEGER) AS pos, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(regexp_replace(line, '^#+', ''), '{B}+', ' ', 'g')) AS title
FROM fm WHERE NOT inside AND regexp_matches(line, '^#{{1,6}}[ \\t]+[^ \\t]')""")
def q_headings(spark, d):
    return notes.headings(documents(spark, d), "doc_id", "text")


@query(f"WITH {_LN} SELECT id, count(*) FILTER (WHERE fence) AS fences, count(*) FILTER (WHERE inside) AS inside FROM fm GROUP BY id")
def q_inside_fence(spark, d):
    rows = notes.fenced_lines(documents(spark, d), "doc_id", "text")
    return rows.groupBy("id").agg(F.count_if("fence").alias("fences"), F.count_if("inside").alias("inside"))


@query(f"""WITH {_LN}, h AS (SELECT *, NOT inside AND regexp_matches(line, '^#{{1,2}}[ \\t]+[^ \\t]') AS head FROM fm),
s AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS section FROM h)
SELECT id, section, max(CASE WHEN head THEN trim(regexp_replace(regexp_replace(line, '^#+', ''), '{B}+', ' ', 'g')) END) AS title,
 md5(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head), ''), '^{B}+|{B}+$', '', 'g')) AS body FROM s GROUP BY id, section""")
def q_split_sections(spark, d):
    return notes.sections(documents(spark, d), "doc_id", "text").withColumn("body", F.md5("body"))


@query(f"""WITH {_LN}, h AS (SELECT source, id, pos, trim(regexp_replace(regexp_replace(line, '^#+', ''), '{B}+', ' ', 'g')) AS title FROM fm JOIN documents ON doc_id = id WHERE source IS NOT NULL AND NOT inside AND regexp_matches(line, '^#{{1,6}}[ \\t]+[^ \\t]')),
n AS (SELECT *, id * 1000000 + pos AS place, nullif(regexp_extract(title, '{T.SECTION}', 1), '') AS number FROM h),
g AS (SELECT source, number, count(*) AS n, min(place) AS first_place, arg_min(title, place) AS title FROM n WHERE number IS NOT NULL GROUP BY source, number)
SELECT source, number, title FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first_place) = 1""")
def q_running_head(spark, d):
    heads = notes.headings(documents(spark, d), "doc_id", "text").join(documents(spark, d).where("source IS NOT NULL").select(F.col("doc_id").alias("id"), "source"), "id")
    heads = heads.withColumn("pos", F.col("id") * 1000000 + F.col("pos"))
    return notes.running_head(heads, ["source"])


def _pairs(spark, d):
    # a note that lost its lines with a 7, as far as there is one
    note = F.when(F.col("doc_id") % 10 != 3, F.regexp_replace("text", r"(?m)^[^\n]*7[^\n]*$", ""))
    rows = documents(spark, d).withColumn("text", T.unix_lines(F.col("text")))
    return rows.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("chapter"), note.alias("note"), F.col("text").alias("source"))


_SQ = lambda x: f"trim(regexp_replace({x}, '{B}+', ' ', 'g'))"
_CODE = lambda c: f"list_filter(list_transform(flatten(list_transform(regexp_extract_all({c}, '(?ms)^```[^\\n]*\\n(.*?)^```', 1), lambda b: string_split(b, chr(10)))), lambda x: regexp_replace(x, '[ \\t\\r]+$', '')), lambda x: x <> '')"
_CMD = lambda c: f"list_transform({_CODE(c)}, lambda x: " + _SQ("regexp_replace(x, '^[ \\t]*\\$[ \\t]+', '')") + ")"
_INLINE = lambda c: f"list_transform(regexp_extract_all({c}, '`([^`\\n]+)`', 1), lambda x: {_SQ('x')})"
# a cell: commands of mathematics as signs, no dollars and backticks, entities resolved
_SYM = lambda x: f"CASE WHEN contains({x}, '\\') THEN list_aggregate(list_transform(string_split({x}, '\\'), lambda p, k: CASE WHEN k = 1 THEN p WHEN list_contains({[*verify.LATEX]}, regexp_extract(p, '^([A-Za-z]+)', 1)) THEN list_extract({[*verify.LATEX.values()]}, list_position({[*verify.LATEX]}, regexp_extract(p, '^([A-Za-z]+)', 1))) || regexp_replace(p, '^[A-Za-z]+', '') ELSE '\\' || p END), 'string_agg', '') ELSE {x} END"


def _cell(x: str) -> str:
    out = f"regexp_replace({_SYM(x)}, '[`$]', '', 'g')"
    for entity, sign in verify.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return _SQ(f"translate({out}, '{verify.ALIKE[0]}', '{verify.ALIKE[1]}')")


_ROWS = lambda c: (
    f"list_filter(list_transform(list_filter(list_transform(regexp_extract_all({c}, '(?m)^\\|[^\\n]*\\|[ \\t]*$'), lambda r: regexp_replace(r, '[ \\t]+$', '')), lambda r: NOT regexp_matches(r, '^\\|[ \\t:|-]+\\|$')), "
    f"lambda r: regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(r, '^\\||\\|$', '', 'g'), '|'), lambda x: {_cell('x')}), 'string_agg', ' | '), '(?: \\| ?)+$', '')), lambda r: r <> '')"
)
_PAIRS = r"""p AS (SELECT doc_id AS id, coalesce(source, '') AS chapter, CASE WHEN doc_id % 10 <> 3 THEN regexp_replace(text, '(?m)^[^\n]*7[^\n]*$', '', 'g') END AS note, text AS source FROM (SELECT doc_id, source, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL)),
n AS (SELECT id, chapter, note IS NOT NULL AS written, coalesce(note, '') AS note, source FROM p)"""
_LOST = f"""{_PAIRS},
l AS (SELECT *, list_filter({_CMD('source')}, lambda x: x <> '') AS wanted, list_concat(list_concat({_CMD('note')}, {_INLINE('note')}), {_ROWS('note')}) AS have FROM n),
m AS (SELECT *, list_filter(wanted, lambda x: NOT coalesce(list_bool_or(list_transform(have, lambda h: h = x OR (length(x) >= 8 AND contains(h, x)))), false)) AS lost FROM l)
"""


@query(f"WITH {_LOST} SELECT id, len(wanted) AS lines, len(lost) AS lines_lost, list_aggregate(lost, 'min') AS first_lost FROM m")
def q_listing_lost(spark, d):
    note, source = F.coalesce("note", F.lit("")), F.col("source")
    lost = verify.lost_lines(note, source)
    wanted = F.filter(F.transform(verify.code_lines(source), lambda x: T.squeezed_command(x)), lambda x: x != "")
    return _pairs(spark, d).select("id", F.size(wanted).alias("lines"), F.size(lost).alias("lines_lost"), F.array_min(lost).alias("first_lost"))


@query(f"WITH {_PAIRS} SELECT id, len({_ROWS('source')}) AS table_rows, md5(coalesce(list_aggregate({_ROWS('source')}, 'string_agg', chr(10)), '')) AS digest FROM n")
def q_table_rows(spark, d):
    rows = verify.table_rows(F.col("source"))
    return _pairs(spark, d).select("id", F.size(rows).alias("table_rows"), F.md5(F.array_join(rows, "\n")).alias("digest"))


# a row is in order inside a longer one if a pattern of its cells with anything between matches it
_ROWLOST = f"""tr AS (SELECT id, {_ROWS('note')} AS have, list_distinct(list_transform(regexp_extract_all(coalesce(list_aggregate({_CODE('note')}, 'string_agg', chr(10)), ''), '{T.WORD}'), lambda w: lower(w))) AS code, {_ROWS('source')} AS wanted FROM n),
wr AS (SELECT id, have, code, w.pos, w.row, string_split(w.row, ' | ') AS cells, list_filter(string_split(w.row, ' | '), lambda x: x <> '') AS filled, list_transform(regexp_extract_all(w.row, '{T.WORD}'), lambda x: lower(x)) AS words
  FROM tr, LATERAL (SELECT unnest(wanted) AS row, generate_subscripts(wanted, 1) AS pos) w),
lr AS (SELECT id, pos, row FROM wr WHERE NOT list_contains(have, row)
  AND NOT (len(list_filter(words, lambda w: NOT regexp_matches(w, '^[\\p{{N}}]+$'))) >= 2 AND len(list_filter(words, lambda w: NOT list_contains(code, w))) = 0)
  AND NOT ((len(filled) < len(cells) OR len(cells) = 1) AND coalesce(list_bool_or(list_transform(have, lambda h: len(list_filter(string_split(h, ' | '), lambda x: x <> '')) > len(filled)
    AND regexp_matches(' | ' || list_aggregate(list_filter(string_split(h, ' | '), lambda x: x <> ''), 'string_agg', ' | ') || ' | ', ' \\| ' || list_aggregate(list_transform(filled, lambda x: regexp_escape(x)), 'string_agg', ' \\| (?:.* \\| )?') || ' \\| '))), false)))"""


@query(f"WITH {_PAIRS}, {_ROWLOST} SELECT id, row FROM lr")
def q_table_lost(spark, d):
    return _pairs(spark, d).select("id", F.explode(verify.lost_rows(F.coalesce("note", F.lit("")), F.col("source"))).alias("row"))


_DIG = "list_filter(regexp_extract_all({c}, '\\b[0-9a-f]{{32}}\\b'), lambda x: regexp_matches(x, '[a-f]') AND regexp_matches(x, '[0-9]'))"
_REPORT = f"""{_LOST}, {_ROWLOST},
q AS (SELECT id, chapter, written, len(wanted) AS lines, len(lost) AS lines_lost, len(list_filter({_CODE('source')}, lambda c: list_contains({_CODE('note')}, c))) AS lines_exact, len({_ROWS('source')}) AS rows,
 (SELECT count(*) FROM lr WHERE lr.id = m.id) AS rows_lost, list_aggregate(list_filter(regexp_extract_all(note, '{T.MAIL}'), lambda x: NOT list_contains(regexp_extract_all(source, '{T.MAIL}'), x)), 'min') AS stray_mail,
 len(list_filter({_DIG.format(c='note')}, lambda x: NOT list_contains({_DIG.format(c='source')}, x))) > 0 AS stray_digest, len(regexp_extract_all(note, '{T.WORD}')) AS note_words, len(regexp_extract_all(source, '{T.WORD}')) AS source_words FROM m),
r AS (SELECT *, list_filter([CASE WHEN written AND lines > 0 AND lines_lost > 0.1 * lines + 1e-9 THEN 'lines' END, CASE WHEN written AND rows > 0 AND rows_lost > 0.1 * rows + 1e-9 THEN 'rows' END, CASE WHEN written AND stray_mail IS NOT NULL THEN 'mail' END,
 CASE WHEN written AND stray_digest THEN 'digest' END, CASE WHEN written AND source_words > 0 AND note_words < 0.1 * source_words THEN 'short' END, CASE WHEN NOT written THEN 'unwritten' END], lambda x: x IS NOT NULL) AS problems FROM q)
"""


@query(f"WITH {_REPORT} SELECT * FROM r")
def q_verify_report(spark, d):
    return verify.report(_pairs(spark, d))


_MAIL = T.MAIL


@query(rf"""WITH {_PAIRS}, w AS (SELECT id, len(regexp_extract_all(note, '{T.WORD}')) AS a, len(regexp_extract_all(source, '{T.WORD}')) AS b FROM n)
SELECT id, a AS note_words, b AS source_words, b > 0 AND a < 0.1 * b AS short FROM w""")
def q_word_share(spark, d):
    rows = _pairs(spark, d).select("id", F.size(T.words(F.coalesce("note", F.lit("")))).alias("note_words"), F.size(T.words(F.col("source"))).alias("source_words"))
    return rows.withColumn("short", (F.col("source_words") > 0) & (F.col("note_words") < 0.1 * F.col("source_words")))


@query(rf"""WITH {_PAIRS} SELECT id, list_aggregate(list_filter(regexp_extract_all(source, '{_MAIL}'), lambda m: NOT list_contains(regexp_extract_all(note, '{_MAIL}'), m)), 'min') AS lost FROM n""")
def q_mail_anti(spark, d):
    mails = lambda c: F.regexp_extract_all(c, F.lit(T.MAIL), 0)
    return _pairs(spark, d).select("id", F.array_min(F.array_except(mails(F.col("source")), mails(F.coalesce("note", F.lit(""))))).alias("lost"))


@query(f"""WITH {_REPORT}
SELECT chapter, count(*) AS notes, count(*) FILTER (WHERE written) AS written, CAST(coalesce(sum(lines) FILTER (WHERE written), 0) AS BIGINT) AS lines, CAST(coalesce(sum(lines - lines_lost) FILTER (WHERE written), 0) AS BIGINT) AS lines_found,
 CAST(coalesce(sum(lines_exact) FILTER (WHERE written), 0) AS BIGINT) AS lines_exact, CAST(coalesce(sum(rows) FILTER (WHERE written), 0) AS BIGINT) AS rows, CAST(coalesce(sum(rows - rows_lost) FILTER (WHERE written), 0) AS BIGINT) AS rows_found,
 count(*) FILTER (WHERE written AND len(problems) > 0) AS flagged FROM r GROUP BY chapter""")
def q_verify_summary(spark, d):
    return verify.summary(verify.report(_pairs(spark, d)))


_G = notes.GLOSSARY
_ENTRIES = f"""g AS (SELECT doc_id AS id, pos - 1 AS pos, {_SQ('term')} AS term, {_SQ('translation')} AS translation FROM
 (SELECT doc_id, regexp_extract_all(text, '{_G}', 1) AS ts, regexp_extract_all(text, '{_G}', 2) AS xs FROM documents WHERE text IS NOT NULL),
 LATERAL (SELECT unnest(ts) AS term, unnest(xs) AS translation, generate_subscripts(ts, 1) AS pos) u)"""


@query(f"WITH {_ENTRIES} SELECT id, CAST(pos AS INTEGER) AS pos, term, translation FROM g")
def q_glossary_entries(spark, d):
    return notes.glossary_entries(documents(spark, d), "doc_id", "text")


@query(f"WITH {_ENTRIES} SELECT arg_min(term, (id, pos)) AS term, arg_min(translation, (id, pos)) AS translation, count(DISTINCT id) AS uses, list_sort(list_distinct(list(id))) AS sources FROM g GROUP BY lower(term)")
def q_glossary_merge(spark, d):
    return notes.merge_glossary(notes.glossary_entries(documents(spark, d), "doc_id", "text"))


def _notes(spark, d):
    rows = table(spark, d, "chunks").where("text <> ''")
    return rows.select("book", F.col("chunk_id").alias("id"), "ord", "chapter", notes.note_stem(F.col("section"), F.coalesce("title", F.lit(""))).alias("stem"))


_STEM = f"""st AS (SELECT book, chunk_id AS id, ord, chapter, section, title, page_start, page_end, list_aggregate(list_transform(string_split(section, '.'), lambda x: CASE WHEN length(x) < 2 THEN lpad(x, 2, '0') ELSE x END), 'string_agg', '.') AS padded,
 {_SQ("coalesce(title, '')")} AS t FROM chunks WHERE text <> ''),
s AS (SELECT *, {_SQ("regexp_replace(regexp_replace(concat_ws(' ', padded, coalesce(nullif(regexp_extract(t, '" + T.SECTION + "', 2), ''), t)), ' *[/\\\\|] *', ' - ', 'g'), '[<>:" + '"' + "?*#^\\[\\]]', '', 'g')")} AS stem FROM st)"""


@query(f"WITH {_STEM} SELECT id, stem FROM s")
def q_note_stem(spark, d):
    return _notes(spark, d).select("id", "stem")


@query(f"""WITH {_STEM}, n AS (SELECT id, '← [[' || lag(stem) OVER w || ']]' AS a, '[[' || lead(stem) OVER w || ']] →' AS b FROM s WINDOW w AS (PARTITION BY book ORDER BY ord, id))
SELECT id, nullif(concat_ws(' · ', a, b), '') AS footer FROM n""")
def q_nav(spark, d):
    return notes.navigation(_notes(spark, d))


@query(f"WITH {_STEM} SELECT book, chapter, CAST(count(*) AS INTEGER) AS notes, string_agg('- [[' || stem || ']]', chr(10) ORDER BY ord, id) AS links FROM s WHERE chapter > 0 GROUP BY book, chapter")
def q_chapter_map(spark, d):
    return notes.chapter_map(_notes(spark, d))


@query("""SELECT chunk_id, concat_ws(chr(10), '---', 'source: ' || book, 'chapter: ' || coalesce(CAST(chapter AS VARCHAR), ''), 'section: ' || section, format('pages: [{}, {}]', page_start, page_end), 'generator: quire', '---') AS header FROM chunks""")
def q_frontmatter(spark, d):
    c = F.col
    return table(spark, d, "chunks").select("chunk_id", notes.front_matter(c("book"), c("chapter"), c("section"), c("page_start"), c("page_end")).alias("header"))


# a note of every document: its first paragraph in short, the rest explained
@query(f"""WITH v AS (SELECT doc_id AS id, lower(coalesce(lang, 'en')) AS language, split_part(text, chr(10) || chr(10), 1) AS brief, substring(text, length(split_part(text, chr(10) || chr(10), 1)) + 1) AS body FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, language, regexp_replace(brief, '^{B}+|{B}+$', '', 'g') AS brief, regexp_replace(body, '^{B}+|{B}+$', '', 'g') AS body FROM v)
SELECT id, md5(concat_ws(chr(10) || chr(10), '# Title', coalesce(concat_ws(chr(10) || chr(10),
 CASE WHEN brief <> '' THEN '## ' || CASE language WHEN 'pl' THEN 'W skrócie' ELSE 'In short' END || chr(10) || chr(10) || brief END,
 CASE WHEN body <> '' THEN '## ' || CASE language WHEN 'pl' THEN 'Wyjaśnienie' ELSE 'Explanation' END || chr(10) || chr(10) || body END), ''))) AS note,
 CAST((brief = '') AS INTEGER) + CAST((body = '') AS INTEGER) AS missing FROM w""")
def q_note_assemble(spark, d):
    brief = F.split("text", "\n\n", 2)[0]
    body = F.substring(F.col("text"), F.length(brief) + 1, F.length("text"))
    parts = F.create_map(F.lit("In short"), brief, F.lit("Explanation"), body)
    rows = documents(spark, d)
    return rows.select(F.col("doc_id").alias("id"), F.md5(notes.assemble(F.lit("Title"), parts, F.lower(F.coalesce("lang", F.lit("en"))))).alias("note"), F.size(notes.missing_sections(parts)).alias("missing"))


# ---------------------------------------------------------------- files

_TWO = lambda x: f"CASE WHEN length(CAST({x} AS VARCHAR)) < 2 THEN lpad(CAST({x} AS VARCHAR), 2, '0') ELSE CAST({x} AS VARCHAR) END"
_STRIP = lambda x: f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"
_SLUG = lambda x: f"coalesce(nullif(regexp_replace(regexp_replace(translate(lower({x}), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"
_SAFE = lambda x: _SQ(f"regexp_replace(regexp_replace({x}, ' *[/\\\\|] *', ' - ', 'g'), '[<>:" + '"' + "?*#^\\[\\]]', '', 'g')")
_PLACED = f"""ct AS (SELECT book, chapter, coalesce(arg_min(coalesce(title, ''), ord) FILTER (WHERE section = CAST(chapter AS VARCHAR)), '') AS ct FROM chunks WHERE chapter IS NOT NULL GROUP BY book, chapter),
bk AS (SELECT slug AS book, any_value(title) AS book_title, any_value(domain) AS domain, any_value(language) AS language FROM books GROUP BY slug),
pl AS (SELECT c.*, bk.book_title, bk.domain, bk.language, ct.ct, CASE WHEN c.chapter IS NULL THEN '00-unsorted' ELSE {_TWO('c.chapter')} || CASE WHEN {_STRIP('ct.ct')} <> '' THEN '-' || {_SLUG('ct.ct')} ELSE '' END END AS folder,
 {_SAFE("concat_ws(' ', list_aggregate(list_transform(string_split(c.section, '.'), lambda x: CASE WHEN length(x) < 2 THEN lpad(x, 2, '0') ELSE x END), 'string_agg', '.'), coalesce(nullif(regexp_extract(" + _SQ("coalesce(c.title, '')") + ", '" + T.SECTION + "', 2), ''), " + _SQ("coalesce(c.title, '')") + "))")} AS stem
 FROM chunks c LEFT JOIN bk USING (book) LEFT JOIN ct ON ct.book = c.book AND ct.chapter = c.chapter)"""
_TAGS = lambda last: f"'tags: [' || {_SLUG(chr(99) + 'oalesce(domain, ' + chr(39) + 'general' + chr(39) + ')')} || ', ' || book || ', ' || {last} || ']'"


@query(f"WITH {_PLACED} SELECT book, chunk_id, folder || '/' || stem || '.md' AS path FROM pl")
def q_note_paths(spark, d):
    return files.note_paths(table(spark, d, "chunks"), table(spark, d, "books"))


@query(f"""WITH {_PLACED}, fg AS (SELECT DISTINCT ON (figure_id) * FROM figures),
fl AS (SELECT c.chunk_id, string_agg('![' || split_part(path, '/', -1) || '](../figures/' || split_part(path, '/', -1) || ')' || chr(10) || '*' || coalesce(nullif(caption, ''), id) || '*', chr(10) || chr(10) ORDER BY page, figure_id) AS figures
  FROM fg f JOIN chunks c ON c.book = f.book AND f.page BETWEEN c.page_start AND c.page_end GROUP BY c.chunk_id)
SELECT book, chunk_id, '_source/' || book || '/' || folder || '/' || stem || '.md' AS path, md5(concat_ws(chr(10) || chr(10), concat_ws(chr(10), '---', 'source: "' || coalesce(book_title, '') || '"', 'chapter: ' || coalesce(CAST(chapter AS VARCHAR), 'null'), 'section: "' || coalesce(section, '') || '"',
 format('pages: [{{}}, {{}}]', page_start, page_end), 'stage: export', 'generator: quire', {_TAGS("'chapter-' || coalesce(" + _TWO('chapter') + ", 'na')")}, '---'), {_STRIP("'# ' || concat_ws(' ', section, title)")},
 '## Figures' || chr(10) || chr(10) || figures, '## Source text' || chr(10) || chr(10) || {_STRIP("coalesce(text, '')")}) || chr(10)) AS digest FROM pl LEFT JOIN fl USING (chunk_id)""")
def q_export(spark, d):
    made = files.export_files(table(spark, d, "chunks"), figures.distinct_figures(table(spark, d, "figures")), table(spark, d, "books"))
    return made.withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")


_W = lambda name: f"CASE WHEN language = 'pl' THEN '{files.WORDS['pl'][name]}' ELSE '{files.WORDS['en'][name]}' END"


@query(f"""WITH {_PLACED}, mp AS (SELECT book, chapter, ct, folder, book_title, domain, language, string_agg('- [[' || stem || ']] — ' || {_W('pages')} || ' ' || page_start || '-' || page_end, chr(10) ORDER BY ord, chunk_id) AS lines FROM pl WHERE chapter > 0 GROUP BY ALL),
nm AS (SELECT *, concat_ws(' ', {_TWO('chapter')}, nullif(ct, '')) AS named FROM mp)
SELECT book, chapter, folder || '/' || {_SAFE("named || ' — ' || " + _W('map'))} || '.md' AS path, concat_ws(chr(10), '---', 'source: "' || coalesce(book_title, '') || '"', 'chapter: ' || chapter, 'type: moc', 'generator: quire', {_TAGS("'chapter-' || " + _TWO('chapter'))}, '---')
 || chr(10) || chr(10) || {_STRIP("'# ' || named")} || chr(10) || chr(10) || {_W('order')} || chr(10) || chr(10) || lines || chr(10) || chr(10) || '---' || chr(10) || '[[_Glossary]]' || chr(10) AS text,
 EXISTS (SELECT 1 FROM pl WHERE pl.book = nm.book AND pl.folder || '/' || pl.stem || '.md' = nm.folder || '/' || {_SAFE("nm.named || ' — ' || " + _W('map').replace('language', 'nm.language'))} || '.md') AS clash FROM nm""")
def q_index_files(spark, d):
    return files.chapter_maps(table(spark, d, "chunks"), table(spark, d, "books"))


@query(f"""WITH {_ENTRIES}, e AS (SELECT coalesce(source, '') AS book, 'note ' || id AS id, pos, term, translation FROM g JOIN documents ON doc_id = g.id),
m AS (SELECT book, lower(term) AS key, arg_min(term, (id, pos)) AS term, arg_min(translation, (id, pos)) AS translation, list_sort(list_distinct(list('[[' || id || ']]'))) AS links FROM e GROUP BY book, lower(term)),
bk AS (SELECT slug AS book, any_value(title) AS book_title, any_value(domain) AS domain, any_value(language) AS language FROM books GROUP BY slug),
t AS (SELECT book, string_agg('- **' || term || '** — ' || translation || '  ' || list_aggregate(links, 'string_agg', ' '), chr(10) ORDER BY key) AS lines FROM m GROUP BY book)
SELECT book, '{files.GLOSSARY_FILE}' AS path, md5(concat_ws(chr(10), '---', 'source: "' || coalesce(book_title, '') || '"', 'type: glossary', 'generator: quire', {_TAGS("'glossary'")}, '---', '# ' || {_W('glossary')}, '', lines) || chr(10)) AS digest FROM t LEFT JOIN bk USING (book)""")
def q_glossary_files(spark, d):
    of = documents(spark, d).select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("book"))
    entries = notes.glossary_entries(documents(spark, d), "doc_id", "text").join(of, "id").withColumn("id", F.concat(F.lit("note "), F.col("id").cast("string")))
    return files.glossary_files(entries, table(spark, d, "books")).withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")


# ---------------------------------------------------------------- state

_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'stopped' END"
_EV = f"ev AS (SELECT user_id, event_id AS id, ts, {_STATUS} AS status, value > 20 AS stop FROM events)"
_LAST = "last AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1)"


def _events(spark, d):
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.expr(_STATUS).alias("status"), (F.col("value") > 20).alias("stop"))


@query(f"WITH {_EV}, {_LAST} SELECT user_id, id, status, stop FROM last")
def q_latest_state(spark, d):
    return state.latest(_events(spark, d), ["user_id"]).select("user_id", "id", "status", "stop")


@query(f"WITH {_EV}, {_LAST} SELECT DISTINCT user_id FROM ev WHERE user_id NOT IN (SELECT user_id FROM last WHERE status = 'done')")
def q_todo(spark, d):
    events = _events(spark, d)
    return state.todo(events.select("user_id").distinct(), events, ["user_id"])


@query(f"WITH {_EV}, {_LAST} SELECT id, user_id FROM last WHERE status = 'queued' ORDER BY id LIMIT 1")
def q_claim_next(spark, d):
    return state.claim_next(state.latest(_events(spark, d), ["user_id"])).select("id", "user_id")


@query(f"""WITH {_EV}, q AS (SELECT *, max(CASE WHEN status = 'queued' THEN (ts, id) END) OVER (PARTITION BY user_id) AS queued FROM ev)
SELECT user_id, arg_min(id, (ts, id)) AS id FROM q WHERE status = 'running' AND (ts, id) > queued GROUP BY user_id""")
def q_claim(spark, d):
    return state.claims(_events(spark, d), ["user_id"]).select("user_id", "id")


@query(f"""WITH {_EV}, k AS (SELECT user_id, arg_max(status, (ts, id)) AS status, max(CASE WHEN status = 'running' THEN (ts, id) END) AS s, max(CASE WHEN status IN ('done', 'failed', 'stopped') THEN (ts, id) END) AS e FROM ev GROUP BY user_id)
SELECT user_id, status, s[1] AS started, CASE WHEN e IS NOT NULL AND (s IS NULL OR e > s) THEN e[1] END AS finished, CASE WHEN e IS NOT NULL AND (s IS NULL OR e > s) THEN (SELECT CASE WHEN ev.status = 'failed' THEN 'error ' || ev.id END FROM ev WHERE ev.id = e[2]) END AS error FROM k""")
def q_stage_events(spark, d):
    error = F.when(F.col("status") == state.FAILED, F.concat(F.lit("error "), F.col("id").cast("string")))
    return state.stage_runs(_events(spark, d).withColumn("error", error), ["user_id"])


@query(f"WITH {_EV} SELECT id, user_id, status FROM ev ORDER BY id DESC LIMIT 20")
def q_recent_jobs(spark, d):
    return state.recent(_events(spark, d)).select("id", "user_id", "status")


@query(f"WITH {_EV}, {_LAST} SELECT id, CASE WHEN status = 'running' AND stop THEN 'stopped' WHEN status = 'running' THEN 'queued' ELSE status END AS status FROM last")
def q_stop_reset(spark, d):
    return state.recovered(state.latest(_events(spark, d), ["user_id"])).select("id", "status")


@query(f"WITH {_EV}, {_LAST} SELECT id, CASE WHEN status = 'queued' THEN 'stopped' ELSE status END AS status, stop OR status IN ('queued', 'running') AS stop FROM last")
def q_stop_all(spark, d):
    return state.stop_requested(state.latest(_events(spark, d), ["user_id"])).select("id", "status", "stop")


@query(f"WITH {_EV}, {_LAST} SELECT id, status FROM last WHERE status NOT IN ('done', 'failed', 'stopped')")
def q_clear_finished(spark, d):
    return state.unfinished(state.latest(_events(spark, d), ["user_id"])).select("id", "status")


@query("""WITH j AS (SELECT user_id AS id, min(ts) AS started, max(ts) AS now, count(*) FILTER (WHERE event_type = 'view') AS done, count(*) AS total FROM events GROUP BY user_id)
SELECT id, CASE WHEN done > 0 THEN CAST(ceil((CAST(floor(epoch(now)) AS BIGINT) - CAST(floor(epoch(started)) AS BIGINT)) / done * (total - done) / 60) AS BIGINT) END AS minutes FROM j""")
def q_eta(spark, d):
    jobs = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("now"), F.count_if(F.col("event_type") == "view").alias("done"), F.count("*").alias("total")
    )
    return state.eta_minutes(jobs)


@query("""SELECT strftime(ts, '%H:%M:%S') || ' ' || event_type || ' event ' || event_id || CASE WHEN event_id % 2 = 0 THEN ' user=' || user_id ELSE '' END AS line FROM events ORDER BY ts DESC, event_id DESC LIMIT 60""")
def q_log_tail(spark, d):
    extra = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    message = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    events = table(spark, d, "events").select("ts", "event_id", F.col("event_type").alias("stage"), message.alias("message"), extra.alias("extra"), F.lit(None).cast("string").alias("_corrupt"))
    return log.tail(events, order=("event_id",))


@query("""SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS events FROM events GROUP BY ALL""")
def q_windowed_counts(spark, d):
    return windowed_table(spark, d, "events.parquet")


# formulas in brackets around every glossary term, and its listings left as they are
@query("""SELECT doc_id, md5(text || ' $x_1$ and' || chr(10) || '$$a' || chr(10) || '+ b$$') AS digest FROM documents WHERE text IS NOT NULL AND NOT contains(text, '\\(') AND NOT contains(text, '\\[')""")
def q_normalise_math(spark, d):
    rows = documents(spark, d).where(~F.contains("text", F.lit("\\(")) & ~F.contains("text", F.lit("\\[")))
    return rows.select("doc_id", F.md5(T.normalise_math(F.concat("text", F.lit(" \\( x_1 \\) and\n\\[ a\n+ b \\]")))).alias("digest"))


# what a model is shown of a chunk beside a figure: 1200 characters round its caption, else the beginning
@query("""WITH f AS (SELECT DISTINCT ON (figure_id) * FROM figures), m AS (SELECT chunk_id, figure_id, text, CASE WHEN length(caption) > 0 THEN instr(text, substring(caption, 1, 40)) ELSE 0 END AS place FROM f JOIN chunks c ON c.book = f.book AND f.page BETWEEN c.page_start AND c.page_end)
SELECT chunk_id, figure_id, md5(substring(text, CASE WHEN place > 0 THEN greatest(place - 600, 1) ELSE 1 END, 1200)) AS digest FROM m""")
def q_figure_context(spark, d):
    drawn, chunks = figures.distinct_figures(table(spark, d, "figures")), table(spark, d, "chunks")
    held = figures.in_chunks(drawn, chunks).join(drawn.select("figure_id", "caption"), "figure_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return held.select("chunk_id", "figure_id", F.md5(stages.context_for(F.col("text"), F.col("caption"))).alias("digest"))


# the embed of every figure with a description put in place of its caption line, and then another one
@query(f"""WITH f AS (SELECT DISTINCT ON (figure_id) * FROM figures) SELECT figure_id, '![[' || book || '/' || id || '.png]]' || chr(10) || '*costs $' || figure_id || ' or \\*' AS note FROM f""")
def q_insert_description(spark, d):
    held = figures.embeds(figures.distinct_figures(table(spark, d, "figures")).withColumn("caption", F.lit("a caption"))).join(figures.distinct_figures(table(spark, d, "figures")).select("figure_id", "id"), "figure_id")
    file = F.concat("id", F.lit(".png"))
    first = stages.insert_description(F.col("embed"), file, F.lit("first"))
    return held.select("figure_id", stages.insert_description(first, file, F.concat(F.lit("costs $"), F.col("figure_id").cast("string"), F.lit("  or \\"))).alias("note"))


@query(f"""WITH {_EV}, {_LAST}, n AS (SELECT user_id, min(ts) AS started, max(ts) AS now, count(*) FILTER (WHERE status = 'done') AS done, count(*) AS total FROM ev GROUP BY user_id),
j AS (SELECT last.*, n.started, n.done, n.total, n.now FROM last JOIN n USING (user_id) ORDER BY id DESC LIMIT 20)
SELECT id, 'stage' AS stage, CASE WHEN status = 'running' AND stop THEN 'stopping' ELSE status END AS status, done || '/' || total AS done,
 CASE WHEN status = 'running' AND done > 0 THEN CAST(ceil((CAST(floor(epoch(now)) AS BIGINT) - CAST(floor(epoch(started)) AS BIGINT)) / done * (total - done) / 60) AS BIGINT) END AS minutes, 'model' AS model, CASE WHEN status = 'failed' THEN 'error ' || id ELSE '' END AS error FROM j""")
def q_job_table(spark, d):
    events = _events(spark, d)
    told = events.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("now"), F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))
    jobs = state.latest(events, ["user_id"]).join(told, "user_id")
    error = F.when(F.col("status") == "failed", F.concat(F.lit("error "), F.col("id").cast("string")))
    return state.job_table(jobs.withColumn("stage", F.lit("stage")).withColumn("model", F.lit("model")).withColumn("error", error))


@query(f"WITH {_EV}, {_LAST} SELECT id, user_id FROM last WHERE status <> 'done' AND NOT starts_with(status, 'stop')")
def q_without_stage(spark, d):
    runs = state.latest(_events(spark, d), ["user_id"]).withColumn("stage", F.when(F.col("status").startswith("stop"), F.concat(F.lit("done:"), "status")).otherwise(F.col("status")))
    return state.without_stage(runs, "done").select("id", "user_id")


@query("SELECT event_type AS status, count(*) AS events, max(event_id) AS last_id FROM events GROUP BY event_type")
def q_stream_state(spark, d):
    return status_counts(spark, d, "events.parquet")


_RUNS = """r AS (SELECT DISTINCT book, first_page, last_page, device, run_id AS id, started, finished, figure_count, ocr_pages, last_heading FROM extract_results),
w AS (SELECT book, first_page, last_page, arg_max({'d': device}, (started, id)) AS wanted FROM r WHERE started IS NOT NULL GROUP BY ALL),
d AS (SELECT * FROM r WHERE finished IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book, first_page, last_page ORDER BY finished DESC, id DESC) = 1)"""


def _runs(spark, d):
    return table(spark, d, "extract_results").select("book", "first_page", "last_page", "device", F.col("run_id").alias("id"), "started", "finished", "figure_count", "ocr_pages", "last_heading").distinct()


@query(f"WITH {_RUNS} SELECT d.book, d.first_page, d.last_page, d.id AS run_id, d.figure_count FROM d JOIN w USING (book, first_page, last_page) WHERE d.device IS NOT DISTINCT FROM wanted.d")
def q_reusable_batch(spark, d):
    return state.reusable(_runs(spark, d), ["book", "first_page", "last_page"], ["device"]).select("book", "first_page", "last_page", F.col("id").alias("run_id"), "figure_count")


@query(f"""WITH {_RUNS}, u AS (SELECT *, coalesce(last_value(last_heading IGNORE NULLS) OVER (PARTITION BY book ORDER BY first_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS under FROM d)
SELECT book, count(*) AS batches, CAST(sum(figure_count) AS BIGINT) AS figures, list_sort(list_distinct(flatten(list(coalesce(ocr_pages, []))))) AS ocr_pages, list(under ORDER BY first_page) AS headings FROM u GROUP BY book""")
def q_merged_batches(spark, d):
    runs = state.latest(_runs(spark, d).where("finished IS NOT NULL").withColumn("ts", F.col("finished")), ["book", "first_page", "last_page"])
    return state.merged(runs.withColumn("ocr_pages", F.coalesce("ocr_pages", F.array().cast("array<int>"))), "book")


# documents with a chapter that begins late
@query(f"""WITH l AS (SELECT doc_id AS id, u.pos, u.line FROM (SELECT doc_id, string_split(regexp_replace(text || chr(10) || '# ' || doc_id % 7 || ' Late' || chr(10) || 'End', '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u),
t AS (SELECT *, {_SQ("regexp_extract(line, '^#{1,6}[ " + chr(92) + "t]+([^" + chr(92) + "n]*)$', 1)")} AS title FROM l),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]+[^ \\t]') AND regexp_matches(title, '{T.CHAPTER_NUMBER}') AND NOT regexp_matches(title, '{T.CHAPTER_SECTION}') AS head FROM t),
p AS (SELECT *, CAST(sum(CAST(head AS INTEGER)) OVER (PARTITION BY id ORDER BY pos) AS INTEGER) AS part FROM h),
b AS (SELECT id, part, coalesce(max(CASE WHEN head THEN title END), '') AS title, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^{B}+|{B}+$', '', 'g') AS body FROM p GROUP BY id, part)
SELECT id, part, title, md5(body) AS body FROM b WHERE (part > 0 OR body <> '') AND id IN (SELECT id FROM b WHERE part > 0)""")
def q_split_chapters(spark, d):
    late = F.concat("text", F.lit("\n# "), (F.col("doc_id") % 7).cast("string"), F.lit(" Late\nEnd"))
    return notes.chapters(documents(spark, d).withColumn("text", late), "doc_id", "text").withColumn("body", F.md5("body"))


# every third chunk's note had a footer already
@query(f"""WITH {_STEM}, n AS (SELECT id, '← [[' || lag(stem) OVER w || ']]' AS a, '[[' || lead(stem) OVER w || ']] →' AS b FROM s WINDOW w AS (PARTITION BY book ORDER BY ord, id)), f AS (SELECT id, nullif(concat_ws(' · ', a, b), '') AS footer FROM n)
SELECT id, md5('Note ' || id || CASE WHEN footer IS NULL THEN chr(10) ELSE chr(10) || chr(10) || '---' || chr(10) || footer || chr(10) END) AS digest FROM f""")
def q_apply_nav(spark, d):
    held = _notes(spark, d).select("id").join(notes.navigation(_notes(spark, d)), "id")
    old = F.concat(F.lit("Note "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, F.lit("\n\n---\n← [[an old one]]\n")).otherwise(""))
    once = notes.apply_navigation(old, F.col("footer"))
    return held.select("id", F.md5(notes.apply_navigation(once, F.col("footer"))).alias("digest"))


# a note of every chunk: its first 80 characters in short, all of it explained
@query(f"""WITH {_PLACED}, fg AS (SELECT DISTINCT ON (figure_id) * FROM figures),
fl AS (SELECT c.chunk_id, string_agg('![[attachments/' || f.book || '/' || split_part(path, '/', -1) || ']]' || chr(10) || '*' || coalesce(nullif(caption, ''), id) || ' — description pending.*', chr(10) || chr(10) ORDER BY page, figure_id) AS figures
  FROM fg f JOIN chunks c ON c.book = f.book AND f.page BETWEEN c.page_start AND c.page_end GROUP BY c.chunk_id),
v AS (SELECT *, {_STRIP('substring(text, 1, 80)')} AS brief, {_STRIP('text')} AS whole, {_STRIP('figures')} AS shown FROM pl LEFT JOIN fl USING (chunk_id) WHERE text IS NOT NULL)
SELECT book, chunk_id, folder || '/' || stem || '.md' AS path, md5(concat_ws(chr(10) || chr(10), concat_ws(chr(10), '---', 'source: "' || coalesce(book_title, '') || '"', 'chapter: ' || coalesce(CAST(chapter AS VARCHAR), 'null'), 'section: "' || coalesce(section, '') || '"',
 format('pages: [{{}}, {{}}]', page_start, page_end), 'model: none', 'generated: 2024-01-02', 'generator: quire', {_TAGS("'chapter-' || coalesce(" + _TWO('chapter') + ", 'na')")}, '---'), {_STRIP("'# ' || concat_ws(' ', section, title)")},
 CASE WHEN len(parts) > 0 THEN '*' || {_W('sections')} || ': ' || list_aggregate(parts, 'string_agg', ' · ') || '*' END,
 CASE WHEN brief <> '' THEN '## ' || CASE WHEN language = 'pl' THEN 'W skrócie' ELSE 'In short' END || chr(10) || chr(10) || brief END, CASE WHEN whole <> '' THEN '## ' || CASE WHEN language = 'pl' THEN 'Wyjaśnienie' ELSE 'Explanation' END || chr(10) || chr(10) || whole END,
 CASE WHEN shown <> '' THEN '## ' || CASE WHEN language = 'pl' THEN 'Rysunki' ELSE 'Figures' END || chr(10) || chr(10) || shown END) || chr(10)) AS digest FROM v""")
def q_note_files(spark, d):
    chunks = table(spark, d, "chunks").withColumn("sections", F.when(F.col("text").isNotNull(), F.create_map(F.lit("In short"), F.substring("text", 1, 80), F.lit("Explanation"), F.col("text"))))
    made = files.note_files(chunks, figures.distinct_figures(table(spark, d, "figures")), table(spark, d, "books"), "none", F.lit("2024-01-02").cast("date"))
    return made.withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")

"""Notes: sections, assembly, navigation, chapter maps and the glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Headings of a note by language, in the order of a note.
HEADINGS = {
    "en": ("In short", "Explanation", "Code", "Formulas", "Figures", "Glossary", "Pitfalls", "Exercises"),
    "pl": ("W skrócie", "Wyjaśnienie", "Kod", "Wzory", "Rysunki", "Słowniczek", "Pułapki", "Ćwiczenia"),
}
GLOSSARY = r"(?m)^[-*] \*\*([^\n]+?)\*\* [–—-] ([^\n]+?) [—–-] "


def fenced_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line, fence, inside): lines with the state of the fence; a
    line that opens or closes one counts as a fence line."""
    cut = F.posexplode(F.split(T.unix_lines(F.col(text_col)), "\n", -1)).alias("pos", "line")
    rows = docs.select(F.col(id_col).alias("id"), cut)
    over = Window.partitionBy("id").orderBy("pos")
    fence = F.regexp_replace("line", "^[ \t]+", "").startswith("```")
    marks = F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(over)
    return rows.withColumn("fence", fence).withColumn("marks", marks).withColumn("inside", (F.col("marks") % 2 == 1) | F.col("fence")).drop("marks")


def headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, level, title) of headings outside listings."""
    rows = fenced_lines(docs, id_col, text_col).where(~F.col("inside") & F.col("line").rlike(r"^#{1,6}[ \t]+[^ \t]"))
    mark = F.regexp_extract("line", "^(#+)", 1)
    return rows.select("id", "pos", F.length(mark).alias("level"), T.squeeze(F.regexp_replace("line", "^#+", "")).alias("title"))


def sections(docs: DataFrame, id_col: str, text_col: str, level: int = 2) -> DataFrame:
    """(id, section, title, body): the text after each heading up to ``level``,
    outside listings; what comes before the first has section 0 and no title."""
    rows = fenced_lines(docs, id_col, text_col)
    head = ~F.col("inside") & F.col("line").rlike(rf"^#{{1,{level}}}[ \t]+[^ \t]")
    over = Window.partitionBy("id").orderBy("pos")
    held = rows.withColumn("head", head).withColumn("section", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(over))
    title = F.max(F.when(F.col("head"), T.squeeze(F.regexp_replace("line", "^#+", "")))).alias("title")
    body = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    grouped = held.groupBy("id", "section").agg(title, body.alias("b"))
    return grouped.select("id", "section", "title", T.strip(F.array_join("b.line", "\n")).alias("body"))


def numbered_heads(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, number, title) of the lines that open a numbered section, in
    order.  A digit that stands apart from the number belongs to it ("2.1 1 X"
    is 2.11), entities of Markdown are resolved, contents entries and lines
    that begin in lower case are none.  ``texts``: keys, text."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(T.NUMBERED_LINE), 1).alias("number"), F.regexp_extract_all("text", F.lit(T.NUMBERED_LINE), 2).alias("title"))
    rows = texts.select(*keys, F.posexplode(found).alias("pos", "h")).select(*keys, "pos", "h.number", F.replace("h.title", F.lit("&amp;"), F.lit("&")).alias("title"))
    apart = F.col("number").rlike("^[0-9]+[.][0-9]$") & F.col("title").rlike("^[0-9][ \t]+[^ \t]")
    number = F.when(apart, F.concat("number", F.substring("title", 1, 1))).otherwise(F.col("number"))
    title = F.when(apart, F.regexp_replace("title", "^[0-9][ \t]+", "")).otherwise(F.col("title"))
    return rows.select(*keys, "pos", number.alias("number"), title.alias("title")).where(T.is_heading_title(F.col("title")))


def running_head(heads: DataFrame, keys: list[str]) -> DataFrame:
    """Of the numbered headings of each group the most frequent number, of
    equals the earliest, with its first title.  ``heads``: keys, pos, title."""
    numbered = heads.withColumn("number", T.section_number(F.col("title"))).where("number IS NOT NULL")
    per = numbered.groupBy(*keys, "number").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by("title", "pos").alias("title"))
    best = F.max_by(F.struct("number", "title"), F.struct(F.col("n"), -F.col("first"))).alias("b")
    return per.groupBy(*keys).agg(best).select(*keys, "b.number", "b.title")


def note_stem(section: Column, title: Column) -> Column:
    """Padded section and title: the name of a note and its link target."""
    return T.file_stem(F.concat_ws(" ", T.padded_section(section), T.section_title(title)))


def chapters(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, title, body): texts cut at the headings that open a chapter;
    what comes before the first is part 0 with an empty title.  A text without
    such a heading has no parts."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(T.unix_lines(F.col(text_col)), "\n", -1)).alias("pos", "line"))
    title = T.squeeze(F.regexp_extract("line", r"^#{1,6}[ \t]+([^\n]*)$", 1))
    head = F.col("line").rlike(r"^#{1,6}[ \t]+[^ \t]") & T.is_chapter_heading(title)
    over = Window.partitionBy("id").orderBy("pos")
    held = rows.withColumn("head", head).withColumn("title", F.when(F.col("head"), title)).withColumn("part", F.count_if("head").over(over).cast("int"))
    per = held.groupBy("id", "part").agg(F.max("title").alias("title"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = per.withColumn("body", T.strip(F.array_join("l.line", "\n"))).withColumn("parts", F.max("part").over(Window.partitionBy("id")))
    return body.where("parts > 0 AND (part > 0 OR body <> '')").select("id", "part", F.coalesce("title", F.lit("")).alias("title"), "body")


def front_matter(source: Column, chapter: Column, section: Column, first: Column, last: Column) -> Column:
    rows = [F.lit("---"), F.concat(F.lit("source: "), source), F.concat(F.lit("chapter: "), F.coalesce(chapter.cast("string"), F.lit("")))]
    rows += [F.concat(F.lit("section: "), section), F.format_string("pages: [%d, %d]", first, last), F.lit("generator: quire"), F.lit("---")]
    return F.concat_ws("\n", *rows)


def written(parts: Column, language: Column) -> Column:
    """The sections of a map in the order of the contract under headings of
    the language; empty ones are left out."""
    order = F.array(*(F.lit(h) for h in HEADINGS["en"]))
    local = F.when(language == "pl", F.array(*(F.lit(h) for h in HEADINGS["pl"]))).otherwise(order)
    shown = F.transform(F.arrays_zip(order.alias("k"), local.alias("h")), lambda x: F.when(T.strip(F.coalesce(parts[x["k"]], F.lit(""))) != "", F.concat(F.lit("## "), x["h"], F.lit("\n\n"), T.strip(parts[x["k"]]))))
    return F.array_join(F.array_compact(shown), "\n\n")


def assemble(title: Column, parts: Column, language: Column) -> Column:
    """A note: its title, then its sections."""
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), written(parts, language))


def contract_name(heading: Column) -> Column:
    """The name in the contract of a heading read back in any language."""
    names = F.create_map(*(F.lit(x) for pair in zip(HEADINGS["pl"], HEADINGS["en"]) for x in pair))
    return F.coalesce(F.try_element_at(names, heading), heading)


def missing_sections(parts: Column, required: tuple[str, ...] = ("In short", "Explanation")) -> Column:
    return F.filter(F.array(*(F.lit(r) for r in required)), lambda n: T.strip(F.coalesce(parts[n], F.lit(""))) == "")


def navigation(notes: DataFrame) -> DataFrame:
    """(id, footer): links to the neighbours among the notes that exist, null
    where there are none.  ``notes``: (book, id, ord, stem)."""
    over = Window.partitionBy("book").orderBy("ord", "id")
    back = F.concat(F.lit("← [["), F.lag("stem").over(over), F.lit("]]"))
    ahead = F.concat(F.lit("[["), F.lead("stem").over(over), F.lit("]] →"))
    return notes.select("id", F.nullif(F.concat_ws(" · ", back, ahead), F.lit("")).alias("footer"))


def apply_navigation(text: Column, footer: Column) -> Column:
    """Replace or append the footer; applying it again changes nothing."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\n*---\n[^\n]*\[\[[^\n]*\n*$", ""), r"\n+$", "")
    return F.when(footer.isNull(), F.concat(bare, F.lit("\n"))).otherwise(F.concat(bare, F.lit("\n\n---\n"), footer, F.lit("\n")))


def chapter_map(notes: DataFrame) -> DataFrame:
    """(book, chapter, notes, links): the ordered links of each chapter; notes
    without a chapter, or of chapter 0, have no map."""
    held = notes.where("chapter > 0").groupBy("book", "chapter").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "stem"))).alias("s"))
    links = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("]]"))), "\n")
    return held.select("book", "chapter", F.size("s").alias("notes"), links.alias("links"))


def glossary_entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, term, translation) of glossary lines."""
    terms = F.regexp_extract_all(text_col, F.lit(GLOSSARY), 1)
    others = F.regexp_extract_all(text_col, F.lit(GLOSSARY), 2)
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(terms.alias("term"), others.alias("translation"))).alias("pos", "e"))
    return rows.select("id", "pos", T.squeeze(F.col("e.term")).alias("term"), T.squeeze(F.col("e.translation")).alias("translation"))


def merge_glossary(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, term, translation, uses, sources): one entry per term in any
    case, of each group of ``keys``; the first spelling and translation are
    kept, sources are the notes it stands in, in order.  Entries merge before
    the shuffle, so only a term's distinct notes move."""
    keys = keys or []
    first = F.min(F.struct("id", "pos", "term", "translation")).alias("f")
    merged = entries.groupBy(*keys, F.lower("term").alias("key")).agg(first, F.sort_array(F.collect_set("id")).alias("sources"))
    return merged.select(*keys, "f.term", "f.translation", F.size("sources").cast("bigint").alias("uses"), "sources")

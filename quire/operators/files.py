"""The files a library is written out as: where each stands and what is in it.
Everything is a column of a row per file; ``sinks.write_files`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import figures as pictures
from quire.operators import notes, plan

#: Where exports and the glossary stand.
SOURCES, GLOSSARY_FILE, DOMAIN = "_source", "_Glossary.md", "general"
# What chapter maps and the glossary say, by language.
WORDS = {
    "en": {"map": "chapter map", "order": "Notes in reading order:", "pages": "pages", "glossary": "Glossary", "sections": "Sections"},
    "pl": {"map": "mapa rozdziału", "order": "Notatki w kolejności czytania:", "pages": "strony", "glossary": "Słowniczek", "sections": "Sekcje"},
}


def word(name: str, language: Column) -> Column:
    return F.when(language == "pl", F.lit(WORDS["pl"][name])).otherwise(F.lit(WORDS["en"][name]))


def two_digits(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def chapter_folder(chapter: Column, title: Column) -> Column:
    """NN-title, NN where the title isn't known, 00-unsorted without a chapter."""
    name = F.when(T.strip(F.coalesce(title, F.lit(""))) != "", F.concat(F.lit("-"), T.slugify(title))).otherwise("")
    return F.when(chapter.isNull(), F.lit("00-unsorted")).otherwise(F.concat(two_digits(chapter), name))


def _tags(domain: Column, book: Column, last: Column) -> Column:
    return F.concat(F.lit("tags: ["), T.slugify(F.coalesce(domain, F.lit(DOMAIN))), F.lit(", "), book, F.lit(", "), last, F.lit("]"))


def header(book_title: Column, *rows: Column) -> Column:
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit('source: "'), F.coalesce(book_title, F.lit("")), F.lit('"')), *rows, F.lit("---"))


def _of(name: str, value: Column, quoted: bool = False) -> Column:
    mark = F.lit('"' if quoted else "")
    return F.concat(F.lit(f"{name}: "), mark, F.coalesce(value.cast("string"), F.lit("" if quoted else "null")), mark)


def placed(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks with their book's title, domain and language, their chapter's
    title, folder and stem.  A book without a row keeps nulls."""
    about = books.select(F.col("slug").alias("book"), F.col("title").alias("book_title"), "domain", "language").dropDuplicates(["book"])
    titles = plan.chapter_titles(chunks).withColumnRenamed("title", "chapter_title")
    held = chunks.join(about, "book", "left").join(titles, ["book", "chapter"], "left")
    folder = chapter_folder(F.col("chapter"), F.col("chapter_title"))
    return held.withColumn("folder", folder).withColumn("stem", notes.note_stem(F.col("section"), F.coalesce("title", F.lit(""))))


def note_paths(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """(book, chunk_id, path) of every chunk's note."""
    return placed(chunks, books).select("book", "chunk_id", F.concat("folder", F.lit("/"), "stem", F.lit(".md")).alias("path"))


def figure_lines(figures: DataFrame, chunks: DataFrame, embedded: bool = False) -> DataFrame:
    """(chunk_id, figures): the figures on a chunk's pages, in order, as links
    or, for notes, embedded with a line that a description replaces."""
    name, caption = F.substring_index("path", "/", -1), F.coalesce(F.nullif("caption", F.lit("")), "id")
    shown = F.concat(F.lit("!["), name, F.lit("](../figures/"), name, F.lit(")\n*"), caption, F.lit("*"))
    if embedded:
        shown = F.concat(F.lit("![[attachments/"), "book", F.lit("/"), name, F.lit("]]\n*"), caption, F.lit(" — description pending.*"))
    held = pictures.in_chunks(figures, chunks).join(figures.select("figure_id", "page", shown.alias("shown")), "figure_id")
    per = held.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("page", "figure_id", "shown"))).alias("f"))
    return per.select("chunk_id", F.array_join("f.shown", "\n\n").alias("figures"))


def export_files(chunks: DataFrame, figures: DataFrame, books: DataFrame) -> DataFrame:
    """(book, chunk_id, path, text): the source text of every chunk as a file
    of its own, under its figures.  The same chunks give the same bytes."""
    held = placed(chunks, books).join(figure_lines(figures, chunks), "chunk_id", "left")
    c = F.col
    top = header(
        c("book_title"), _of("chapter", c("chapter")), _of("section", c("section"), True), F.format_string("pages: [%d, %d]", "page_start", "page_end"), F.lit("stage: export"),
        F.lit("generator: quire"), _tags(c("domain"), c("book"), F.concat(F.lit("chapter-"), F.coalesce(two_digits(c("chapter")), F.lit("na")))),
    )
    title = T.strip(F.concat(F.lit("# "), F.concat_ws(" ", "section", "title")))
    block = F.when(c("figures").isNotNull(), F.concat(F.lit("## Figures\n\n"), "figures"))
    source = F.concat(F.lit("## Source text\n\n"), T.strip(F.coalesce("text", F.lit(""))))
    path = F.concat(F.lit(SOURCES + "/"), "book", F.lit("/"), "folder", F.lit("/"), "stem", F.lit(".md"))
    return held.select("book", "chunk_id", path.alias("path"), F.concat(F.concat_ws("\n\n", top, title, block, source), F.lit("\n")).alias("text"))


def note_files(chunks: DataFrame, figures: DataFrame, books: DataFrame, model: str, day: Column) -> DataFrame:
    """(book, chunk_id, path, text): the notes of chunks that have ``sections``
    (a map by the names of the contract): header, title, the sections it
    merges, and what was written, with the figures of its pages."""
    held = placed(chunks.where("sections IS NOT NULL"), books).join(figure_lines(figures, chunks, embedded=True), "chunk_id", "left")
    c = F.col
    top = header(
        c("book_title"), _of("chapter", c("chapter")), _of("section", c("section"), True), F.format_string("pages: [%d, %d]", "page_start", "page_end"), F.lit(f"model: {model}"),
        F.concat(F.lit("generated: "), F.date_format(day, "yyyy-MM-dd")), F.lit("generator: quire"), _tags(c("domain"), c("book"), F.concat(F.lit("chapter-"), F.coalesce(two_digits(c("chapter")), F.lit("na")))),
    )
    parts = F.when(F.size("parts") > 0, F.concat(F.lit("*"), word("sections", c("language")), F.lit(": "), F.array_join("parts", " · "), F.lit("*")))
    made = F.when(c("figures").isNull(), c("sections")).otherwise(F.map_concat("sections", F.create_map(F.lit("Figures"), c("figures"))))
    title = T.strip(F.concat(F.lit("# "), F.concat_ws(" ", "section", "title")))
    text = F.concat(F.concat_ws("\n\n", top, title, parts, F.nullif(notes.written(made, F.coalesce("language", F.lit("en"))), F.lit(""))), F.lit("\n"))
    return held.select("book", "chunk_id", F.concat("folder", F.lit("/"), "stem", F.lit(".md")).alias("path"), text.alias("text"))


def chapter_maps(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """(book, chapter, path, text, clash): a file for every chapter with the
    links to its notes in order.  clash: its path is a note's."""
    held = placed(chunks, books)
    c = F.col
    line = F.concat(F.lit("- [["), c("stem"), F.lit("]] — "), word("pages", c("language")), F.lit(" "), c("page_start").cast("string"), F.lit("-"), c("page_end").cast("string"))
    rows = held.where("chapter > 0").withColumn("line", line)
    per = rows.groupBy("book", "chapter", "chapter_title", "folder", "book_title", "domain", "language").agg(F.sort_array(F.collect_list(F.struct("ord", "chunk_id", "line"))).alias("l"))
    pad = two_digits(c("chapter"))
    name = T.file_stem(F.concat(F.concat_ws(" ", pad, F.nullif("chapter_title", F.lit(""))), F.lit(" — "), word("map", c("language"))))
    top = header(c("book_title"), _of("chapter", c("chapter")), F.lit("type: moc"), F.lit("generator: quire"), _tags(c("domain"), c("book"), F.concat(F.lit("chapter-"), pad)))
    heading = T.strip(F.concat(F.lit("# "), F.concat_ws(" ", pad, F.nullif("chapter_title", F.lit("")))))
    text = F.concat(F.concat_ws("\n\n", top, heading, word("order", c("language")), F.array_join("l.line", "\n")), F.lit("\n\n---\n[[_Glossary]]\n"))
    maps = per.select("book", "chapter", F.concat("folder", F.lit("/"), name, F.lit(".md")).alias("path"), text.alias("text"))
    taken = note_paths(chunks, books).select("book", "path", F.lit(True).alias("taken")).distinct()
    return maps.join(taken, ["book", "path"], "left").select("book", "chapter", "path", "text", F.coalesce("taken", F.lit(False)).alias("clash"))


def glossary_files(entries: DataFrame, books: DataFrame) -> DataFrame:
    """(book, path, text): one glossary per book, its terms in order, each with
    links to the notes it stands in.  ``entries``: (book, id, pos, term,
    translation), id being the note's name."""
    merged = notes.merge_glossary(entries, ["book"])
    links = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("[["), s, F.lit("]]"))), " ")
    line = F.concat(F.lit("- **"), "term", F.lit("** — "), "translation", F.lit("  "), links)
    per = merged.groupBy("book").agg(F.sort_array(F.collect_list(F.struct(F.lower("term").alias("key"), line.alias("line")))).alias("l"))
    about = books.select(F.col("slug").alias("book"), F.col("title").alias("book_title"), "domain", "language").dropDuplicates(["book"])
    held, c = per.join(about, "book", "left"), F.col
    top = header(c("book_title"), F.lit("type: glossary"), F.lit("generator: quire"), _tags(c("domain"), c("book"), F.lit("glossary")))
    text = F.concat(top, F.lit("\n# "), word("glossary", c("language")), F.lit("\n\n"), F.array_join("l.line", "\n"), F.lit("\n"))
    return held.select("book", F.lit(GLOSSARY_FILE).alias("path"), text.alias("text"))

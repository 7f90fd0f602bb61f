"""Cleaning pages: furniture, watermarks, contents pages, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def furniture(pages: DataFrame, edge: int = 3, share: float = 0.6, least_pages: int = 10, least_letters: int = 3) -> DataFrame:
    """(book, key, on_pages) of lines that stand at the edge of most pages of a
    book: its running heads and feet.  Books of few pages have none.  Of each
    page only the keys of its first and last lines move."""
    full = F.filter(F.split(T.unix_lines(F.col("text")), "\n", -1), lambda x: T.strip(x) != "")
    edges = T.let(full, lambda x: F.concat(F.slice(x, 1, edge), F.slice(x, F.greatest(F.size(x) - edge + 1, F.lit(1)), edge)))
    keys = F.array_distinct(F.transform(edges, lambda x: T.furniture_key(x)))
    keyed = pages.select("book", "page", F.explode(keys).alias("key")).where(F.length(F.regexp_replace("key", "[0-9]", "")) >= least_letters)
    counted = keyed.groupBy("book", "key").agg(F.countDistinct("page").alias("on_pages"))
    sizes = pages.groupBy("book").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    return counted.join(sizes, "book").where(F.col("on_pages") >= share * F.col("pages")).select("book", "key", "on_pages")


def without_furniture(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(book, page, text) without the lines whose key is furniture, wherever on
    the page they stand.  A book has few keys, at most twice the edge lines
    over the share, so they go to its pages as one array."""
    keys = found.groupBy("book").agg(F.collect_set("key").alias("gone"))
    lines = F.split(T.unix_lines(F.col("text")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x: ~F.array_contains("gone", T.furniture_key(x))), "\n")
    held = pages.select("book", "page", "text").join(keys, "book", "left")
    return held.select("book", "page", F.coalesce(F.when(F.col("gone").isNull(), T.unix_lines(F.col("text"))).otherwise(kept), F.lit("")).alias("text"))


def watermarks(pages: DataFrame, pattern: str = r"\b[0-9a-f]{32}\b", least: int = 3) -> DataFrame:
    """(book, token, on_pages): tokens of a pattern that stand on at least
    max(2, min(least, pages)) pages of a book."""
    token = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("token")
    counted = pages.select("book", "page", token).groupBy("book", "token").agg(F.countDistinct("page").alias("on_pages"))
    sizes = pages.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    wanted = F.greatest(F.lit(2), F.least(F.lit(least), F.col("pages")))
    return counted.join(sizes, "book").where(F.col("on_pages") >= wanted).select("book", "token", "on_pages")


def without_watermarks(pages: DataFrame, pattern: str = r"\b[0-9a-f]{32}\b", least: int = 3) -> DataFrame:
    """(book, page, text) without the watermarks of the book and the blanks
    around them: one blank stays between two words, none at a line's edge.  A
    page is compared with its own tokens, so nothing but those moves."""
    marks = watermarks(pages, pattern, least).select("book", "token")
    token = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("token")
    of_page = pages.select("book", "page", token).join(marks, ["book", "token"]).groupBy("book", "page").agg(F.collect_set("token").alias("marks"))
    held = pages.join(of_page, ["book", "page"], "left")
    clean = F.aggregate("marks", F.col("text"), lambda text, m: _taken_out(text, m))
    return held.select("book", "page", F.when(F.col("marks").isNull(), F.col("text")).otherwise(clean).alias("text"))


def _taken_out(text: Column, token: Column) -> Column:
    word = F.concat(F.lit(r"[ \t]*\b\Q"), token, F.lit(r"\E\b[ \t]*"))
    at_start = F.regexp_replace(text, F.concat(F.lit("(?m)^"), word), F.lit(""))
    at_end = F.regexp_replace(at_start, F.concat(word, F.lit("(?m)$")), F.lit(""))
    return F.regexp_replace(at_end, word, F.lit(" "))


def compact_tables(c: Column) -> Column:
    """A text whose table rows have no padding and short rules."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.when(x.rlike(r"^\|[^\n]*\|[ \t\r]*$"), T.compact_row(x)).otherwise(x)), "\n")


def language(pages: DataFrame, share: float = 0.02, sample: int = 200_000, settings: DataFrame | None = None) -> DataFrame:
    """(book, polish, letters, language): decided on the first ``sample``
    characters of a book, or set: ``settings`` has (book, language), a null
    language is none.  Lengths tell which pages these are; only those pages'
    letters are counted."""
    before = F.sum("length").over(Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    lengths = pages.select("book", "page", F.length("text").alias("length")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample)
    used = pages.select("book", "page", "text").join(lengths.drop("length"), ["book", "page"])
    head = F.substring(F.col("text"), F.lit(1), (F.lit(sample) - F.col("before")).cast("int"))
    polish, letters = T.polish_share(head)
    per = used.groupBy("book").agg(F.sum(polish).alias("polish"), F.sum(letters).alias("letters"))
    found = F.when((F.col("letters") > 0) & (F.col("polish") >= share * F.col("letters")), "pl").otherwise("en")
    if settings is None:
        return per.withColumn("language", found)
    given = settings.where("language IS NOT NULL").select("book", F.lower("language").alias("given")).dropDuplicates(["book"])
    return per.join(given, "book", "left").withColumn("language", F.coalesce("given", found)).drop("given")


def readable(pages: DataFrame) -> DataFrame:
    """Pages that aren't contents pages."""
    return pages.where(~T.is_contents_page(F.col("text")))


def range_texts(ranges: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, text, pages): the pages page_start to page_end of each range in
    order, an empty line between; contents pages and pages without text are
    left out.  A range reaches no further than its book; one that ends before
    it begins is empty.  A text moves once, to its ranges."""
    last = pages.groupBy("book").agg(F.max("page").alias("last"))
    held = ranges.where("page_start IS NOT NULL AND page_end IS NOT NULL").select(key, "book", "page_start", "page_end").distinct().join(last, "book")
    held = held.withColumn("a", F.greatest("page_start", F.lit(1))).withColumn("z", F.least("page_end", "last")).where("a <= z")
    on_page = held.select(key, "book", F.explode(F.sequence("a", "z")).alias("page"))
    met = on_page.join(readable(pages).where("text <> ''"), ["book", "page"]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return met.select(key, F.array_join("p.text", "\n\n").alias("text"), F.size("p").cast("bigint").alias("pages"))


def needing_ocr(pages: DataFrame, least: int = 180) -> DataFrame:
    """(book, page, chars) of pages with too little text in their layer."""
    return pages.select("book", "page", F.length(T.strip(F.col("text"))).alias("chars")).where(F.col("chars") < least)

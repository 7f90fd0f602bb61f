"""Outlines: spans, chapters, parents and problems of bookmarks.

Bookmarks are (book, idx, title, level, page); rows with a null page or an
empty title are no entries (``entries`` drops them and whole repeated rows)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import text as T


def _down() -> WindowSpec:
    return Window.partitionBy("book").orderBy("idx")


def _so_far() -> WindowSpec:
    return _down().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier() -> WindowSpec:
    return _down().rowsBetween(Window.unboundedPreceding, -1)


def entries(bookmarks: DataFrame) -> DataFrame:
    kept = bookmarks.where("page IS NOT NULL AND title IS NOT NULL").where(F.trim("title") != "")
    return kept.select("book", "idx", "title", "level", "page").dropDuplicates(["book", "idx"])


def _following(outline: DataFrame, column: str, sign: int) -> DataFrame:
    """(book, idx, at): the idx of the first later entry whose ``column`` is no
    less (sign 1) or no more (sign -1).  Linear per book, by a stack of entries
    still waiting: a self-join would pair all entries of a book."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        waiting: list[tuple[int, int]] = []
        found: list[int | None] = []
        for idx, value in zip(rows["idx"][::-1], rows["value"][::-1] * sign):
            while waiting and waiting[-1][1] < value:
                waiting.pop()
            found.append(waiting[-1][0] if waiting else None)
            waiting.append((idx, value))
        return pd.DataFrame({"book": rows["book"], "idx": rows["idx"], "at": pd.array(found[::-1], "Int32")})

    held = outline.select("book", "idx", F.col(column).alias("value"))
    return held.groupBy("book").applyInPandas(run, "book string, idx int, at int")


def last_pages(books: DataFrame, page_texts: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(book, last): the last page of each book: of its count, its texts or,
    where it has neither, its bookmarks."""
    counts = books.select(F.col("slug").alias("book"), F.col("page_count").cast("int").alias("page"), F.lit(0).alias("rank"))
    texts = page_texts.select("book", F.col("page").cast("int").alias("page"), F.lit(0).alias("rank"))
    marks = bookmarks.select("book", F.col("page").cast("int").alias("page"), F.lit(1).alias("rank"))
    found = counts.unionAll(texts).unionAll(marks).where("book IS NOT NULL AND page IS NOT NULL")
    own = F.max(F.when(F.col("rank") == 0, F.col("page")))
    return found.groupBy("book").agg(F.coalesce(own, F.max("page")).alias("last"))


def spans(outline: DataFrame, last: DataFrame) -> DataFrame:
    """(book, idx, page_start, page_end): an entry reaches to the page before
    the first later one that doesn't point backwards, at least over its own
    page; an entry without one reaches to the last page of the book.
    ``last``: (book, last)."""
    nxt = _following(outline, "page", 1)
    pages = outline.select("book", F.col("idx").alias("at"), F.col("page").alias("next_page"))
    held = outline.join(last, "book", "left").join(nxt, ["book", "idx"]).join(pages, ["book", "at"], "left")
    end = F.when(F.col("next_page").isNull(), F.greatest("page", "last")).otherwise(F.greatest("page", F.col("next_page") - 1))
    return held.select("book", "idx", F.col("page").alias("page_start"), end.alias("page_end"))


def chapters(outline: DataFrame) -> DataFrame:
    """(book, idx, chapter): the chapter of the last numbered entry on or
    before the page of each entry, in page order; an unnumbered entry at the
    level of the last chapter heading or above ends it."""
    title, by_page = F.col("title"), Window.partitionBy("book").orderBy("page", "idx")
    before = by_page.rowsBetween(Window.unboundedPreceding, -1)
    number = T.chapter_number(title)
    level = F.coalesce(F.last(F.when(T.is_chapter_heading(title), F.col("level")), ignorenulls=True).over(before), F.lit(0))
    event = F.when(number.isNotNull(), number).when(F.col("level") <= level, F.lit(-1))
    state = F.last("event", ignorenulls=True).over(by_page.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # all entries of a page have the chapter that its last one leaves
    of_page = outline.withColumn("event", event).withColumn("state", state)
    held = F.max_by("state", "idx").over(Window.partitionBy("book", "page"))
    return of_page.select("book", "idx", F.nullif(held, F.lit(-1)).alias("chapter"))


def parents(outline: DataFrame) -> DataFrame:
    """(book, idx, parent): the nearest earlier entry of a smaller level,
    however deep.  Linear per book, by a stack of the entries still open."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        above: list[tuple[int, int]] = []
        found: list[int | None] = []
        for idx, level in zip(rows["idx"], rows["level"]):
            if pd.isna(level):
                found.append(None)
                continue
            while above and above[-1][1] >= level:
                above.pop()
            found.append(above[-1][0] if above else None)
            above.append((idx, level))
        return pd.DataFrame({"book": rows["book"], "idx": rows["idx"], "parent": pd.array(found, "Int32")})

    return outline.select("book", "idx", "level").groupBy("book").applyInPandas(run, "book string, idx int, parent int")


def problems(outline: DataFrame) -> DataFrame:
    """(book, entries, backwards, numbered, problems): entries whose successor
    lies on an earlier page, entries with a section number, and why an outline
    can't be trusted."""
    step = outline.withColumn("back", F.lead("page").over(_down()) < F.col("page"))
    per = step.groupBy("book").agg(
        F.count("*").alias("entries"), F.count_if("back").alias("backwards"),
        F.count_if(T.section_number(F.col("title")).isNotNull()).alias("numbered"),
    )
    texts = F.array(
        F.when(F.col("backwards") > 0, F.concat(F.col("backwards").cast("string"), F.lit(" of "), F.col("entries").cast("string"), F.lit(" entries are followed by one on an earlier page"))),
        F.when(F.col("numbered") == 0, F.lit("no entry has a section number")),
    )
    return per.withColumn("problems", F.array_compact(texts))


def number_outline(outline: DataFrame) -> DataFrame:
    """(book, idx, number, dropped): numbers for outlines that have none at
    all.  Chapters are the entries of level 0 that are no apparatus, from the
    first with entries under it on; before it those without are title slides
    and are dropped.  Entries of level 1 in a chapter are its sections N.k."""
    title = F.col("title")
    numbered = F.max(T.section_number(title).isNotNull() | ((F.col("level") == 0) & T.is_chapter_heading(title))).over(Window.partitionBy("book"))
    top, plain = F.col("level") == 0, ~T.is_apparatus(title)
    parent = F.coalesce(F.lead("level").over(_down()) > 0, F.lit(False))
    first = F.min(F.when(F.col("top") & F.col("plain") & F.col("parent"), F.col("idx"))).over(Window.partitionBy("book"))
    held = outline.select("book", "idx", "level", numbered.alias("numbered"), top.alias("top"), plain.alias("plain"), parent.alias("parent")).withColumn("first", first)
    begun = F.coalesce(F.col("idx") >= F.col("first"), F.lit(False))
    held = held.withColumn("opens", F.when(F.col("top"), begun & F.col("plain"))).withColumn("begun", begun)
    chapter = F.count_if(F.coalesce("opens", F.lit(False))).over(_so_far())
    held = held.withColumn("c", chapter).withColumn("within", F.last("opens", ignorenulls=True).over(_so_far())).withColumn("block", F.count_if("top").over(_so_far()))
    second = F.coalesce((F.col("level") == 1) & F.col("within"), F.lit(False))
    k = F.count_if(F.col("second")).over(Window.partitionBy("book", "block").orderBy("idx"))
    held = held.withColumn("second", second).withColumn("k", k)
    number = F.when(F.col("opens"), F.col("c").cast("string")).when(F.col("second"), F.concat_ws(".", F.col("c"), F.col("k")))
    dropped = ~F.col("numbered") & F.col("top") & ~F.col("begun") & F.col("plain") & ~F.col("parent")
    return held.select("book", "idx", F.when(~F.col("numbered"), number).alias("number"), dropped.alias("dropped"))


def with_numbers(outline: DataFrame) -> DataFrame:
    """The outline as ``number_outline`` leaves it: numbers before the titles,
    title slides gone."""
    made = outline.join(number_outline(outline), ["book", "idx"]).where("NOT dropped")
    return made.withColumn("title", F.concat_ws(" ", "number", "title")).drop("number", "dropped")


def section_ranges(outline: DataFrame, last: DataFrame) -> DataFrame:
    """(book, run, title, section, level, page_start, page_end): the pages of
    each numbered section with all that is under it, in page order.  A section
    begins at an entry with a number other than the last one's; apparatus at a
    section's level or above stands beside it, on its own; what comes before the first number
    keeps the first title.  A range ends before the next one begins, the last
    on the last page of the book.  ``last``: (book, last)."""
    title = F.col("title")
    facts = outline.select("book", "idx", "title", "level", "page", T.section_number(title).alias("section"), T.is_apparatus(title).alias("apparatus"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, owner = [], None
        for r in rows.sort_values(["page", "idx"]).itertuples():
            section = None if pd.isna(r.section) else r.section
            if owner is None:
                opens = True
            elif section is None:
                opens = r.apparatus and r.level <= owner[1]
            else:
                opens = section != owner[0]
            if opens:
                owner = (section, r.level)
                kept.append((r.book, len(kept) + 1, r.title, section, r.level, r.page))
        return pd.DataFrame(kept, columns=["book", "run", "title", "section", "level", "page_start"])

    starts = facts.groupBy("book").applyInPandas(run, "book string, run bigint, title string, section string, level int, page_start int")
    over = Window.partitionBy("book").orderBy("run")
    nxt = F.lead("page_start").over(over)
    end = F.when(nxt.isNotNull(), F.greatest("page_start", nxt - 1)).otherwise(F.greatest("page_start", "last"))
    held = starts.join(last, "book", "left")
    return held.select("book", "run", "title", "section", "level", "page_start", end.alias("page_end"))


def deep(outline: DataFrame) -> DataFrame:
    """(book, deep): whether an unnumbered entry stands, at any depth, under a
    section with a dotted number."""
    facts = outline.select("book", "idx", "level", T.section_number(F.col("title")).alias("section"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        found, above = False, []  # levels of the open entries, and whether one of them or above has a dotted number
        for level, section in zip(rows["level"], rows["section"]):
            while above and above[-1][0] >= level:
                above.pop()
            under = bool(above) and above[-1][1]
            bare = pd.isna(section)
            found = found or (bare and under)
            above.append((level, under or (not bare and "." in section)))
        return pd.DataFrame({"book": [rows["book"].iloc[0]], "deep": [found]})

    return facts.groupBy("book").applyInPandas(run, "book string, deep boolean")


def outermost(outline: DataFrame) -> DataFrame:
    """Entries that no earlier entry of their book contains: level at most the
    least level so far."""
    least = F.min("level").over(_earlier())
    return outline.withColumn("least", least).where("least IS NULL OR level <= least").select("book", "idx", "level")


def subtree_ends(outline: DataFrame) -> DataFrame:
    """(book, idx, end_idx): the first later entry of a level no deeper."""
    return _following(outline, "level", -1).withColumnRenamed("at", "end_idx")


def labels(outline: DataFrame) -> DataFrame:
    """(book, idx, label): titles indented by level, with their page."""
    label = F.concat(F.repeat(F.lit("    "), F.col("level")), "title", F.lit("  (p. "), F.col("page").cast("string"), F.lit(")"))
    return outline.select("book", "idx", label.alias("label"))


def label_title(label: Column) -> Column:
    """The title in a label."""
    return T.strip(F.regexp_replace(T.strip(label), r"  \(p\. [^(]*$", ""))

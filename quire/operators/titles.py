"""Finding the line of a page that opens a section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Letters from which on the beginning of a title is enough.
PREFIX = 6


def title_offsets(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, offset, rank): where the line with a title begins on its page.

    ``wanted`` is (id, book, page, title).  Of all lines the best rank wins, of
    equals the first: 0 a heading with all letters and digits of the title, 1 a
    plain line with them, 2 a heading that begins the title, 3 a line that has
    them but for the section number.  Titles that aren't found are left out."""
    pos = F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line")
    lines = pages.select("book", "page", pos)
    before = Window.partitionBy("book", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    bare = F.regexp_replace("line", "^[ \t\r]*#*", "")
    lines = lines.select(
        "book", "page", "offset", T.letters_key(F.col("line")).alias("found"),
        F.col("line").rlike("^[ \t\r]*#").alias("heading"), T.letters_key(T.section_title(bare)).alias("unnumbered"),
    ).where("found <> ''")
    title = F.col("title")
    keys = wanted.select("id", "book", "page", T.letters_key(title).alias("wanted"), T.letters_key(T.section_title(title)).alias("name")).where("wanted <> ''")
    met = keys.join(lines, ["book", "page"])
    same = F.col("found") == F.col("wanted")
    begins = F.col("heading") & (F.length("found") >= PREFIX) & F.startswith("wanted", "found")
    rank = F.when(same & F.col("heading"), 0).when(same, 1).when(begins, 2).when(F.col("unnumbered") == F.col("name"), 3)
    best = met.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("id").agg(F.min(F.struct("rank", "offset")).alias("b"))
    return best.select("id", F.col("b.offset").cast("bigint").alias("offset"), "b.rank")

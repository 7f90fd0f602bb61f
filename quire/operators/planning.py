"""Packing pages and sections into chunks of a token budget.

Folds go over the rows of one book in order, as a stream of page numbers and
lengths; a task holds the state of one fold, not the book.  The texts are put
together afterwards by a join."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: A section's number of which the last digit stands apart, and the leader
#: dots of a line of contents.
_NUMBERED_LINE = re.compile(T.NUMBERED_LINE)
_DIGIT_APART = re.compile(r"^(\d)\s+(\S.*)$")
_LEADER = re.compile(r"(?:\.\s?){4,}")
#: Characters between two pages of a chunk.
GAP = 2


def number_runs(rows: DataFrame, keys: list[str], order: str, facts: list[str], fold: Callable[[], Callable[..., bool]]) -> DataFrame:
    """(keys, order, run): ``rows`` in runs, counted from 0 for each key.
    ``fold()`` makes the fold of one key: called with the facts of each row in
    order, it says whether a run begins there.  Linear, in one pass."""
    n = len(keys)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, order)) + ", run int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begins, at = None, None, 0
        for batch in batches:
            runs = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if begins is None or row[:n] != now:
                    now, begins, at = row[:n], fold(), 0
                    begins(*row[n + 1 :])
                elif begins(*row[n + 1 :]):
                    at += 1
                runs.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(runs, pa.int32())], names=[*keys, order, "run"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, order, *facts).repartition(parts, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def section_heads(text: str | None) -> list[tuple[str, str]]:
    """(number, title) of the lines of a text that open a numbered section."""
    found = []
    for number, rest in _NUMBERED_LINE.findall(text or ""):
        title = html.unescape(rest.strip())
        if (apart := _DIGIT_APART.match(title)) and number.count(".") == 1 and len(number.partition(".")[2]) == 1:
            number, title = number + apart[1], apart[2]
        if title[:1].isalnum() and not title[:1].islower() and not _LEADER.search(title):
            found.append((number, title))
    return found


def slices(most: int, least: int) -> Callable[..., bool]:
    """A fold over (size, opens) of pages, in characters: a slice ends before
    the page that would make it too long and, once it holds ``least``, before
    one that opens a section; never before it has text."""
    held = 0

    def begins(size: int, opens: bool | None) -> bool:
        nonlocal held
        new = held > 0 and (held + size > most or (held >= least and bool(opens)))
        held = size if new else held + size
        return new

    return begins


def _sized(pages: DataFrame) -> DataFrame:
    opens = F.col("opens") if "opens" in pages.columns else F.lit(False)
    return pages.select("book", "page", F.when(F.col("length") > 0, F.col("length") + GAP).otherwise(0).alias("size"), opens.alias("opens"))


def _slice_rows(runs: DataFrame) -> DataFrame:
    return runs.groupBy("book", F.col("run").alias("slice")).agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("size").cast("bigint").alias("chars")
    )


def slice_pages(pages: DataFrame, max_tokens: int = 6000, min_tokens: int | None = None) -> DataFrame:
    """(book, slice, first_page, last_page, chars): consecutive pages of a book
    packed greedily; a page counts its characters and two for the gap.  Once it
    holds ``min_tokens``, else the most, a slice also ends before a page that
    opens a section.  ``pages``: (book, page, length, opens BOOLEAN)."""
    sized = _sized(pages)
    runs = number_runs(sized, ["book"], "page", ["size", "opens"], lambda: slices(4 * max_tokens, 4 * (min_tokens or max_tokens)))
    return _slice_rows(runs.join(sized, ["book", "page"]))


def even_cuts(sizes: list[int], opens: list[bool], max_tokens: int, min_tokens: int) -> list[int]:
    """The slice of each page, as few slices as greedy packing makes, under the
    lowest ceiling that gives as many: from an even share it rises by a
    twentieth at a time."""

    def cut(ceiling: int) -> list[int]:
        begins, at, out = slices(4 * ceiling, 4 * min(min_tokens, ceiling)), 0, []
        for k, (size, new) in enumerate(zip(sizes, opens)):
            at += begins(size, new) and k > 0
            out.append(at)
        return out

    greedy = cut(max_tokens)
    n = greedy[-1] + 1
    if n == 1:
        return greedy
    ceiling = max(sum(sizes) - GAP, 0) // 4 // n
    while ceiling < max_tokens:
        if (even := cut(ceiling))[-1] + 1 == n:
            return even
        ceiling += max(1, ceiling // 20)
    return greedy


def balanced_slices(pages: DataFrame, max_tokens: int = 6000, min_tokens: int = 3000) -> DataFrame:
    """``slice_pages`` under the lowest ceiling that needs no more slices.  A
    book's lengths are gone over once for each ceiling tried, at most about
    twenty times the slices' unevenness; texts aren't touched."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page")
        return rows[["book", "page", "size"]].assign(run=even_cuts(rows["size"].tolist(), rows["opens"].fillna(False).tolist(), max_tokens, min_tokens))

    cut = _sized(pages).groupBy("book").applyInPandas(run, "book string, page int, size int, run int")
    return _slice_rows(cut)


def fold_units(level: list[int], chapter: list, tokens: list[int], max_tokens: int, min_tokens: int, least: int = 150) -> list[tuple[int, int, int]]:
    """Groups (start, stop, the group it is folded into) of entries, by units
    of the outline, as ``group_units`` says."""
    n = len(level)
    before, ends, waiting = [0], [n] * n, []
    for t in tokens:
        before.append(before[-1] + t)
    for k in range(n):
        while waiting and (chapter[k] != chapter[k - 1] or level[k] <= level[waiting[-1]]):
            ends[waiting.pop()] = k
        waiting.append(k)
    starts: list[int] = []
    held, k = 0, 0
    open_ = False  # whether the last group still takes units
    while k < n:
        end = ends[k] if before[ends[k]] - before[k] <= max_tokens else k + 1
        size = before[end] - before[k]
        apart = ends[k] > end or chapter[k] != chapter[starts[-1]] or held + size > max_tokens or (size >= min_tokens and held >= least) if open_ else True
        if apart:
            starts.append(k)
            held = 0
        held += size
        open_ = held < min_tokens
        k = end
    out: list[tuple[int, int, int]] = []
    for g, (a, z) in enumerate(zip(starts, [*starts[1:], n])):
        into = out[-1][2] if out else g
        joins = g and before[z] - before[a] < least and chapter[starts[into]] == chapter[a]
        out.append((a, z, into if joins else g))
    return out


def group_units(spans: DataFrame, max_tokens: int, min_tokens: int, least: int = 150, skip: int = 50) -> DataFrame:
    """(book, idx, grp, into): sections merged by units of the outline.  A unit
    is an entry with all entries under it in its chapter, if they fit
    ``max_tokens``, else the entry alone.  A group ends once it holds
    ``min_tokens``; before another chapter; before a unit above the ceiling or,
    when it holds ``least``, before one that fills a note; and before an entry
    whose section must be cut.  A group under ``least`` joins the one before it
    in its chapter (``into``); ``into`` is null where what then is together
    stays under ``skip``.  ``spans``: (book, idx, level, chapter, tokens), one
    row each; a null chapter is one of its own.  Linear per book."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tokens = rows["tokens"].tolist()
        groups = fold_units(rows["level"].tolist(), [None if pd.isna(c) else c for c in rows["chapter"]], tokens, max_tokens, min_tokens, least)
        together: dict[int, int] = {}
        for a, z, into in groups:
            together[into] = together.get(into, 0) + sum(tokens[a:z])
        grp = [g for g, (a, z, _) in enumerate(groups) for _ in range(a, z)]
        kept = [into if together[into] >= skip else None for a, z, into in groups for _ in range(a, z)]
        return pd.DataFrame({"book": rows["book"], "idx": rows["idx"], "grp": grp, "into": pd.array(kept, "Int32")})

    held = spans.select("book", "idx", F.coalesce("level", F.lit(0)).alias("level"), "chapter", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    return held.groupBy("book").applyInPandas(run, "book string, idx int, grp int, into int")


def paginate(blocks: DataFrame, most: int = 3000) -> DataFrame:
    """(doc, pos, page): a page is closed before the next block once it holds
    ``most`` characters, and before a block that an outline points to.
    ``blocks``: (doc, pos, length, target)."""

    def fold() -> Callable[..., bool]:
        held = 0

        def begins(length: int, target: bool) -> bool:
            nonlocal held
            new = held >= most or target
            held = length if new else held + length
            return new

        return begins

    runs = number_runs(blocks, ["doc"], "pos", ["length", "target"], fold)
    return runs.select("doc", "pos", (F.col("run") + 1).alias("page"))


def oversized(chunks: DataFrame, budgets: DataFrame, books: DataFrame) -> DataFrame:
    """(chunk_id, tokens, max_tokens) of chunks above their book's budget."""
    limit = books.select(F.col("slug").alias("book"), "budget").join(budgets.select("budget", "max_tokens"), "budget")
    size = F.floor(F.length("text") / 4).cast("int")
    return chunks.select("chunk_id", "book", size.alias("tokens")).join(limit, "book").where("tokens > max_tokens").select("chunk_id", "tokens", "max_tokens")


def unique_in_order(names: list[str]) -> list[str]:
    """Every name used once: a later use gets "-2", "-3" and so on, whichever
    is free."""
    used: set[str] = set()
    next_free: dict[str, int] = {}
    out = []
    for name in names:
        made, k = name, next_free.get(name, 2)
        while made in used:
            made, k = f"{name}-{k}", k + 1
        next_free[name] = k
        used.add(made)
        out.append(made)
    return out


def unique_names(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(order, unique_name): names made unique within a key, in order; null
    names stay null.  Only keys, names and the order are gathered per key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        return pd.DataFrame({"o": rows["o"], "unique_name": unique_in_order(rows["n"].tolist())})

    named = rows.where(F.col(name).isNotNull()).select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(order).alias("o")).distinct()
    kind = rows.schema[order].dataType.simpleString()
    made = named.groupBy("k").applyInPandas(run, f"o {kind}, unique_name string").withColumnRenamed("o", order)
    return rows.select(order).distinct().join(made, order, "left")


def batches(pages: DataFrame, size: int = 40) -> DataFrame:
    """(book, first_page, last_page): the pages of a book in batches."""
    ends = pages.groupBy("book").agg(F.min("page").alias("a"), F.max("page").alias("z"))
    starts = ends.select("book", "z", F.explode(F.sequence("a", "z", F.lit(size))).alias("first_page"))
    return starts.select("book", "first_page", F.least("z", F.col("first_page") + size - 1).alias("last_page"))

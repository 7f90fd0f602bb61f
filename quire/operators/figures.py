"""Figures: decorations, template bands, repeated pictures, owners."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def distinct_figures(figures: DataFrame) -> DataFrame:
    return figures.dropDuplicates(["figure_id"])


def decorations(figures: DataFrame, width: float = 80.0) -> DataFrame:
    """Figures without a caption and no wider than ``width`` points."""
    wide = F.abs(F.col("bbox.r") - F.col("bbox.l"))
    return figures.where((F.coalesce("caption", F.lit("")) == "") & (wide <= width)).select("figure_id", wide.alias("width"))


def bands(figures: DataFrame, pages: int = 5, tolerance: float = 2.0) -> DataFrame:
    """(figure_id) of boxes without a caption that stand at one place on at
    least ``pages`` pages: in page order they gather round the first whose left
    edge, top and bottom are each within the tolerance.  Only firsts of the
    same or a neighbouring cell are compared, so it is linear per book."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple, list[tuple]] = {}
        firsts: list[tuple[list, set]] = []
        for r in rows.sort_values(["page", "figure_id"]).itertuples():
            box = (r.l, r.t, r.b)
            cell = tuple(math.floor(x / (2 * tolerance)) for x in box)
            around = itertools.product(*((c - 1, c, c + 1) for c in cell))
            near = (n for c in around for n, first in cells.get(c, ()) if all(abs(x - y) <= tolerance for x, y in zip(first, box)))
            n = min(near, default=len(firsts))
            if n == len(firsts):
                firsts.append(([], set()))
                cells.setdefault(cell, []).append((n, box))
            firsts[n][0].append(r.figure_id)
            firsts[n][1].add(r.page)
        return pd.DataFrame({"figure_id": pd.array([i for ids, on in firsts if len(on) >= pages for i in ids], "Int64")})

    bare = figures.where((F.coalesce("caption", F.lit("")) == "") & F.col("page").isNotNull() & F.col("figure_id").isNotNull())
    placed = bare.select("figure_id", "book", "page", F.col("bbox.l").alias("l"), F.col("bbox.t").alias("t"), F.col("bbox.b").alias("b")).dropna(subset=["l", "t", "b"])
    return placed.groupBy("book").applyInPandas(run, "figure_id bigint")


def in_chunks(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, figure_id): figures whose page lies in a chunk's range.  The
    range is opened into pages, so the join is one of equality; only as far as
    the book has figures, and a range that ends before it begins is empty."""
    last = figures.groupBy("book").agg(F.max("page").alias("last"))
    held = chunks.select("chunk_id", "book", "page_start", "page_end").join(last, "book")
    held = held.withColumn("a", F.greatest("page_start", F.lit(1))).withColumn("z", F.least("page_end", "last")).where("page_start IS NOT NULL AND page_end IS NOT NULL AND a <= z")
    pages = held.select("chunk_id", "book", F.explode(F.sequence("a", "z")).alias("page"))
    return pages.join(figures.select("figure_id", "book", "page"), ["book", "page"]).select("chunk_id", "figure_id").distinct()


def carried_heading(figures: DataFrame) -> DataFrame:
    """(figure_id, owner): the figure's own heading, or the last one before."""
    over = Window.partitionBy("book").orderBy("page", "figure_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return figures.select("figure_id", F.last("heading", ignorenulls=True).over(over).alias("owner"))


def sign_hash(vector: Column) -> Column:
    """The signs of 64 numbers as the bits of a BIGINT, the first highest."""
    bit = lambda x: F.when(x > 0, 1).otherwise(0).cast("bigint")
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(bit(x)))


def same_pictures(sightings: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b) with hashes at most ``bits`` apart, within a book.

    By the pigeonhole principle two hashes that differ in at most ``bits`` of 64
    bits agree in one of bits + 1 equal slices; only those meet.
    ``sightings``: (book, id, hash)."""
    ends = [64 * k // (bits + 1) for k in range(bits + 2)]
    part = lambda a, z: F.shiftrightunsigned("hash", a).bitwiseAND(F.lit((1 << (z - a)) - 1))
    slices = F.posexplode(F.array(*(part(a, z) for a, z in zip(ends, ends[1:])))).alias("k", "slice")
    keyed = sightings.select("book", "id", "hash", slices)
    left = keyed.select("book", "k", "slice", F.col("id").alias("a"), F.col("hash").alias("ha"))
    right = keyed.select("book", "k", "slice", F.col("id").alias("b"), F.col("hash").alias("hb"))
    met = left.join(right, ["book", "k", "slice"]).where("a < b")
    apart = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return met.where(apart <= bits).select("a", "b", apart.alias("apart")).distinct()


def kinds(sightings: DataFrame, bits: int = 4, tolerance: float = 2.0) -> DataFrame:
    """(book, id, page, kind): sightings (book, id, hash, page, width, height)
    by the first picture of their kind in page order that they look like.
    Firsts are looked up by the slices of their hashes: two hashes at most
    ``bits`` apart agree in one of bits + 1 slices.  One pass over a book."""
    ends = [64 * k // (bits + 1) for k in range(bits + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts, by_slice = None, [], {}
        for batch in batches:
            found = []
            for book, page, _, signed, width, height in zip(*(c.to_pylist() for c in batch.columns)):
                if book != now:
                    now, firsts, by_slice = book, [], {}
                h = signed & ((1 << 64) - 1)
                keys = [(k, h >> a & ((1 << (z - a)) - 1)) for k, (a, z) in enumerate(zip(ends, ends[1:]))]
                like = lambda f: (f[0] ^ h).bit_count() <= bits and abs(f[1] - width) <= tolerance and abs(f[2] - height) <= tolerance
                kind = min((n for key in keys for n in by_slice.get(key, ()) if like(firsts[n])), default=len(firsts))
                if kind == len(firsts):
                    firsts.append((h, width, height))
                    for key in keys:
                        by_slice.setdefault(key, []).append(kind)
                found.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(found, pa.int32())], names=["book", "id", "page", "kind"])

    facts = ["book", "page", "id", "hash", "width", "height"]
    schema = ", ".join(f"{c} {sightings.schema[c].dataType.simpleString()}" for c in ("book", "id", "page")) + ", kind int"
    parts = int(sightings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sightings.dropna(subset=facts).select(*facts).repartition(parts, "book").sortWithinPartitions("book", "page", "id").mapInArrow(run, schema)


def repeated(sightings: DataFrame, pages: int = 3, span: int = 20, bits: int = 4, tolerance: float = 2.0) -> DataFrame:
    """(book, id) of pictures that recur: of a kind that stands on ``pages``
    distinct pages which reach over ``span``."""
    held = kinds(sightings, bits, tolerance)
    often = held.groupBy("book", "kind").agg(F.countDistinct("page").alias("n"), (F.max("page") - F.min("page")).alias("reach"))
    return held.join(often.where((F.col("n") >= pages) & (F.col("reach") >= span)), ["book", "kind"], "left_semi").select("book", "id")


def without_repeated(figures: DataFrame, sightings: DataFrame, **limits) -> DataFrame:
    """Figures but those without a caption whose picture recurs."""
    gone = repeated(sightings, **limits).distinct()
    bare = F.coalesce("caption", F.lit("")) == ""
    kept = figures.where(~bare)
    return kept.unionByName(figures.where(bare).join(gone, ["book", "id"], "left_anti").select(figures.columns))


def embeds(figures: DataFrame) -> DataFrame:
    """(figure_id, embed): the line that shows a figure in a note, with its
    caption or a mark that one is pending."""
    caption = F.coalesce(F.nullif(T.squeeze(F.col("caption")), F.lit("")), F.lit("caption pending"))
    return figures.select("figure_id", F.concat(F.lit("![["), F.col("book"), F.lit("/"), F.col("id"), F.lit(".png]]\n*"), caption, F.lit("*")).alias("embed"))

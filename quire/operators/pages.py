"""The text of a page: which of its rows holds, and which pages were scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_text(df: DataFrame) -> Column:
    """`extracted`, or `layer` where that is null, or else empty."""
    return F.coalesce(df["extracted"], df["layer"], F.lit(""))


def holding(rows: DataFrame, *carried: Column) -> DataFrame:
    """One row per (book, page): of several rows the one extracted last holds,
    among equals the one loaded last, then the greatest value.  Rows with a
    null book or page are left out.  ``carried`` are the columns to keep; carry
    lengths or digests rather than texts where these do."""
    value = F.struct(*carried)
    order = F.struct("extracted_at", "loaded_at", value)
    picked = rows.where("book IS NOT NULL AND page IS NOT NULL").groupBy("book", "page").agg(F.max(order).alias("o"))
    return picked.select("book", "page", "o.col3.*")


def scanned_pages(extract_results: DataFrame) -> DataFrame:
    """(book, page) of every page that any run lists as scanned, once each."""
    listed = extract_results.where("book IS NOT NULL").select("book", F.explode("ocr_pages").alias("page"))
    return listed.where("page IS NOT NULL").distinct()

"""Filling containers of fixed capacity with items of varying length.

Method: hierarchical residual packing.  Every partition packs its own items by
best fit, longest first; bins that are nearly full are done.  The underfull
bins become items themselves and are packed again in groups of bounded size,
mixed anew each round, until one group is left or a round saves next to
nothing.  Bins that no other could join are done.  Only (bin, fill) pairs move
between rounds, never the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tokens import token_counts
from quire.session import cut, table

#: Items that one task packs at a time; more items are packed block by block.
BLOCK = 200_000
#: Rounds go on while one saves this share of the bins that it packs.
WORTH = 1e-4
#: Rounds that the numbers of bins have room for.
MOST_ROUNDS = 31
#: A bin filled to this share is done.
NEARLY_FULL = 0.99


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best fit, longest first.  Returns the bin of each item and the fill of
    each bin.  An item goes to the bin with the least room that still holds it;
    items of size 0 go round the bins in turn."""
    bin_of, fills = [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, empty = 0, []  # a bit for every room that some open bin has
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        if size == 0:
            empty.append(k)
            continue
        if wide := rooms >> size:
            room = size + (wide & -wide).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            fills[at] += size
        else:
            room, at = capacity, len(fills)
            fills.append(size)
        if left := room - size:
            by_room[left].append(at)
            rooms |= 1 << left
        bin_of[k] = at
    if empty and not fills:
        fills.append(0)
    for turn, k in enumerate(empty):
        bin_of[k] = turn % len(fills)
    return bin_of, fills


def _pack_items(capacities: list[int], round_no: int):
    """Round 0, over (id, sizes): the pieces of every item for every capacity.
    ``fill`` stands on one row of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def pack(ids: list, sizes: list[list[int]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for c, capacity in enumerate(capacities):
                rows: list[tuple[int, int, int]] = []  # item, start, size
                for k, s in enumerate(sizes):
                    size = max(s[c] or 0, 0)
                    whole = size // capacity if size > capacity else 0
                    rows.extend((k, p * capacity, capacity) for p in range(whole))
                    if size > whole * capacity or not size:
                        rows.append((k, whole * capacity, size - whole * capacity))
                bin_of, fills = best_fit([r[2] for r in rows], capacity)
                base = (round_no << 58) | (task << 36) | made
                made += len(fills)
                first: dict[int, int] = {}
                for r, b in enumerate(bin_of):
                    first.setdefault(b, r)
                fill: list[int | None] = [None] * len(rows)
                for b, r in first.items():
                    fill[r] = fills[b]
                yield pa.RecordBatch.from_pydict(
                    {
                        "c": pa.array([c] * len(rows), pa.int32()),
                        "id": pa.array([ids[r[0]] for r in rows], pa.int64()),
                        "start": pa.array([r[1] for r in rows], pa.int64()),
                        "size": pa.array([r[2] for r in rows], pa.int32()),
                        "bin": pa.array([base + b for b in bin_of], pa.int64()),
                        "fill": pa.array(fill, pa.int32()),
                    }
                )

        ids, sizes = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            if len(ids) >= BLOCK:
                yield from pack(ids, sizes)
                ids, sizes = [], []
        if ids:
            yield from pack(ids, sizes)

    return run


def _merge_bins(capacities: list[int], round_no: int):
    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        c, slot = int(key[0]), int(key[1])
        bins = bins.sort_values("bin")
        bin_of, fills = best_fit(bins["fill"].tolist(), capacities[c])
        base, seen, fill = (round_no << 58) | (slot << 32), set(), []
        for b in bin_of:
            fill.append(None if b in seen else fills[b])
            seen.add(b)
        return pd.DataFrame(
            {"c": c, "bin": bins["bin"], "parent": [base + b for b in bin_of], "fill": pd.array(fill, "Int32")}
        )

    return run


def pack(
    items: DataFrame, capacities: list[int], nearly_full: float = NEARLY_FULL, block: int = BLOCK
) -> DataFrame:
    """Pack items (id BIGINT, sizes ARRAY<INT>, one size per capacity).

    Returns (c, id, start, size, bin): c is the place of the capacity in the
    list, start and size the part of the item, in the unit of the sizes.  An
    item is divided only if it alone exceeds the capacity: into full bins and a
    rest.  A null or negative size counts as 0; items of size 0 take no room
    and come out once.  Repeated rows are items of their own.  An empty input
    gives an empty result."""
    if any(x < 1 for x in capacities):
        raise ValueError("a capacity is at least 1")
    placed = cut(
        items.mapInArrow(_pack_items(capacities, 0), "c int, id bigint, start bigint, size int, bin bigint, fill int")
    )
    limits = F.array(*(F.lit(int(nearly_full * x)) for x in capacities))
    under = lambda bins: bins.where(F.col("fill") < F.element_at(limits, F.col("c") + 1))
    left = under(placed.where("fill is not null").select("c", "bin", "fill"))
    # where a bin of the first round ends up; items move once, at the end
    moved, round_no = None, 1
    while round_no < MOST_ROUNDS:
        # a bin too full even for the least other one is done
        sizes = {r.c: (r.n, r.least) for r in left.groupBy("c").agg(F.count("*").alias("n"), F.min("fill").alias("least")).collect()}
        room = F.array(*(F.lit(x - (sizes[c][1] if c in sizes else x)) for c, x in enumerate(capacities)))
        left = left.where(F.col("fill") <= F.element_at(room, F.col("c") + 1))
        open_ = {r.c: r.n for r in left.groupBy("c").agg(F.count("*").alias("n")).collect() if r.n > 1}
        if not open_:
            break
        # bins fall into groups by hash, anew each round, of about ``block`` bins
        groups = F.array(*(F.lit(-(-open_.get(c, 1) // block)) for c in range(len(capacities))))
        slot = F.pmod(F.xxhash64(F.lit(round_no), "bin"), F.element_at(groups, F.col("c") + 1)).cast("int")
        merged = cut(
            left.withColumn("slot", slot)
            .groupBy("c", "slot")
            .applyInPandas(_merge_bins(capacities, round_no), "c int, bin bigint, parent bigint, fill int")
        )
        step = merged.select("c", "bin", "parent")
        if moved is None:
            moved = step.select("c", "bin", F.col("parent").alias("now"))
        else:
            on = step.select("c", F.col("bin").alias("now"), "parent")
            moved = cut(moved.join(on, ["c", "now"], "left").select("c", "bin", F.coalesce("parent", "now").alias("now")))
        left = under(merged.where("fill is not null").select("c", F.col("parent").alias("bin"), "fill"))
        after = {r.c: r.n for r in left.groupBy("c").agg(F.count("*").alias("n")).collect()}
        saved = sum(n - after.get(c, 0) for c, n in open_.items())
        if all(n <= block for n in open_.values()) or saved < WORTH * sum(open_.values()):
            break
        round_no += 1
    if moved is not None:
        placed = placed.join(moved, ["c", "bin"], "left").withColumn("bin", F.coalesce("now", "bin")).drop("now")
    return placed.select("c", "id", "start", "size", "bin")


def pack_documents(
    documents: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Assign documents to containers by the tokens of their text.

    Returns (container, bin, doc_id, start_token, tokens): one row per document
    and container, or one per part of a document that alone exceeds the
    capacity.  Null and empty texts have 0 tokens and take no room.  Containers
    without a tokenizer or a positive capacity hold nothing."""
    # the table of containers is a setting of a few rows, not data
    kinds = [r for r in containers.distinct().limit(1001).collect() if r.tokenizer and (r.capacity or 0) > 0]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    spark = documents.sparkSession
    kinds.sort(key=lambda r: str(r.container))
    names = list(dict.fromkeys(r.tokenizer for r in kinds))
    counted = cut(token_counts(documents, names, id_col, text_col))
    sizes = F.array(*(F.element_at("sizes", names.index(r.tokenizer) + 1) for r in kinds))
    if not kinds:
        sizes = F.array().cast("array<int>")
    packed = pack(counted.select(F.col(id_col).alias("id"), sizes.alias("sizes")), [r.capacity for r in kinds])
    name = F.element_at(F.array(*(F.lit(r.container) for r in kinds), F.lit("")), F.col("c") + 1)
    return packed.select(
        name.alias("container"),
        "bin",
        F.col("id").alias(id_col),
        F.col("start").alias("start_token"),
        F.col("size").alias("tokens"),
    )


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: its bins, the least number of bins that could do, the
    tokens in them and the share of room that is unused."""
    per = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("fill"))
    return (
        per.groupBy("container")
        .agg(F.count("*").alias("bins"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
        .join(containers.select("container", "capacity").distinct(), "container")
        .select(
            "container",
            "bins",
            F.ceil(F.col("tokens") / F.col("capacity")).alias("bins_at_least"),
            "tokens",
            "fullest",
            (1 - F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("unused"),
        )
    )


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))

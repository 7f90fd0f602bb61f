"""Long exact spans that records share.

Method: units are hashed, their digests grouped over the whole corpus, the
earliest ranked occurrence is kept and the rest can be removed by its original
offsets.  Paragraphs, without the white space at their ends, are the first
units.  A shared span may begin and end in the middle of a paragraph, so by
themselves they don't give all; the further units are windows of ``least`` code
points, taken only around anchors that the content itself picks:

1. An anchor is a position whose GRAM code points have the least digest in a
   window of ``least - GRAM + 1`` positions.  Any span of ``least`` code points
   holds such an anchor, the same wherever the span stands.
2. Only paragraphs and anchors whose digest occurs in several texts go on, the
   anchors with the text around them.  What two surroundings have in common is
   a unit if it has ``least`` code points; around anchors that occur often,
   every window of ``least`` code points is a unit instead, so nothing is
   paired there.
3. Units with equal digests (128 bits) in several texts are the shared spans.

Equal texts are one text throughout, by digest, and are spread to documents at
the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import cut, table

#: Code points of an anchor: long enough that texts made of the same phrases
#: seldom share one by chance.
GRAM = 96
#: Occurrences of an anchor up to which their surroundings are compared with
#: each other; beyond, every window around the anchor is hashed.
COMPARED = 64
#: Documents with one unit that one task pairs with all of them.
PAIRED_TOGETHER = 4096
#: Code points that are hashed together, so that arrays stay in the cache.
TOGETHER = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_PARAGRAPH = re.compile(r"\S[^\n]*(?:\n(?![^\S\n]*(?:\n|$))[^\n]*)*")


def gram_digests(points: np.ndarray) -> np.ndarray:
    """Digest of the GRAM code points from each position on."""
    h = points.astype(np.uint64) * np.uint64(_ODD)
    h ^= h >> np.uint64(29)
    size, out, covered = 1, None, 0
    while True:
        if GRAM & size:  # put the powers of two that make up GRAM side by side
            if out is None:
                out = h
            else:
                out = out[: len(h) - covered] * np.uint64(pow(_BASE, size, 1 << 64)) + h[covered : covered + len(out)]
            covered += size
        if size * 2 > GRAM:
            break
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h = out[: len(points) - GRAM + 1].copy()
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _slide(pick, values: np.ndarray, width: int) -> np.ndarray:
    """pick (minimum or maximum) over every window of ``width`` values."""
    size, out = 1, values
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1])


def anchors(texts: list[str], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, digests) of the anchors of each text; all texts have at
    least ``least`` code points."""
    width = least - GRAM + 1
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = gram_digests(points)
    for end in ends[:-1]:
        h[end - GRAM + 1 : end] = _NONE  # these reach over into the next text
    low = _slide(np.minimum, h, width)
    pad = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero((_slide(np.maximum, np.concatenate([pad, low, pad]), width) == h) & (h != _NONE))
    digests = h[chosen].view(np.int64)
    cuts = np.searchsorted(chosen, ends)
    out, a = [], 0
    for k, b in enumerate(cuts):
        out.append((chosen[a:b] - (ends[k] - sizes[k]), digests[a:b]))
        a = b
    return out


def paragraphs(text: str, least: int) -> dict[int, int]:
    """Where each paragraph of ``least`` code points begins, and where it ends."""
    found = ((m.start(), m.start() + len(m[0].rstrip())) for m in _PARAGRAPH.finditer(text))
    return {start: stop for start, stop in found if stop - start >= least}


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for b, size in enumerate(sizes):
        if held and held + size > TOGETHER:
            yield a, b
            a, held = b, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


def _anchor_rows(least: int):
    """Over (key, text): (digest, key, at) of every anchor and, with -1 - at,
    of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _groups([len(t) for t in texts]):
                found = anchors(texts[a:b], least)
                whole = [(k, -1 - start, _digest(texts[k][start:stop])[0]) for k in range(a, b) for start, stop in paragraphs(texts[k], least).items()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([*(d for _, d in found), np.array([d for *_, d in whole], np.int64)])),
                        pa.array(np.concatenate([np.repeat(keys[a:b], [len(p) for p, _ in found]), keys[[k for k, *_ in whole]]])),
                        pa.array(np.concatenate([*(p for p, _ in found), np.array([at for _, at, _ in whole], np.int64)]).astype(np.int32)),
                    ],
                    names=["digest", "key", "at"],
                )

    return run


_CONTEXT = "doc bigint, digest bigint, start int, before int, context string, u1 bigint, u2 bigint, stop int"


def _contexts(least: int):
    """Over (doc, text, hits): the text around each anchor; each paragraph as a
    unit (u1, u2, doc, start, stop)."""
    around = least - GRAM
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
                ends = paragraphs(text, least) if any(h["at"] < 0 for h in hits) else {}
                for hit in hits:
                    at = hit["at"]
                    if at >= 0:
                        start = max(0, at - around)
                        rows.append((doc, hit["digest"], start, at - start, text[start : at + least], None, None, None))
                    elif stop := ends.get(-1 - at):
                        start = -1 - at
                        rows.append((doc, hit["digest"], start, None, None, *_digest(text[start:stop]), stop))
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _CONTEXT.split(", ")])

    return run


def _digest(text: str) -> tuple[int, int]:
    raw = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


_UNIT = "u1 bigint, u2 bigint, doc bigint, start int, stop int"


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in range(5)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["u1", "u2", "doc", "start", "stop"])


def _windows(least: int):
    """Over (doc, start, context): every window of a context as a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, context in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(*_digest(context[k : k + least]), doc, start + k, start + k + least) for k in range(len(context) - least + 1)]
            yield _unit_batch(rows)

    return run


def common(a: str, b: str) -> int:
    """How many first characters two strings have in common."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:  # the first ``low`` agree, the first ``high`` don't
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def _compared(least: int):
    """Over (held), the occurrences of one anchor: what they have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for held in batch.column(0).to_pylist():
                classes: dict[tuple[str, str], list[tuple[int, int]]] = {}
                for o in held:
                    left, right = o["context"][: o["before"]][::-1], o["context"][o["before"] :]
                    classes.setdefault((left, right), []).append((o["doc"], o["start"] + o["before"]))
                shapes = list(classes)
                for i, (left, right) in enumerate(shapes):
                    own = classes[left, right]
                    if len(own) > 1 and len(left) + len(right) >= least:
                        u = _digest(left[::-1] + right)
                        rows += [(*u, doc, at - len(left), at + len(right)) for doc, at in own]
                    for other_left, other_right in shapes[:i]:
                        back, ahead = common(left, other_left), common(right, other_right)
                        if ahead >= GRAM and back + ahead >= least:
                            u = _digest(left[:back][::-1] + right[:ahead])
                            rows += [(*u, doc, at - back, at + ahead) for doc, at in [*own, *classes[other_left, other_right]]]
            yield _unit_batch(rows)

    return run


def _all_pairs(sets: DataFrame, keys: list[str], member: str, size: str, a: str, b: str) -> DataFrame:
    """(keys, a, b), a < b: the pairs of the members of each set, of which
    ``size`` says how many it has.  One side of a large set is dealt out to
    parts, the other goes to each of them."""
    parts = F.ceil(F.col(size) / PAIRED_TOGETHER).cast("int")
    left = sets.select(*keys, F.col(member).alias(a), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = sets.select(*keys, F.col(member).alias(b), F.pmod(F.xxhash64(member), parts).cast("int").alias("part"))
    return left.join(right, [*keys, "part"]).where(F.col(a) < F.col(b))


class SharedSpans:
    """The shared spans of one table of documents.

    ``texts``: (doc_id, first, size) of documents of at least ``least`` code
    points, where first is the least doc_id with the same text.  ``units``:
    (u1, u2, doc, start, stop) of every unit that several different texts have;
    doc is the first document with the text.

    Null ids, null texts and texts under ``least`` code points share nothing.
    Repeated rows count once; an id has one text, and where its rows differ
    only what one of them holds is sure to be found.  Texts are compared character by character, case
    and white space included; repetition inside one text is no case.  Extra
    columns don't matter; an empty table gives empty results."""

    def __init__(self, documents: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text"):
        if least < 2 * GRAM:
            raise ValueError(f"spans have at least {2 * GRAM} code points")
        text = documents[text_col]
        docs = documents.where(documents[id_col].isNotNull() & (F.length(text) >= least)).select(
            documents[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1")
        )
        ids = cut(docs.select("doc_id", "t1", F.xxhash64(F.lit(1), "text").alias("t2"), F.length("text").alias("size")).distinct())
        copies = ids.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        self.texts = ids.join(copies, ["t1", "t2"]).select("doc_id", "first", "size", "copies")
        rows, run = "digest bigint, key bigint, at int", _anchor_rows(least)
        # anchors are found twice rather than kept: they'd take as much room as the texts
        often = docs.select("t1", "text").mapInArrow(run, rows).groupBy("digest").agg(F.min("key").alias("a"), F.max("key").alias("b"))
        often = often.where("a <> b").select("digest")
        hits = docs.select("doc_id", "text").mapInArrow(run, rows).join(often, "digest").withColumnRenamed("key", "doc_id")
        firsts = ids.join(copies, ["t1", "t2"]).where("doc_id = first").select("doc_id")
        # an inner join, for a semi join would be moved before the one that leaves few anchors
        per_doc = hits.join(firsts.distinct(), "doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("digest", "at")).alias("hits"))
        # rows are repeated rarely; where they are, one of them is taken without another shuffle
        with_text = docs.select("doc_id", "text").join(per_doc, "doc_id").select("doc_id", "text", "hits").dropDuplicates(["doc_id"])
        contexts = cut(with_text.mapInArrow(_contexts(least), _CONTEXT).where((F.length("context") >= least) | F.col("u1").isNotNull()))
        whole = contexts.where("u1 IS NOT NULL").select("u1", "u2", "doc", "start", "stop")
        contexts = contexts.where("u1 IS NULL").select("doc", "digest", "start", "before", "context")
        count = contexts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
        around = contexts.join(count, "digest")
        held = around.where(F.col("n") <= COMPARED).groupBy("digest").agg(F.collect_list(F.struct("doc", "start", "before", "context")).alias("held"))
        compared = held.select("held").mapInArrow(_compared(least), _UNIT)
        windows = around.where(F.col("n") > COMPARED).select("doc", "start", "context").mapInArrow(_windows(least), _UNIT)
        self.units = cut(whole.unionAll(compared).unionAll(windows).distinct())

    def _shared(self) -> DataFrame:
        """Units of several texts: u1, u2, the first document that has it, and
        what tells its set of documents from others."""
        per = self.units.select("u1", "u2", "doc").distinct().groupBy("u1", "u2")
        h, g = F.xxhash64("doc"), F.xxhash64(F.lit(1), "doc")
        per = per.agg(F.count("*").alias("n"), F.min("doc").alias("earliest"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"))
        return per.where("n > 1")

    def members(self) -> DataFrame:
        """(doc_id, earliest, start, stop): for every document each unit that
        it shares, with the least document that has it, its representative.
        One row per unit and document, however many have it."""
        shared = self._shared().select("u1", "u2", F.col("earliest"))
        held = self.units.join(shared, ["u1", "u2"]).select("doc", "start", "stop", "earliest")
        spread = self.texts.select("doc_id", F.col("first").alias("doc"))
        whole = self.texts.where("copies > 1").select("doc_id", F.col("first").alias("earliest"), F.lit(0).alias("start"), F.col("size").alias("stop"))
        return held.join(spread, "doc").select("doc_id", "earliest", "start", "stop").unionByName(whole).distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b, of all documents that share a span.
        Units with one and the same set of documents give their pairs once.  A
        set of many documents is paired in parts, so that no task makes all
        pairs of one; ``members`` has the same links without making them."""
        one = self._shared().groupBy("n", "x", "y").agg(F.min(F.struct("u1", "u2")).alias("u"))
        sets = self.units.join(one.select("u.u1", "u.u2", "n"), ["u1", "u2"]).select("u1", "u2", "n", "doc").distinct()
        between = _all_pairs(sets, ["u1", "u2"], "doc", "n", "doc", "other").select("doc", "other").distinct()
        spread = self.texts.select(F.col("first").alias("doc"), F.col("doc_id").alias("a"))
        spread_b = self.texts.select(F.col("first").alias("other"), F.col("doc_id").alias("b"))
        out = between.join(spread, "doc").join(spread_b, "other").select("a", "b")
        within = _all_pairs(self.texts.where("copies > 1").select("first", "doc_id", "copies"), ["first"], "doc_id", "copies", "a", "b").select("a", "b")
        out = out.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
        # the pairs of two texts and those of one text never meet
        return out.unionAll(within.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))

    def stretches(self, rest_only: bool = False) -> DataFrame:
        """(doc_id, start, stop): the characters of each document that lie in a
        span some other document has too, as maximal stretches.

        ``rest_only``: of every unit the occurrence in the document with the
        least id is kept, and only what the others hold comes out: the
        stretches to remove, by their offsets in the original text."""
        shared = self._shared().select("u1", "u2", "earliest")
        held = self.units.join(shared, ["u1", "u2"])
        if rest_only:
            held = held.where("doc <> earliest")
        spread = self.texts.select("doc_id", F.col("first").alias("doc"))
        parts = held.select("doc", "start", "stop").distinct().join(spread, "doc").select("doc_id", "start", "stop")
        whole = self.texts.where("copies > 1")
        if rest_only:
            whole = whole.where("doc_id <> first")
        parts = parts.unionAll(whole.select("doc_id", F.lit(0).alias("start"), F.col("size").alias("stop")))
        order = Window.partitionBy("doc_id").orderBy("start", "stop")
        reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(F.col("start") > reach, 1).otherwise(0)
        merged = parts.withColumn("island", fresh).withColumn("island", F.sum("island").over(order))
        return merged.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def shared_characters(documents: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shared): for every document with an id how many of its
    characters lie in a span that another document has too; 0 where none."""
    per = SharedSpans(documents, least, id_col, text_col).stretches().groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared"))
    ids = documents.where(documents[id_col].isNotNull()).select(documents[id_col].cast("bigint").alias("doc_id")).distinct()
    return ids.join(per, "doc_id", "left").select("doc_id", F.coalesce("shared", F.lit(0).cast("bigint")).alias("shared"))


def without_shared(documents: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the documents without the stretches that an earlier
    document has too; null texts stay null."""
    gone = SharedSpans(documents, least, id_col, text_col).stretches(rest_only=True)
    per = gone.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    docs = documents.select(documents[id_col].cast("bigint").alias("doc_id"), documents[text_col].alias("text"))
    begins = F.concat(F.array(F.lit(0)), F.col("gone.stop"))
    ends = F.concat(F.col("gone.start"), F.array(F.length("text")))
    kept = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring(F.col("text"), x["b"] + 1, x["e"] - x["b"]))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return docs.join(per, "doc_id", "left").select("doc_id", text.alias("text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).pairs()


def p7_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).stretches()


def p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).members()


def p7_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_characters(table(spark, sf_dir, "documents"))

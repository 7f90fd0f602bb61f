"""Cutting oversized spans of pages into pieces under a limit.

Method: structure-tree packing.  A span is a tree: sections by heading level,
across pages; pages where no heading stands; blocks (paragraphs, listings,
tables, lists); sentences or lines; words.  Each page is parsed once, into
marks: places where a node of the tree begins, with the node's depth.  Packing
works on marks and lengths alone: sibling subtrees are merged bottom-up as long
as they fit, and only a node that alone exceeds the limit is opened.  Texts are
fetched again only to write the pieces out.

The pages of a span come in order as a stream.  Of every node that is open only
the last part can still grow, so a task holds one part for each level and the
few pages an overlap may reach back to, however long the span is.

Sizes are in tokens of four characters: a page has its characters divided by 4,
rounded down; a part of a page has them rounded up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.pages import holding, page_text
from quire.session import cut, table

#: Depths of the tree; headings have depth 1 to 6.
PAGE, BLOCK, SENTENCE, WORD, NOWHERE = 7, 8, 9, 10, 15
NAMES = {PAGE: "page", BLOCK: "block", SENTENCE: "sentence", WORD: "word", NOWHERE: "character"}
#: Sentences longer than this, or than the least limit, have their words marked.
LONG_SENTENCE = 400

_LINE = re.compile(r"[^\n]*\n?")
_FENCE = re.compile(r"\s*(```|~~~)")
_HASHES = re.compile(r"(#{1,6})\s+\S")
_NUMBERED = re.compile(r"(?:chapter\s+)?(\d{1,3}(?:\.\d{1,3}){0,4})\.?\s+\w[^.!?;:|]{0,90}$", re.IGNORECASE)
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s")
_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+")
_SPACE = re.compile(r"\s+")


def marks(text: str, long: int = LONG_SENTENCE) -> list[int]:
    """Where nodes of the tree begin inside a text: offset * 16 + depth, in
    order, each offset once with its least depth; at 0 only a heading."""
    least: dict[int, int] = {}

    def mark(at: int, depth: int) -> None:
        if (0 < at or depth < PAGE) and at < len(text) and least.get(at, NOWHERE) > depth:
            least[at] = depth

    def prose(start: int, stop: int) -> None:
        at = start
        for end in [*(m.end() for m in _END.finditer(text, start, stop)), stop]:
            if at > start:
                mark(at, SENTENCE)
            if end - at > long:
                for m in _SPACE.finditer(text, at, end):
                    mark(m.end(), WORD)
            at = end

    fence, kind, begun, at = "", "blank", 0, 0
    for line in _LINE.findall(text):
        if not line:
            break
        end, bare = at + len(line), line.strip()
        if fence:
            now = "listing"
            if bare.startswith(fence):
                fence = ""
        elif m := _FENCE.match(line):
            fence, now = m[1], "listing"
            mark(at, BLOCK)
        elif not bare:
            now = "blank"
        elif m := _HASHES.match(bare):
            now = "heading"
            mark(at, len(m[1]))
        elif kind in ("blank", "heading") and (m := _NUMBERED.match(bare)):
            now = "heading"
            mark(at, min(6, 1 + m[1].count(".")))
        elif bare[0] == "|":
            now = "table"
        elif _ITEM.match(line):
            now = "item"
        else:
            now = "item" if kind == "item" and line[0] in " \t" else "prose"
        if now != kind:
            if kind == "prose":
                prose(begun, at)
            if now != "blank":
                mark(at, BLOCK)
            begun = at
        elif now in ("listing", "table", "item"):
            mark(at, SENTENCE)
        if now in ("listing", "table", "item") and len(line) > long:
            prose(at, end)
        kind, at = now, end
    if kind == "prose":
        prose(begun, len(text))
    return [at * 16 + depth for at, depth in sorted(least.items())]


def open_node(start: int, stop: int, inside: list[tuple[int, int]], limit: int) -> list[tuple[int, int, int]]:
    """Cut characters start..stop of one page into parts of at most ``limit``
    tokens.  ``inside`` has the marks (offset, depth) between.  Returns
    (start, stop, depth of the boundary it starts at)."""
    most = 4 * limit
    if stop - start <= most:
        return [(start, stop, 0)]
    if not inside:
        return [(at, min(at + most, stop), NOWHERE if at > start else 0) for at in range(start, stop, most)]
    depth = min(d for _, d in inside)
    parts: list[tuple[int, int, int]] = []
    edges = [start, *(at for at, d in inside if d == depth), stop]
    k = 0
    for a, b in zip(edges, edges[1:]):
        below = []
        while k < len(inside) and inside[k][0] < b:
            if inside[k][0] > a:
                below.append(inside[k])
            k += 1
        for n, (s, e, d) in enumerate(open_node(a, b, below, limit)):
            if n == 0 and a > start:
                d = depth
            # merge siblings, and what is left of an opened one, while they fit
            if parts and e - parts[-1][0] <= most and d > 0:
                parts[-1] = (parts[-1][0], e, parts[-1][2])
            else:
                parts.append((s, e, d))
    return parts


def _tokens(start: int, stop: int, length: int) -> int:
    return (stop - start) // 4 if start == 0 and stop == length else -(-(stop - start) // 4)


Place = tuple[int, int]  # a page's place in the span, and an offset


class Packer:
    """Packs the pages of one span, fed in order, into pieces of at most
    ``most`` tokens.  ``overlap`` tokens, or up to half as much again to begin
    at a boundary, are shared with the piece before; an overlap above half of
    the limit is taken as half, for pieces must get on."""

    def __init__(self, most: int, overlap: int):
        self.most, self.overlap = most, max(0, min(overlap, most // 2))
        self.slack = self.overlap // 2
        self.room = most - self.overlap - self.slack  # what is left beside an overlap
        self.pages: dict[int, tuple[int, int, list[int]]] = {}
        self.before: dict[int, int] = {}  # tokens of all pages before one
        self.least, self.next, self.total = 0, 0, 0
        # open nodes from the root down: depth, the part that may grow (start, stop, depth), whether it was opened
        self.stack: list[list] = [[0, None, False]]
        self.made = 0

    def size(self, start: Place, stop: Place) -> int:
        (k, a), (m, z) = start, stop
        if k == m:
            return _tokens(a, z, self.pages[k][1])
        return _tokens(a, self.pages[k][1], self.pages[k][1]) + self.before[m] - self.before[k + 1] + _tokens(0, z, self.pages[m][1])

    def feed(self, page: int, length: int, page_marks: list[int]) -> Iterator[dict]:
        """Take the next page; pieces that can't grow any more come out."""
        if not length:
            return
        k = self.next
        self.pages[k], self.before[k] = (page, length, page_marks), self.total
        self.next, self.total = k + 1, self.total + length // 4
        self.before[k + 1] = self.total
        heads = [(m >> 4, m & 15) for m in page_marks if m & 15 < PAGE]
        if not heads or heads[0][0]:
            heads.insert(0, (0, PAGE))
        for (at, depth), (end, _) in zip(heads, [*heads[1:], (length, 0)]):
            while self.stack[-1][0] >= depth:
                yield from self._close()
            self.stack.append([depth, None, False])
            if self.size((k, at), (k, end)) <= self.room:
                self.stack[-1][1] = ((k, at), (k, end), depth)
            else:
                inside = [(m >> 4, m & 15) for m in page_marks if at < m >> 4 < end]
                for n, (a, z, d) in enumerate(open_node(at, end, inside, self.room)):
                    yield from self._append(((k, a), (k, z), d if n else depth))
        self._forget()

    def finish(self) -> Iterator[dict]:
        while len(self.stack) > 1:
            yield from self._close()
        if self.stack[0][1]:
            yield self._piece(self.stack[0][1])

    def _append(self, part: tuple) -> Iterator[dict]:
        """A part that doesn't fit the last one of the top node: the node is
        open, and so are those above it, whose parts are done."""
        if self.stack[-1][1]:
            for node in self.stack:
                if node[1]:
                    yield self._piece(node[1])
                    node[1] = None
                node[2] = True
        self.stack[-1][1] = part

    def _close(self) -> Iterator[dict]:
        _, part, opened = self.stack.pop()
        above = self.stack[-1]
        if part is None:
            return
        if opened:
            above[1], above[2] = part, True  # all before it is out
        elif above[1] and self.size(above[1][0], part[1]) <= self.room:
            above[1] = (above[1][0], part[1], above[1][2])
        else:
            yield from self._append(part)

    def _piece(self, part: tuple) -> dict:
        (k, start), (m, stop), depth = part
        own = self.size((k, start), (m, stop))
        here = (k, start)
        if self.made and self.overlap:
            here = _step_back(self.pages, self.least, k, start, self.overlap, self.overlap + self.slack)
        self.made += 1
        tokens = self.size(here, (m, stop))
        return {
            "piece": self.made - 1, "first_page": self.pages[here[0]][0], "start": here[1], "own_page": self.pages[k][0], "own_start": start, "last_page": self.pages[m][0], "stop": stop,
            "tokens": tokens, "overlap": tokens - own, "boundary": NAMES.get(depth, "heading"), "inside": any(self.pages[i][1] // 4 > self.most for i in range(k, m + 1)),
        }

    def _forget(self) -> None:
        """Drop the pages that neither an open part nor an overlap reaches."""
        first = min((node[1][0][0] for node in self.stack if node[1]), default=self.next)
        while self.least < first and self.before[first] - self.before[self.least + 1] >= self.overlap + self.slack:
            del self.pages[self.least], self.before[self.least]
            self.least += 1


def pack_span(pages: list[tuple[int, int, list[int]]], most: int, overlap: int) -> list[dict]:
    """The pieces of the pages (page, length, marks) of one span, in order."""
    packer = Packer(most, overlap)
    return [piece for p in pages for piece in packer.feed(*p)] + list(packer.finish())


def _step_back(pages: dict, first: int, k: int, start: int, least: int, most: int) -> Place:
    """Where an overlap of ``least`` to ``most`` tokens before (k, start)
    begins: at the mark of least depth, the nearest of those, else at the
    character that gives exactly ``least``.  Less only where there is less text."""
    taken, at = 0, start
    while True:
        if at == 0:
            if k == first:
                return k, 0
            k -= 1
            at = pages[k][1]
            continue
        length = pages[k][1]
        whole = _tokens(0, at, length)
        if taken + whole < least:
            taken, at = taken + whole, 0
            continue
        low, high = at - 4 * (most - taken), at - 4 * (least - taken)
        best = None
        for m in pages[k][2]:
            if max(low, 1) <= m >> 4 <= high and (best is None or m & 15 <= best & 15):
                best = m
        if taken + whole <= most and (best is None or best & 15 >= PAGE):
            return k, 0
        return k, best >> 4 if best is not None else max(high, 0)


def page_marks(page_texts: DataFrame, long: int = LONG_SENTENCE) -> DataFrame:
    """(book, page, length, marks) of every page, by the row that holds.  Texts
    are parsed where they are scanned and never move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).to_pylist()
            lengths = pa.array([len(t) for t in texts], pa.int32())
            found = pa.array([marks(t, long) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lengths, found], names=["book", "page", "extracted_at", "loaded_at", "length", "marks"])

    rows = page_texts.select("book", F.col("page").cast("int").alias("page"), "extracted_at", "loaded_at", page_text(page_texts).alias("text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("book", "page", "extracted_at", "loaded_at"))
    return holding(rows.mapInArrow(run, f"{kinds}, length int, marks array<bigint>"), F.col("length"), F.col("marks"))


def split_spans(spans: DataFrame, page_texts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Pieces of every span whose size exceeds max_tokens of its budget.

    Returns (span_id, piece, first_page, start, own_page, own_start, last_page,
    stop, tokens, overlap, boundary, inside): a piece runs from character
    ``start`` of first_page to ``stop`` of last_page; what comes before own_page
    and own_start is the overlap with the piece before, of ``overlap`` tokens.
    boundary says at what kind of place it begins; inside whether one of its
    pages alone exceeds the limit.  No piece is above the limit.  Neighbours
    share overlap_tokens of the budget, up to half as much again where that
    reaches a boundary; an overlap above half of max_tokens counts as half.

    Spans with a null id, book, page or budget, and empty ranges, are left out;
    repeated rows count once; a page without a row is empty.  A page that no
    span needs costs no more than its parse."""
    limits = budgets.where("max_tokens > 0").select("budget", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")).dropDuplicates(["budget"])
    tightest = limits.agg(F.min("max_tokens")).first()[0] or LONG_SENTENCE  # one row of a table of settings
    pages = cut(page_marks(page_texts, min(LONG_SENTENCE, tightest)))
    last = pages.groupBy("book").agg(F.max("page").alias("last"))
    wanted = spans.select("span_id", "book", "page_start", "page_end", "budget").distinct()
    # greatest and least pass over nulls, so these go first
    wanted = wanted.where("span_id IS NOT NULL AND page_start IS NOT NULL AND page_end IS NOT NULL")
    wanted = wanted.join(limits, "budget").join(last, "book")
    wanted = wanted.withColumn("a", F.greatest("page_start", F.lit(1))).withColumn("b", F.least("page_end", "last")).where("a <= b")
    on_page = wanted.select("span_id", "book", "max_tokens", "overlap", F.explode(F.sequence("a", "b")).alias("page"))
    size = F.sum(F.expr("length div 4"))
    big = on_page.join(pages.select("book", "page", "length"), ["book", "page"]).groupBy("span_id").agg(size.alias("size"), F.first("max_tokens").alias("m"))
    big = big.where("size > m").select("span_id")
    rows = on_page.join(big, "span_id", "left_semi").join(pages, ["book", "page"]).select("span_id", "max_tokens", "overlap", "page", "length", "marks")
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "span_id").sortWithinPartitions("span_id", "page")
    fields = "first_page int, start int, own_page int, own_start int, last_page int, stop int, tokens int, overlap int, boundary string, inside boolean"
    names = [f.split()[0] for f in fields.split(", ")]
    kind = spans.schema["span_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for batch in batches:
            out: list[tuple] = []
            id_type = batch.schema.field(0).type
            for span, most, overlap, page, length, page_marks_ in zip(*(c.to_pylist() for c in batch.columns)):
                if packer is None or span != now:
                    if packer is not None:
                        out += [(now, p) for p in packer.finish()]
                    now, packer = span, Packer(most, overlap)
                out += [(now, p) for p in packer.feed(page, length, page_marks_)]
            yield from _numbered(out, id_type, names)
        if packer is not None:
            yield from _numbered([(now, p) for p in packer.finish()], id_type, names)

    return ordered.mapInArrow(pack, f"span_id {kind}, piece int, {fields}")


def _numbered(rows: list[tuple[int, dict]], id_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    kinds = {"boundary": pa.string(), "inside": pa.bool_()}
    columns = [pa.array([s for s, _ in rows], id_type), pa.array([p["piece"] for _, p in rows], pa.int32())]
    columns += [pa.array([p[n] for _, p in rows], kinds.get(n, pa.int32())) for n in names]
    yield pa.RecordBatch.from_arrays(columns, names=["span_id", "piece", *names])


def piece_texts(pieces: DataFrame, spans: DataFrame, page_texts: DataFrame) -> DataFrame:
    """(span_id, piece, tokens, boundary, text): the pieces with their
    text, pages joined by an empty line.  Texts move once, by page."""
    rows = page_texts.select("book", "page", "extracted_at", "loaded_at", page_text(page_texts).alias("text"))
    texts = holding(rows, F.col("text"))
    books = spans.where("span_id IS NOT NULL").select("span_id", "book").distinct()
    on_page = pieces.join(books, "span_id").withColumn("page", F.explode(F.sequence("first_page", "last_page")))
    start = F.when(F.col("page") == F.col("first_page"), F.col("start")).otherwise(0)
    length = F.when(F.col("page") == F.col("last_page"), F.col("stop")).otherwise(F.length("text")) - start
    part = on_page.join(texts, ["book", "page"]).withColumn("part", F.substring("text", start + 1, length)).where("part <> ''")
    whole = part.groupBy("span_id", "piece").agg(
        F.first("tokens").alias("tokens"), F.first("boundary").alias("boundary"), F.sort_array(F.collect_list(F.struct("page", "part"))).alias("parts")
    )
    return whole.select("span_id", "piece", "tokens", "boundary", F.array_join("parts.part", "\n\n").alias("text"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_spans(table(spark, sf_dir, "spans"), table(spark, sf_dir, "page_texts"), table(spark, sf_dir, "budgets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.max("inside"), "inside").otherwise("page")
    return _pieces(spark, sf_dir).groupBy("span_id").agg(kind.alias("cut"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_texts(_pieces(spark, sf_dir), table(spark, sf_dir, "spans"), table(spark, sf_dir, "page_texts"))

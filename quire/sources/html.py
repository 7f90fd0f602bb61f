"""HTML as blocks: headings, paragraphs, listings, list items and tables, with
the anchors that lead to them.  Lenient: unclosed tags end with their parent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by what they are.
HEADINGS = {f"h{k}": k for k in range(1, 7)}
BREAKING = {"p", "div", "section", "article", "blockquote", "li", "ul", "ol", "table", "tr", "pre", "figure", "figcaption", "dt", "dd", "body", *HEADINGS}
SILENT = {"script", "style", "head", "nav", "template"}
BLOCK_SCHEMA = "pos int, kind string, level int, text string, anchors array<string>"
_BLANK = re.compile(r"[\s\xa0]+")


def squeeze(text: str) -> str:
    return _BLANK.sub(" ", text).strip()


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.anchors: list[str] = []
        self.kind, self.level, self.silent, self.pre = "text", 0, 0, 0
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.scripts: list[tuple[str, int]] = []

    def flush(self) -> None:
        raw = "".join(self.text)
        self.text = []
        if self.pre:
            text = "\n".join(line.rstrip() for line in raw.replace("\xa0", " ").strip("\n").split("\n"))
        else:
            text = "\n".join(filter(None, map(squeeze, raw.split("\x00"))))
        if text.strip() and self.rows is None:
            if self.kind == "item" and self.lists:
                text = "  " * (len(self.lists) - 1) + text
            self.out.append({"pos": len(self.out), "kind": self.kind, "level": self.level, "text": text, "anchors": self.anchors})
            self.anchors = []
        elif text.strip():
            self.rows[-1][-1:] = [squeeze((self.rows[-1][-1] if self.rows[-1] else "") + " " + text)] if self.rows and self.rows[-1] else []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BREAKING:
            self.flush()
            if self.rows is None and tag not in ("body", "ul", "ol"):
                self.kind, self.level = "paragraph", 0
        named = dict(attrs)
        for key in ("id", "name"):
            if named.get(key) and (key == "id" or tag == "a"):
                self.anchors.append(named[key])
        if tag in HEADINGS:
            self.kind, self.level = "heading", HEADINGS[tag]
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            self.kind = "item"
            if self.lists:
                self.lists[-1][1] += 1
                self.text.append("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. ")
        elif tag == "pre":
            self.kind, self.pre = "listing", self.pre + 1
        elif tag == "br":
            self.text.append("\n" if self.pre else "\x00")
        elif tag == "table" and self.rows is None:
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.flush()
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        elif tag in ("sup", "sub"):
            self.scripts.append((tag, len(self.text)))

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and self.silent:
            self.silent -= 1
        if tag in ("sup", "sub") and self.scripts and self.scripts[-1][0] == tag:
            _, at = self.scripts.pop()
            inner = squeeze("".join(self.text[at:]))
            mark = "^" if tag == "sup" else "_"
            self.text[at:] = [f"{mark}{{{inner}}}" if len(inner) > 1 else mark + inner if inner else ""]
        if tag in BREAKING or tag in ("td", "th"):
            self.flush()
        if tag == "pre" and self.pre:
            self.pre -= 1
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag == "table" and self.rows is not None:
            self._table()
        if tag in BREAKING and self.rows is None:
            self.kind, self.level = "text", 0

    def _table(self) -> None:
        rows, self.rows = [r for r in self.rows or [] if r], None
        full = [c for r in rows for c in r if c]
        if len(rows) == 1 and len(full) == 1:  # a call-out, not data
            kind, text = "quote", "> " + full[0]
        elif full:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            kind, text = "table", "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])
        else:
            return
        self.out.append({"pos": len(self.out), "kind": kind, "level": 0, "text": text, "anchors": self.anchors})
        self.anchors = []

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def html_blocks(html: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    if parser.rows is not None:
        parser._table()
    if parser.anchors and parser.out:
        parser.out[-1]["anchors"] += parser.anchors
    return parser.out


def blocks(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, kind, level, text, anchors) of every HTML document; a null or
    empty one has no blocks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"id": i, **b} for i, html in zip(*(c.to_pylist() for c in batch.columns)) for b in html_blocks(html)]
            schema = pa.schema([("id", batch.schema.field(0).type), ("pos", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("anchors", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(docs[id_col].alias("id"), docs[html_col].alias("html")).mapInArrow(run, f"id {kind}, {BLOCK_SCHEMA}")

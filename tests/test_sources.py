import os
import zipfile
from datetime import datetime

import pytest

from quire.sources import log, sinks
from quire.sources.epub import read_books
from quire.sources.html import html_blocks

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="m" href="mark.xhtml"/><item id="b" href="b%20two.xhtml"/>
<item id="skip" href="skip.xhtml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="m"/><itemref idref="a"/><itemref idref="skip" linear="no"/><itemref idref="b"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>First &nbsp; part</text></navLabel><content src="a.xhtml"/>
<navPoint><navLabel><text>Inner</text></navLabel><content src="a.xhtml#in"/></navPoint></navPoint><navPoint><navLabel><text>Second</text></navLabel><content src="b%20two.xhtml#gone"/></navPoint></navMap></ncx>"""


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "one.epub"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OPS/p.opf", PACKAGE)
        z.writestr("OPS/toc.ncx", NCX)
        z.writestr("OPS/mark.xhtml", "<p>Copy of pat.lee@mail.test</p>")
        z.writestr("OPS/a.xhtml", "<h1>Start</h1><p>Text.</p><h2 id='in'>Inner</h2><pre>a = 1</pre><pre>b = 2</pre>")
        z.writestr("OPS/b two.xhtml", "<p>Last</p>")
        z.writestr("OPS/skip.xhtml", "<p>Never</p>")
    return str(path)


def test_epub_pages_and_bookmarks(spark, book):
    pages, marks = read_books(spark, os.path.dirname(book))
    assert [(r.title, r.level, r.page) for r in marks.orderBy("idx").collect()] == [("First part", 0, 1), ("Inner", 1, 2), ("Second", 0, 2)]
    assert [(r.book, r.page, r.text) for r in pages.orderBy("page").collect()] == [("one", 1, "# Start\n\nText."), ("one", 2, "## Inner\n\n```\na = 1\nb = 2\n```\n\nLast")]


def test_epub_pages_close_when_full(spark, book):
    pages, marks = read_books(spark, os.path.dirname(book), most=6)
    assert [r.text for r in pages.orderBy("page").collect()] == ["# Start", "Text.", "## Inner", "```\na = 1\nb = 2\n```", "Last"]
    assert [r.page for r in marks.orderBy("idx").collect()] == [1, 3, 5]


def test_html_is_lenient():
    found = html_blocks("<p>a<p>b<b>c<table><tr><td>only one</table><div id=x>d<br>e")
    assert [b["text"] for b in found] == ["a", "bc", "> only one", "d\ne"] and found[-1]["anchors"] == ["x"]
    assert html_blocks(None) == html_blocks("") == []


def test_owned_files(spark, tmp_path):
    root = sinks.claim(str(tmp_path / "out"))
    ours = "---\ngenerator: quire\n---\n\nText"
    (tmp_path / "out" / "theirs.md").write_text("mine")
    files = spark.createDataFrame([("a/n.md", ours), ("theirs.md", ours), (None, "x")], "path string, text string")
    for _ in range(2):
        assert {r.path: r.outcome for r in sinks.write_files(files, root).collect()} == {"a/n.md": "written", "theirs.md": "not ours"}
    assert (tmp_path / "out" / "theirs.md").read_text() == "mine"
    with pytest.raises(ValueError):
        sinks.write_owned(root, "../x.md", ours)
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "f").write_text("")
    with pytest.raises(PermissionError):
        sinks.claim(str(tmp_path), "full")
    with pytest.raises(ValueError):
        sinks.claim(root, "../full")
    assert sinks.header("---\na: b: c\n---\ngenerator: quire\n") == {"a": "b: c"} and sinks.header("---\ngenerator: quire\n") == sinks.header("x") == {}


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([(datetime(2024, 1, 1, 10), 1, "chunk", "ready", {"n": "3"})], "ts timestamp, pid int, stage string, message string, extra map<string,string>")
    log.append(events, path)
    (tmp_path / "log" / "day=2024-01-02").mkdir()
    (tmp_path / "log" / "day=2024-01-02" / "x.json").write_text("not json\n")
    assert [r.line for r in log.tail(log.read(spark, path)).collect()] == ["10:00:00 chunk ready n=3", "not json"]


def test_copies(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"picture")
    root = sinks.claim(str(tmp_path / "out"))
    files = spark.createDataFrame([(str(tmp_path / "a.png"), "a.png"), (str(tmp_path / "gone.png"), "../gone.png"), (None, "x")], "source string, name string")
    for _ in range(2):
        found = {os.path.basename(r.source): r.outcome for r in sinks.copy_files(files, root, "attachments/b").collect()}
        assert found == {"a.png": "written", "gone.png": "missing"}
    assert (tmp_path / "out" / "attachments" / "b" / "a.png").read_bytes() == b"picture"

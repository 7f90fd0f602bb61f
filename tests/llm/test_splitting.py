from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.splitting import Packer, marks, open_node, pack_span, piece_texts, split_spans

TEXT = st.text(alphabet="ab. \n#|-`\r1é", max_size=400)
PAGE = "book string, page int, layer string, extracted string, extracted_at timestamp, loaded_at timestamp, title string"
SPAN = "span_id bigint, book string, page_start int, page_end int, budget string, title string"
BUDGET = "budget string, max_tokens int, overlap_tokens int"
DAY = datetime(2024, 1, 1)


@given(TEXT, st.integers(1, 30))
def test_parts_cover_a_page_and_keep_the_limit(text, limit):
    inside = [(m >> 4, m & 15) for m in marks(text) if m >> 4]
    parts = open_node(0, len(text), inside, limit)
    assert "".join(text[a:b] for a, b, _ in parts) == text
    assert all(b - a <= 4 * limit for a, b, _ in parts)


@settings(max_examples=60)
@given(st.lists(TEXT, max_size=8), st.integers(8, 60), st.integers(0, 12))
def test_pieces_cover_a_span(texts, most, overlap):
    pages = [(k, len(t), marks(t)) for k, t in enumerate(texts, 1)]
    pieces = pack_span(pages, most, overlap)
    by = dict(enumerate(texts, 1))
    cut = lambda p, a, q, z: "".join(by[k][(a if k == p else 0) : (z if k == q else None)] for k in range(p, q + 1))
    assert "".join(cut(x["own_page"], x["own_start"], x["last_page"], x["stop"]) for x in pieces) == "".join(texts)
    for n, x in enumerate(pieces):
        assert x["tokens"] <= most and x["piece"] == n
        # the overlap is as wanted wherever there is so much text before
        before = sum(len(by[k]) // 4 for k in range(1, x["own_page"])) + x["own_start"] // 4
        assert not n or x["overlap"] >= min(min(overlap, most // 2), before) - 1
        whole = cut(x["first_page"], x["start"], x["last_page"], x["stop"])
        assert whole.endswith(cut(x["own_page"], x["own_start"], x["last_page"], x["stop"]))


def test_only_a_page_above_the_limit_counts_as_inside():
    assert not any(p["inside"] for p in pack_span([(1, 399, []), (2, 399, [])], 100, 10))
    assert any(p["inside"] for p in pack_span([(1, 404, []), (2, 399, [])], 100, 10))


def section(head, n):
    return f"{head}\n\n" + "Aa bb. " * n


def test_sections_go_over_pages():
    # two chapters over several small pages; a limit that holds either, not both
    texts = [section("# One", 20), "Cc dd. " * 20, "Ee ff. " * 9 + "\n\n" + section("# Two", 10), section("## Two a", 20), "Gg hh. " * 20]
    pages = [(k, len(t), marks(t)) for k, t in enumerate(texts, 1)]
    pieces = pack_span(pages, 140, 0)
    at = texts[2].index("# Two")
    assert [(p["own_page"], p["own_start"], p["boundary"]) for p in pieces] == [(1, 0, "heading"), (3, at, "heading")]
    # 88 tokens of One fit; Two has 92 and is opened at its own subsection, no page is cut elsewhere
    pieces = pack_span(pages, 90, 0)
    assert [(p["own_page"], p["own_start"], p["boundary"]) for p in pieces] == [(1, 0, "heading"), (3, at, "heading"), (4, 0, "heading")]
    # a section opened at its pages, where it has no subsection; the next one is not merged into its rest
    pieces = pack_span(pages, 80, 0)
    assert [(p["own_page"], p["own_start"], p["boundary"]) for p in pieces] == [(1, 0, "heading"), (3, 0, "page"), (3, at, "heading"), (4, 0, "heading")]


def test_a_task_holds_few_pages_of_a_long_span():
    packer, text = Packer(100, 20), "Aa bb. " * 30
    held, out = 0, 0
    for k in range(1, 5001):
        out += len(list(packer.feed(k, len(text), marks(text))))
        held = max(held, len(packer.pages))
    assert held < 10 and out > 1500


def test_overlap_above_half_of_the_limit_is_half():
    text = "Aa bb. " * 200
    pieces = pack_span([(1, len(text), marks(text))], 40, 39)
    assert all(20 <= p["overlap"] <= 30 and p["tokens"] <= 40 for p in pieces[3:])  # there are 20 tokens before


def test_cuts_at_headings_before_sentences():
    text = "# One\n\n" + "Aa bb. " * 30 + "\n\n# Two\n\n" + "Cc dd. " * 30
    at = text.index("# Two")
    assert [a for a, _, _ in open_node(0, len(text), [(m >> 4, m & 15) for m in marks(text) if m >> 4], 60)] == [0, at]


def test_split_spans_edges(spark):
    long = "word " * 500
    pages = spark.createDataFrame(
        [("b", 1, None, long, DAY, DAY, "x"), ("b", 1, None, "poor", None, DAY, "x"), ("b", 2, "layer", None, None, DAY, None),
         ("b", 3, None, "", DAY, DAY, None), ("b", 2, "layer", None, None, DAY, None), (None, 1, "z", None, None, None, None)], PAGE)
    spans = spark.createDataFrame(
        [(1, "b", 1, 3, "small", "t"), (1, "b", 1, 3, "small", "t"), (2, "b", 2, 3, "small", "t"), (3, "b", None, 3, "small", "t"),
         (4, "b", 3, 1, "small", "t"), (5, None, 1, 3, "small", "t"), (6, "b", 1, 2**31 - 1, "small", "t"), (7, "b", 1, 1, None, "t")], SPAN)
    budgets = spark.createDataFrame([("small", 100, 10), ("none", None, None)], BUDGET)
    pieces = split_spans(spans, pages, budgets).cache()
    assert {r.span_id for r in pieces.collect()} == {1, 6}
    assert all(r.tokens <= 100 and r.inside for r in pieces.where("last_page = 1").collect())
    texts = piece_texts(pieces, spans, pages).where("span_id = 1").collect()
    assert len(texts) == pieces.where("span_id = 1").count() and all(len(r.text) <= 402 for r in texts)
    for a, b, c in ((spans.limit(0), pages, budgets), (spans, pages.limit(0), budgets), (spans, pages, budgets.limit(0))):
        assert split_spans(a, b, c).count() == 0

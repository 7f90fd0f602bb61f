from datetime import datetime

import pytest

from quire.llm import scan_noise
from quire.llm.scan_noise import LONG, ScanNoise, apply_edits, digits_undone, distance, form_keys, recase, word_keys

DAY = datetime(2024, 1, 1)
CLEAN = "The turbine releases the lubricant near the high-pass filter and the symmetric impeller connects the invariant. Pre- and post-treatment of low- and high-pass work. Of VZ-1204 at 300 bar. "
NOISY = (
    "The title of it   7\nThe tiirbine releases the lu-\nbricant near the high-\npass fi1ter and the symmetnc im\npeller connects the in¬\nvariant of VZ-\n3137 at 5l2 bar.\n"
    "Pre-\nand post-treatment of low-\nand high-pass work, the turb-\n- 12 -"
)
SECOND = "The title of it   8\nine releases."


def test_parts():
    assert distance("tiirbine", "turbine") == distance("symmetnc", "symmetric") == pytest.approx(0.3)
    assert digits_undone("5l2") == "512" and digits_undone("VZ-3l37") == "VZ-3137" and digits_undone("512") is digits_undone("Sol") is digits_undone("fi1ter") is None
    assert recase("Tiirbine", "turbine") == "Turbine" and recase("TURB1NE", "turbine") == "TURBINE"


@pytest.mark.parametrize("read, right", [("tiirbine", "turbine"), ("rny", "my"), ("a|s", "as"), ("ys", "vs"), ("ab", "6b"), ("symmetnc", "symmetric")])
def test_index(read, right):
    assert form_keys(read) & word_keys(right)


@pytest.mark.parametrize("n", [LONG - 4, LONG - 1, LONG, LONG + 1, LONG + 4, 300])
def test_index_of_long_words(n):
    word = ("overmolecular" * 40)[:n]
    for read in (word.replace("m", "rn", 1), word.replace("cu", "c|u", 1).replace("l", "1", 1), word.replace("e", "c", 1).replace("a", "o", 1), word[:-5] + "'" + word[-5:], word[1:]):
        assert distance(read, word) <= 1 and form_keys(read) & word_keys(word)


def tables(spark):
    make = spark.createDataFrame
    pages = [("b", 1, None, NOISY), ("b", 2, None, SECOND), ("b", 3, None, CLEAN * 3)]
    text = "\n\n".join(p[3] for p in pages)
    return (
        make([("b", "The title of it", 1)], "slug string, title string, n int"),
        make([("b", None, 1)], "book string, title string, n int"),
        make([(1, "b", 1, 3, text), (1, "b", 1, 3, text), (2, "b", 3, 3, None), (3, None, 1, 1, "x"), (None, "b", 1, 1, "x"), (4, "b", 3, 3, CLEAN * 3)], "chunk_id bigint, book string, page_start int, page_end int, text string"),
        make([(9, "b", 1, "Figure 1. The tur\nbine and the irnpeller"), (9, "b", 1, "Figure 1. The tur\nbine and the irnpeller"), (10, "b", 1, None), (11, "b", 1, ""), (12, "b", 3, "The irnpeller")], "figure_id bigint, book string, page int, caption string"),
        make([(b, p, a, t, DAY, DAY) for b, p, a, t in pages], "book string, page int, layer string, extracted string, extracted_at timestamp, loaded_at timestamp"),
        make([("b", [1, 2]), ("b", None), (None, [1]), ("b", [])], "book string, ocr_pages array<int>"),
    )


def test_repairs(spark):
    noise = ScanNoise(*tables(spark))
    found = {(r.rec_id, r.kind, r.value) for r in noise.repairs().collect()}
    assert found == {
        (1, "header", "The title of it   7"), (1, "header", "The title of it   8"), (1, "page_number", "- 12 -"), (1, "misread", "turbine"),
        (1, "misread", "filter"), (1, "misread", "symmetric"), (1, "misread", "512"), (1, "hyphen", "lubricant"), (1, "hyphen", "high-pass"),
        (1, "hyphen", "impeller"), (1, "hyphen", "invariant"), (1, "hyphen", "VZ-3137"), (1, "hyphen", "turbine"), (9, "hyphen", "turbine"), (9, "misread", "impeller"),
    }
    texts = {r.rec_id: r.text for r in noise.repaired().collect()}
    assert set(texts) == {1, 9} and texts[9] == "Figure 1. The turbine and the impeller"
    assert "the turbine releases." in " ".join(texts[1].split()) and "title" not in texts[1] and "- 12 -" not in texts[1]
    assert CLEAN * 3 in texts[1]


def test_held_words_only_save_work(spark, monkeypatch):
    # "the" and "rapist" are frequent, "therapist" is rarer; "shal-low" is a compound of words
    clean = "Oh the man. A rapist. " * 30 + "Ask therapist. " * 25 + "Both shal. A low. " * 5 + "Some shallow. " * 5
    page = "Ask the\nrapist of both shal-low."
    rows = [("b", 1, None, page, DAY, DAY), ("b", 2, None, clean, DAY, DAY)]
    make = spark.createDataFrame
    given = (
        make([("b", "Title", 1)], "slug string, title string, n int"), make([("b", None, 1)], "book string, title string, n int"),
        make([(1, "b", 1, 1, page), (2, "b", 2, 2, clean)], "chunk_id bigint, book string, page_start int, page_end int, text string"),
        make([], "figure_id bigint, book string, page int, caption string"),
        make(rows, "book string, page int, layer string, extracted string, extracted_at timestamp, loaded_at timestamp"), make([("b", [1])], "book string, ocr_pages array<int>"),
    )
    found = {}
    for held in (0, 5, 10, 50_000, 10**6):
        monkeypatch.setattr(scan_noise, "HELD_WORDS", held)
        found[held] = {(r.kind, r.value) for r in ScanNoise(*given).repairs().collect()}
    assert all(f == {("hyphen", "therapist")} for f in found.values())


def test_patterns_of_the_corpus_decide(spark):
    # in the 1990s is meant, 199Os is not; K7/3l is like nothing known, 3l mm is a number
    clean = "Built in the 1990s, or the 1980s or the 1970s. Code AB/1234/X and AB/5555/X and AB/9000/X. All 31 mm, 32 mm, 45 mm. " * 2
    page = "Since the 1960s and 199O or AB/12S4/X and K7/3l at 3l mm of AB/-\n7777/X and the\n1950s."
    make = spark.createDataFrame
    rows = [("b", 1, None, page, DAY, DAY), ("b", 2, None, clean, DAY, DAY)]
    given = (
        make([("b", "Title", 1)], "slug string, title string, n int"), make([("b", None, 1)], "book string, title string, n int"),
        make([(1, "b", 1, 1, page), (2, "b", 2, 2, clean), (2, "b", 2, 2, clean)], "chunk_id bigint, book string, page_start int, page_end int, text string"),
        make([], "figure_id bigint, book string, page int, caption string"),
        make(rows, "book string, page int, layer string, extracted string, extracted_at timestamp, loaded_at timestamp"), make([("b", [1])], "book string, ocr_pages array<int>"),
    )
    found = {(r.kind, r.value) for r in ScanNoise(*given).repairs().collect()}
    assert found == {("misread", "31")}


def test_long_forms_and_short_titles(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosisrelatedness"
    clean = f"Known {long} here. " * 4
    head = "Map" + " " * 4 + "7"
    page = head + f"\nSeen {long.replace('m', 'rn', 1)} and {long[:20]}-\n{long[20:]} too.\n" + "body text " * 30
    make = spark.createDataFrame
    rows = [("b", 7, None, page, DAY, DAY), ("b", 8, None, clean, DAY, DAY)]
    given = (
        make([("b", "Map", 1)], "slug string, title string, n int"), make([("b", None, 1)], "book string, title string, n int"),
        make([(1, "b", 7, 7, page), (2, "b", 8, 8, clean)], "chunk_id bigint, book string, page_start int, page_end int, text string"),
        make([], "figure_id bigint, book string, page int, caption string"),
        make(rows, "book string, page int, layer string, extracted string, extracted_at timestamp, loaded_at timestamp"), make([("b", [7])], "book string, ocr_pages array<int>"),
    )
    found = {(r.kind, r.value) for r in ScanNoise(*given).repairs().collect()}
    assert {("misread", long), ("hyphen", long), ("header", head)} <= found


def test_paragraphs_of_mixed_chunks():
    pages = [("A head\nOne para-\ngraph on\ntwo lines.\n\nThe next\none, bro", True), ("ken.\nIt ends.", True), ("As it\nwas.\n\n\n  Kept. ", False), ("Last\npage.\n7", True)]
    text = "\n\n".join(t for t, _ in pages)
    segments = [{"length": len(t), "scanned": scanned} for t, scanned in pages]
    edit = lambda read, kind, value=None: {"start": text.index(read), "stop": text.index(read) + len(read), "kind": kind, "value": value}
    edits = [edit("A head", "header"), edit("para-\ngraph", "hyphen", "paragraph"), edit("bro\n\nken", "hyphen", "broken"), edit("7", "page_number")]
    assert apply_edits(text, segments, edits) == "One paragraph on two lines.\n\nThe next one, broken. It ends.\n\nAs it\nwas.\n\n\n  Kept. \n\nLast page."
    assert apply_edits("As\nit was", [{"length": 9, "scanned": False}], []) == "As\nit was"


def test_empty(spark):
    empty = [t.limit(0) for t in tables(spark)]
    assert ScanNoise(*empty).repairs().count() == 0

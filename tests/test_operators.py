from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import cleaning, figures, files, listing, notes, outline, plan, planning, stages, state, verify
from quire.sources import sinks
from quire.streaming.queue import consume, event_stream, windowed_counts

DAY = datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    assert one(spark, T.slugify(F.lit("  !?  "))) == "untitled"
    assert one(spark, T.padded_section(F.lit("4.2.10"))) == "04.02.10"
    assert one(spark, T.chapter_number(F.lit("1-Wire bus"))) is None
    assert one(spark, T.section_number(F.lit("1.8.Argument"))) == "1.8"
    assert [tuple(r) for r in one(spark, T.page_ranges(F.lit("60-120, 131")))] == [(60, 120), (131, 131)]
    with pytest.raises(Exception, match="not a range"):
        one(spark, T.page_ranges(F.lit("9-x")))
    box = F.struct(F.lit(72.0).alias("l"), F.lit(172.0).alias("t"), F.lit(144.0).alias("r"), F.lit(72.0).alias("b"))
    assert tuple(one(spark, T.bbox_to_pixels(box, 792.0, dpi=72, pad=0.0))) == (72, 620, 144, 720)


def test_spans_tile(spark):
    rows = [("b", 0, "1 A", 0, 71), ("b", 1, "1.1 B", 1, 73), ("b", 2, "1.2 C", 1, 74), ("b", 3, "2 D", 0, 90), ("b", 4, "Back", 0, 10), ("b", 5, "End", 0, 120)]
    found = outline.spans(outline.entries(spark.createDataFrame(rows, "book string, idx int, title string, level int, page int")), spark.createDataFrame([("b", 131)], "book string, last int"))
    assert [(r.page_start, r.page_end) for r in found.orderBy("idx").collect()] == [(71, 72), (73, 73), (74, 89), (90, 119), (10, 119), (120, 131)]


def test_parents_of_deep_outlines(spark):
    levels = [0, 11, 12, 13, 14, 13, None, 2]
    outlined = spark.createDataFrame([("b", k, level) for k, level in enumerate(levels)], "book string, idx int, level int")
    assert [r.parent for r in outline.parents(outlined).orderBy("idx").collect()] == [None, 0, 1, 2, 3, 2, None, 0]


def test_groups_of_outline_units(spark):
    # (level, chapter, tokens): groups by hand, 6000 at most and 3000 at least
    rows = [(0, 1, 100), (1, 1, 1000), (2, 1, 800), (2, 1, 900), (1, 1, 200), (2, 1, 1500), (2, 1, 1600), (1, 1, 400), (1, 1, 5000), (2, 1, 3000), (1, 1, 20), (0, 2, 30), (0, None, 60)]
    spans = spark.createDataFrame([("b", k, *r) for k, r in enumerate(rows)], "book string, idx int, level int, chapter int, tokens int")
    found = planning.group_units(spans, 6000, 3000).orderBy("idx").collect()
    assert [r.grp for r in found] == [0, 0, 0, 0, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r.into for r in found] == [0, 0, 0, 0, 1, 1, 1, 2, 3, 4, 4, None, 7]


def test_slices_end_before_sections(spark):
    opens_section = lambda text: bool(planning.section_heads(text))
    texts = ["x\n## 2.1 1 Title 7", "2.1 shows\n2.2 A ..... 7\n3 Title", "1.2 1 lower", "# 4.2 (a)", "", "a\r\n12.3\tŁódź\r\nb"]
    given = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    assert [r.o for r in given.orderBy("k").select(T.opens_section(F.col("text")).alias("o")).collect()] == [opens_section(t) for t in texts]
    assert opens_section("x\n## 2.1 1 Title 7") and not opens_section("2.1 shows\n2.2 A ..... 7\n3 Title") and not opens_section(None)
    rows = [("b", p, n, opens) for p, n, opens in ((1, 0, False), (2, 50, True), (3, 10, False), (4, 10, True), (5, 30, False), (6, 10, True))]
    pages = spark.createDataFrame(rows, "book string, page int, length int, opens boolean")
    assert [(r.first_page, r.last_page) for r in planning.slice_pages(pages, 10, 4).orderBy("slice").collect()] == [(1, 2), (3, 4), (5, 5), (6, 6)]


def test_bands_by_exact_distance(spark):
    rows = [(1, 1, 10.0, 0.0, None), (2, 2, 11.9, 0.0, ""), (3, 3, 8.0, 0.0, None), (4, 4, 12.1, 0.0, None), (5, 1, 90.0, 0.0, None), (6, 2, 90.0, 3.9, None), (7, 1, 50.0, 0.0, "A"), (8, 2, 50.0, 0.0, "B")]
    given = spark.createDataFrame([(i, "b", p, (x, t + 20.0, 99.0, t), c) for i, p, x, t, c in rows], "figure_id bigint, book string, page int, bbox struct<l:double,t:double,r:double,b:double>, caption string")
    assert sorted(r.figure_id for r in figures.bands(given, pages=2).collect()) == [1, 2, 3]


def test_navigation_twice_is_once(spark):
    text = F.lit("Body\n")
    once = notes.apply_navigation(text, F.lit("← [[a]]"))
    assert one(spark, once) == one(spark, notes.apply_navigation(once, F.lit("← [[a]]"))) == "Body\n\n---\n← [[a]]\n"
    assert one(spark, notes.apply_navigation(once, F.lit(None).cast("string"))) == "Body\n"


def test_verify_exact_and_found(spark):
    source = "```\nint main() {\n    return 0;\n}\n```\n| a | b |\n|---|---|\n| one |  |\n"
    note = "```\nint main() {\n  return 0;\n}\n```\n| one | two | x |\n"
    pairs = spark.createDataFrame([(1, "c", note, source), (2, "c", None, source)], "id int, chapter string, note string, source string")
    rows = {r.id: r for r in verify.report(pairs).collect()}
    assert (rows[1].lines, rows[1].lines_lost, rows[1].lines_exact) == (3, 0, 2)
    assert (rows[1].rows, rows[1].rows_lost) == (2, 1) and "unwritten" in rows[2].problems
    total = verify.summary(verify.report(pairs)).first()
    assert (total.notes, total.written) == (2, 1)


def test_state_with_null_keys(spark):
    events = spark.createDataFrame([("b", None, 1, "running", DAY), ("b", None, 2, "done", DAY), ("b", 7, 3, "failed", DAY)], "book string, chunk int, id int, status string, ts timestamp")
    work = events.select("book", "chunk").distinct()
    assert [r.chunk for r in state.todo(work, events, ["book", "chunk"]).collect()] == [7]
    runs = spark.createDataFrame([("vision",), ("vision:fig",), ("visionary",)], "stage string")
    assert [r.stage for r in state.without_stage(runs, "vision").collect()] == ["visionary"]


def test_stop(spark):
    jobs = spark.createDataFrame([(1, "queued", False), (2, "running", False), (3, "done", False)], "id int, status string, stop boolean")
    found = {r.id: (r.status, r.stop) for r in state.stop_requested(jobs).collect()}
    assert found == {1: ("stopped", True), 2: ("running", True), 3: ("done", False)}
    assert {r.id: r.status for r in state.recovered(state.stop_requested(jobs)).collect()}[2] == "stopped"


def test_model_stage(spark):
    class Loses:
        def complete(self, prompt):
            code = "```\nx = 1\n```" if "Keep these lines" in prompt else ""
            return f"## In short\n\na\n\n## Explanation\n\nb\n\n## Code\n\n{code}"

    source = "```\nx = 1\n```"
    work = spark.createDataFrame([(1, "p", source), (2, "p", "x" * 30000), (3, None, None)], "id int, prompt string, source string")
    rows = {r.id: r for r in stages.generate(work, Loses).collect()}
    assert "x = 1" in rows[1].sections["Code"] and rows[2].status == "failed" and rows[3].status == "done"
    with pytest.raises(KeyError):
        stages.render("{{nothing}}")
    note = F.lit("![[b/f.png]]\n*caption pending*\n")
    text = stages.insert_description(note, F.lit("f.png"), F.lit("costs $1 \\ 2"))
    assert one(spark, text) == "![[b/f.png]]\n*costs $1 \\ 2*\n"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, DAY, "view") for k in range(5)], "event_id int, ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in" / "events.parquet"))
    seen = []
    query = consume(event_stream(spark, str(tmp_path / "in"), "events.parquet"), lambda df, k: seen.append((k, df.count())), str(tmp_path / "at"))
    query.awaitTermination()
    assert sum(n for _, n in seen) == 5
    windows = windowed_counts(event_stream(spark, str(tmp_path / "in"), "events.parquet"))
    windows.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").first().events == 5


def book(spark, marks, pages):
    outlined = spark.createDataFrame([("b", k, *m) for k, m in enumerate(marks)], "book string, idx int, title string, level int, page int")
    last = spark.createDataFrame([("b", len(pages))], "book string, last int")
    texts = spark.createDataFrame([("b", k, t) for k, t in enumerate(pages, 1)], "book string, page int, text string")
    return plan.span_pages(plan.planned_spans(outline.entries(outlined), last), texts)


def test_plan_of_a_numbered_book(spark):
    fill = lambda word, n: " ".join([word] * n)
    pages = [
        "Contents", f"# Chapter 1 Start\n\n{fill('alpha', 90)}\n\n## 1.1 First\n\n{fill('beta', 100)}", f"{fill('gamma', 100)}\n\n1.2 Second\n\n{fill('delta', 100)}",
        "", f"## 1.3 Third\n\n```\nx = 1\n## 2 Next\n```\n{fill('eps', 200)}", fill("zeta", 100),
    ]
    marks = [("Contents", 0, 1), ("Chapter 1 Start", 0, 2), ("1.1 First", 1, 2), ("1.2 Sec ond", 1, 3), ("1.3 Third", 1, 5), ("2 Next", 0, 5)]
    parts = book(spark, marks, pages).cache()
    assert parts.where("title = 'Contents'").count() == 0
    text = {(r.span, r.page): r.text for r in parts.collect()}
    assert text[1, 2].endswith("alpha") and text[2, 2].startswith("## 1.1 First") and "delta" not in text[2, 3] and text[3, 3].startswith("1.2 Second")
    # a title inside a listing cuts it there; both halves are whole listings
    assert text[4, 5].endswith("x = 1\n```") and text[5, 5].startswith("```\n## 2 Next")
    chunks = plan.plan(parts, 300, 150).orderBy("ord").collect()
    # 139, 278, 152, 7, 204 and 124 tokens: the chapter's section must be cut, 1.3 is folded into 1.2, the second half of 2 into the first
    assert [(c.section, c.title, c.chapter, c.page_start, c.page_end, c.parts) for c in chunks] == [
        ("1", "Start", 1, 2, 2, []), ("1.1", "First", 1, 2, 3, []), ("1.2", "Second", 1, 3, 5, ["1.2 Second", "1.3 Third"]), ("2", "Next", 2, 5, 6, []),
    ]
    whole = {r.ord: r.text for r in plan.chunk_texts(plan.plan(parts, 300, 150), parts).collect()}
    assert whole[1].startswith("# Chapter 1 Start") and whole[2].endswith("gamma") and whole[2].startswith("## 1.1") and "delta" in whole[3] and whole[4].endswith("zeta")


def test_outlines_against_the_rules(spark):
    make = lambda rows: outline.entries(spark.createDataFrame([("b", k, *r) for k, r in enumerate(rows)], "book string, idx int, title string, level int, page int"))
    last = spark.createDataFrame([("b", 50)], "book string, last int")
    # an unnumbered sibling of 1.1.1 stands under 1.1; under a chapter alone is not deep
    assert outline.deep(make([("1.1 A", 0, 1), ("1.1.1 B", 1, 2), ("C", 1, 3)])).first().deep
    assert not outline.deep(make([("1 A", 0, 1), ("B", 1, 2), ("1.1 C", 0, 3), ("D", 0, 4)])).first().deep
    # ranges: what repeats the number belongs to the section, apparatus beside it doesn't, the last one ends with the book
    rows = [("Preface", 0, 1), ("1.1 A", 0, 3), ("Lesson", 1, 4), ("1.1 A again", 1, 6), ("1.2 B", 0, 9), ("Index", 1, 12), ("Index", 0, 20), ("1.2 B", 0, 30)]
    found = outline.section_ranges(make(rows), last).orderBy("run").collect()
    assert [(r.title, r.page_start, r.page_end) for r in found] == [("Preface", 1, 2), ("1.1 A", 3, 8), ("1.2 B", 9, 19), ("Index", 20, 29), ("1.2 B", 30, 50)]
    # a course: the title slide goes, apparatus gets no number
    rows = [("Title slide", 0, 1), ("About this document", 0, 2), ("Basics", 0, 3), ("Setup", 1, 4), ("Slide", 2, 5), ("Use", 1, 6), ("Licensing", 0, 7), ("Last slides", 0, 8), ("Thanks", 1, 9)]
    found = outline.number_outline(make(rows)).orderBy("idx").collect()
    assert [(r.number, r.dropped) for r in found] == [(None, True), (None, False), ("1", False), ("1.1", False), (None, False), ("1.2", False), ("2", False), (None, False), (None, False)]
    # an appendix at the chapter's level ends the chapter
    rows = [("Chapter 1 A", 0, 1), ("x", 1, 2), ("1.1 y", 1, 2), ("Appendix", 0, 9), ("z", 1, 10)]
    assert [r.chapter for r in outline.chapters(make(rows)).orderBy("idx").collect()] == [1, 1, 1, None, None]


def test_even_cuts_and_names():
    sizes, opens = [4000] * 6 + [1200], [False] * 7
    assert planning.even_cuts(sizes, opens, 6000, 3000) == [0, 0, 0, 1, 1, 1, 1]  # under 3306 tokens, not 3149
    assert planning.even_cuts([100], [True], 6000, 3000) == [0] and planning.even_cuts([50000, 10], [False] * 2, 6000, 3000) == [0, 1]
    assert planning.unique_in_order(["a", "a-2", "a", "a", "b"]) == ["a", "a-2", "a-3", "a-4", "b"]


def test_kinds_of_pictures(spark):
    # chain: 0 and 4 bits are 4 apart, 0b11110000 is 4 from that and 8 from the first
    rows = [(1, 0, 1, 10.0), (2, 0b1111, 5, 10.0), (3, 0b11110000, 6, 10.0), (4, 0, 21, 11.9), (5, 0, 40, 12.1), (6, 0b11111111, 41, 10.0), (7, None, 50, 10.0)]
    given = spark.createDataFrame([("b", i, h, p, w, 10.0) for i, h, p, w in rows], "book string, id int, hash bigint, page int, width double, height double")
    assert {r.id: r.kind for r in figures.kinds(given).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 2}
    assert sorted(r.id for r in figures.repeated(given).collect()) == [1, 2, 3, 4]
    assert figures.repeated(given, span=21).count() == 0
    pictures = spark.createDataFrame([("b", 1, None), ("b", 2, "kept"), ("b", 6, "")], "book string, id int, caption string")
    assert sorted(r.id for r in figures.without_repeated(pictures, given).collect()) == [2, 6]


def test_listing_layout(spark):
    cell = lambda row, x, c, width=6.0, blank=False: ("b", 1, 1, c, 10.0 + x, 100.0 - 10 * row, 10 + x + width, 108.0 - 10 * row, blank)
    rows = [cell(0, 6.0 * k, c) for k, c in enumerate("if x:") if c != " "] + [cell(1, 24 + 6.0 * k, c) for k, c in enumerate("y“a”")]
    rows += [cell(2, -30, "N", 9.0), cell(2, -19, "o", 4.0), cell(2, -14.9, "t", 3.0, True)] + [cell(3, 6.0 * k + (1.5 if k else 0), c) for k, c in enumerate("ab")]
    glyphs = spark.createDataFrame(rows, "book string, page int, box int, text string, left double, bottom double, right double, top double, space_before boolean")
    # prose left of the code doesn't move its margin; a narrow gap is a blank
    assert listing.layout(glyphs).first().text.split("\n") == ["if x:", '    y"a"', "N o t", "a b"]
    assert listing.layout(glyphs.limit(0)).count() == 0


def test_figures_of_bad_ranges(spark):
    pictures = spark.createDataFrame([(k, "b", k) for k in (1, 2, 3)], "figure_id int, book string, page int")
    chunks = spark.createDataFrame([(1, "b", 2, 1), (2, "b", 2, 2**31 - 1), (3, "b", None, 3), (4, "c", 1, 3)], "chunk_id int, book string, page_start int, page_end int")
    assert sorted(map(tuple, figures.in_chunks(pictures, chunks).collect())) == [(2, 2), (2, 3)]


def test_verify_cells_code_and_switch(spark):
    source = "```\nx = 1\n```\n| $\\mu$A | \\leftarrow b |\n|---|---|\n| &#124;a | 5 Ω |\n| mov ax | 17 |\n| alone | here |\n"
    note = "---\ntags: a@b.cd\n---\n```\nMOV AX, 17\n```\n| μA | ← b |\n| a | 5 Ω | |\n"
    pairs = spark.createDataFrame([(1, "c", note, source, False), (2, "c", note, source, None), (3, "c", None, source, True)], "id int, chapter string, note string, source string, listings boolean")
    rows = {r.id: r for r in verify.report(pairs).collect()}
    assert (rows[1].rows, rows[1].rows_lost) == (4, 1)
    assert (rows[1].lines, rows[1].lines_lost, rows[2].lines, rows[2].lines_lost) == (0, 0, 1, 1)
    total = verify.summary(verify.report(pairs)).first()
    assert (total.notes, total.written, total.lines, total.lines_found, total.rows, total.rows_found, total.flagged) == (3, 2, 1, 0, 8, 6, 2)
    chunks = spark.createDataFrame([("b", 1, 1, source), ("b", 2, 1, source)], "book string, chunk_id int, chapter int, text string")
    notes_ = spark.createDataFrame([("b", 1, note)], "book string, chunk_id int, note string")
    found = {r.id.chunk_id: r for r in verify.check_plan(chunks, notes_).collect()}
    assert found[1].written and found[1].stray_mail is None and not found[2].written
    assert one(spark, verify.body(F.lit("a\n---\nb"))) == "a\n---\nb"


def test_glossary_keeps_its_sources(spark):
    entries = spark.createDataFrame([("n2", 0, "Gate", "bramka"), ("n1", 1, "gate", "brama"), ("n1", 0, "node", "węzeł"), ("n2", 3, "gate", "x")], "id string, pos int, term string, translation string")
    assert sorted(map(tuple, notes.merge_glossary(entries).collect())) == [("gate", "brama", 2, ["n1", "n2"]), ("node", "węzeł", 1, ["n1"])]


def test_watermarks_leave_one_blank(spark):
    mark, once = "0123456789abcdef" * 2, "f" * 31 + "1"
    rows = [("b", 1, f"one {mark}  two\n{mark} three\nfour {mark}\n{once}"), ("b", 2, mark), ("b", 3, f"x{mark} {mark}"), ("c", 1, once), ("b", 4, None)]
    pages = spark.createDataFrame(rows, "book string, page int, text string")
    found = {(r.book, r.page): r.text for r in cleaning.without_watermarks(pages).collect()}
    assert found == {("b", 1): f"one two\nthree\nfour\n{once}", ("b", 2): "", ("b", 3): f"x{mark}", ("c", 1): once, ("b", 4): None}


def test_language_can_be_set(spark):
    pages = spark.createDataFrame([("a", 1, "żółw ślimak"), ("b", 1, "żółw ślimak"), ("c", 1, ""), ("d", 1, "plain")], "book string, page int, text string")
    given = spark.createDataFrame([("a", "EN"), ("b", None)], "book string, language string")
    assert {r.book: r.language for r in cleaning.language(pages, settings=given).collect()} == {"a": "en", "b": "pl", "c": "en", "d": "en"}


def test_a_stage_goes_on_where_it_ended(spark):
    class Fails(stages.ExtractiveModel):
        def complete(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("no answer")
            return super().complete(prompt)

    work = spark.createDataFrame([(k, p, "Source text.") for k, p in ((1, "done before"), (2, "bad"), (3, "fine"), (4, "stopped"))], "id int, prompt string, source string")
    events = spark.createDataFrame([(1, 5, "done", DAY), (1, 4, "failed", DAY), (3, 1, "failed", DAY)], "id int, event int, status string, ts timestamp")
    made, new = stages.advance(work, events, Fails, F.lit(DAY), work.where("id = 4"))
    assert {r.id: r.status for r in made.collect()} == {2: "failed", 3: "done"}
    assert sorted((r.id, r.event, r.status) for r in new.collect()) == [(2, 0, "running"), (2, 1, "failed"), (3, 0, "running"), (3, 1, "done")]


def test_runs_and_claims(spark):
    at = lambda k: datetime(2024, 1, 1, k)
    rows = [(1, 1, "running", 1, None), (1, 2, "failed", 2, "e"), (1, 3, "running", 3, None), (2, 4, "running", 1, None), (2, 5, "done", 2, None), (3, 6, "queued", 1, None), (3, 7, "running", 0, None), (3, 9, "running", 2, None), (3, 8, "running", 2, None)]
    events = spark.createDataFrame([(k, i, s, at(t), e) for k, i, s, t, e in rows], "k int, id int, status string, ts timestamp, error string")
    runs = {r.k: (r.status, r.started, r.finished, r.error) for r in state.stage_runs(events, ["k"]).collect()}
    assert runs[1] == ("running", at(3), None, None) and runs[2] == ("done", at(1), at(2), None)
    assert [(r.k, r.id) for r in state.claims(events, ["k"]).collect()] == [(3, 8)]
    jobs = state.enqueued(spark.createDataFrame([(1, "b", 7), (2, "b", None)], "id int, book string, total int"), "generate", "m", F.lit(DAY))
    told = jobs.unionByName(jobs.where("id = 1").withColumn("ts", F.lit(at(9))).withColumn("done", F.lit(3)))
    assert sorted((r.id, r.done, r.total) for r in state.progress(told.withColumn("k", F.col("id")), ["k"]).withColumnRenamed("k", "id").collect()) == [(1, 3, 7), (2, 0, 0)]


def test_files(spark):
    chunks = spark.createDataFrame([("b", 1, 1, 1, "1", "Start: one", 1, 2, " text \n"), ("b", 2, 2, 1, "1.2", "A/B", 3, 4, "x"), ("b", 3, 3, None, "003", None, 5, 5, None), ("c", 4, 1, 2, "2.1", "Other", 1, 1, "y")], "book string, chunk_id int, ord int, chapter int, section string, title string, page_start int, page_end int, text string")
    books = spark.createDataFrame([("b", "A book", None, None)], "slug string, title string, domain string, language string")
    drawn = spark.createDataFrame([(1, "b", "f1", 2, "", "x/f1.png"), (2, "b", "f2", 1, "Shown", "x/f2.png")], "figure_id int, book string, id string, page int, caption string, path string")
    made = {r.chunk_id: r for r in files.export_files(chunks, drawn, books).collect()}
    assert made[1].path == "_source/b/01-start-one/01 Start one.md" and made[2].path == "_source/b/01-start-one/01.02 A - B.md" and made[3].path == "_source/b/00-unsorted/003.md" and made[4].path == "_source/c/02/02.01 Other.md"
    assert made[1].text.endswith("## Figures\n\n![f2.png](../figures/f2.png)\n*Shown*\n\n![f1.png](../figures/f1.png)\n*f1*\n\n## Source text\n\ntext\n") and "## Figures" not in made[2].text
    assert sinks.header(made[2].text) == {"source": '"A book"', "chapter": "1", "section": '"1.2"', "pages": "[3, 4]", "stage": "export", "generator": "quire", "tags": "[general, b, chapter-01]"}
    maps = {r.book: r for r in files.chapter_maps(chunks, books).collect()}
    assert maps["b"].path == "01-start-one/01 Start one — chapter map.md" and not maps["b"].clash and "- [[01.02 A - B]] — pages 3-4\n" in maps["b"].text


def test_chapters_and_heads_of_texts(spark):
    docs = spark.createDataFrame([(1, "before\n# 1.2 Section\n## Chapter 2 Two\nbody\n\n# 3 Three"), (2, "# No number\nx"), (3, ""), (4, None)], "id int, text string")
    assert [tuple(r) for r in notes.chapters(docs, "id", "text").orderBy("part").collect()] == [(1, 0, "", "before\n# 1.2 Section"), (1, 1, "Chapter 2 Two", "## Chapter 2 Two\nbody"), (1, 2, "3 Three", "# 3 Three")]
    heads = spark.createDataFrame([(1, "4.2 Ohm &amp; Co 17\n2.1 1 Split\n6.3 shows it\n7.1 Dots ..... 8\n0.25 (x)")], "id int, text string")
    assert [(r.number, r.title) for r in notes.numbered_heads(heads, ["id"]).orderBy("pos").collect()] == [("4.2", "Ohm & Co"), ("2.11", "Split")]


def test_batches_are_used_again(spark):
    at = lambda k: datetime(2024, 1, 1, k)
    rows = [("b", 1, 40, "cpu", 1, at(1), at(2), 3, [1], "A"), ("b", 1, 40, "cpu", 1, at(1), at(2), 3, [1], "A"), ("b", 1, 40, "cpu", 2, at(3), at(4), 4, [2, 1], None), ("b", 41, 80, "cpu", 3, at(1), at(2), 5, None, None), ("b", 41, 80, "gpu", 4, at(3), None, 6, None, None), ("b", 81, 90, "cpu", 5, None, None, 1, None, None)]
    runs = spark.createDataFrame(rows, "book string, first_page int, last_page int, device string, id int, started timestamp, finished timestamp, figure_count int, ocr_pages array<int>, last_heading string")
    assert [(r.first_page, r.id) for r in state.reusable(runs, ["book", "first_page", "last_page"], ["device"]).collect()] == [(1, 2)]
    some = runs.where("id IN (1, 3)").distinct().withColumn("ocr_pages", F.coalesce("ocr_pages", F.array().cast("array<int>")))
    assert tuple(state.merged(some, "book").first()) == ("b", 2, 8, [1], ["", "A"])


def test_prompts_and_descriptions(spark):
    schema = "id int, section string, title string, page_start int, page_end int, text string, parts array<string>, book_title string, domain string, language string, slides boolean"
    rows = [(1, "1.2", "Loops", 3, 4, "for", ["1.2 Loops", "1.3 Ends"], "C", "Programming", "pl", False), (2, "2", None, 1, 1, None, None, None, None, None, True)]
    asked = {r.id: r.prompt for r in stages.note_prompt(spark.createDataFrame(rows, schema)).collect()}
    assert "in Polish on 1.2 Loops, pages 3-4 of C (Programming textbook)" in asked[1] and "section Code" in asked[1] and "Formulas" not in asked[1] and "- 1.3 Ends" in asked[1] and asked[1].endswith("# Source\n\nfor")
    assert "general training slides" in asked[2] and "section Formulas" in asked[2] and "Cover each" not in asked[2]

    class Sees:
        def complete(self, prompt):
            if "nothing" in prompt:
                raise RuntimeError("no picture")
            return f"A  {prompt.partition('captioned ')[2].partition('.')[0]}\n"

    figures_ = spark.createDataFrame([(1, None, "gate", "near", "en"), (2, "H", "", "near", None)], "id int, heading string, caption string, context string, language string")
    assert {r.id: (r.status, r.error, r.description) for r in stages.describe(figures_, Sees).collect()} == {1: ("done", None, "A gate"), 2: ("failed", "no picture", None)}
    assert [one(spark, notes.contract_name(F.lit(x))) for x in ("Kod", "Code", "Other")] == ["Code", "Code", "Other"]

"""Checking a note against its source: lost listing lines and table rows, mail
addresses and digests the source doesn't have, and notes that are too short.

Everything a comparison needs stands in one row, so lists are compared inside
it and nothing is joined or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

FENCE = r"(?ms)^```[^\n]*\n(.*?)^```"
ROW = r"(?m)^\|[^\n]*\|[ \t]*$"
RULE = r"^\|[ \t:|-]+\|$"
# Commands of mathematics in cells, and what they stand for; the
# micro and ohm signs have code points of their own.
SYMBOLS = (
    "alpha α beta β gamma γ delta δ epsilon ε varepsilon ε zeta ζ eta η theta θ kappa κ lambda λ mu μ nu ν xi ξ pi π rho ρ sigma σ tau τ phi φ "
    "varphi φ chi χ psi ψ omega ω Gamma Γ Delta Δ Theta Θ Lambda Λ Pi Π Sigma Σ Phi Φ Psi Ψ Omega Ω infty ∞ neq ≠ ne ≠ leq ≤ le ≤ geq ≥ ge ≥ "
    "times × cdot · pm ± oplus ⊕ ldots … dots … cap ∩ cup ∪ leftarrow ← gets ← Leftarrow ⇐ Rightarrow ⇒ leftrightarrow ↔ Leftrightarrow ⇔ "
    "approx ≈ equiv ≡ div ÷ neg ¬ lnot ¬ wedge ∧ land ∧ vee ∨ lor ∨ rightarrow → to →"
).split()
LATEX = dict(zip(SYMBOLS[::2], SYMBOLS[1::2]))
ALIKE = ("\u00b5\u2126", "\u03bc\u03a9")
# Entities that stand in tables for what Markdown would read.
ENTITIES = {"&#124;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
DIGEST = r"\b[0-9a-f]{32}\b"


def code_lines(c: Column) -> Column:
    """All lines of the fenced listings of a text, without a trailing blank."""
    blocks = F.regexp_extract_all(T.unix_lines(c), F.lit(FENCE), 1)
    lines = F.flatten(F.transform(blocks, lambda b: F.split(b, "\n", -1)))
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "[ \t\r]+$", "")), lambda x: x != "")


def inline_code(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"`([^`\n]+)`"), 1), lambda x: T.squeeze(x))


def _symbols(c: Column) -> Column:
    """Commands as the signs they stand for.  Split at backslashes, every part
    but the first begins with the name of one, whole or not."""
    names = F.create_map(*(F.lit(x) for pair in LATEX.items() for x in pair))
    name = lambda p: F.regexp_extract(p, "^([A-Za-z]+)", 1)

    def part(p: Column, k: Column) -> Column:
        sign = F.try_element_at(names, name(p))
        return F.when(k == 0, p).when(sign.isNotNull(), F.concat(sign, F.substring(p, F.length(name(p)) + 1, F.length(p)))).otherwise(F.concat(F.lit("\\"), p))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(F.split(c, r"\\", -1), part), "")).otherwise(c)


def cell(c: Column) -> Column:
    """A cell as a book would print it: commands of mathematics as signs, no
    dollars and backticks, entities resolved, signs that look alike as one,
    white space squeezed."""
    out = F.regexp_replace(_symbols(c), "[`$]", "")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return T.squeeze(F.translate(out, *ALIKE))


def table_rows(c: Column) -> Column:
    """Rows of pipe tables as cells joined by " | ", without rules and empty
    cells at the end."""
    rows = F.filter(F.transform(F.regexp_extract_all(T.unix_lines(c), F.lit(ROW), 0), lambda r: F.regexp_replace(r, "[ \t]+$", "")), lambda r: ~r.rlike(RULE))
    bare = F.transform(rows, lambda r: F.regexp_replace(r, r"^\||\|$", ""))
    cells = F.transform(bare, lambda r: F.array_join(F.transform(F.split(r, r"\|", -1), cell), " | "))
    return F.filter(F.transform(cells, lambda r: F.regexp_replace(r, r"(?: \| ?)+$", "")), lambda r: r != "")


def _in_order(cells: Column, other: Column) -> Column:
    """Whether cells stand in order inside a row of strictly more cells."""
    def step(at: Column, x: Column) -> Column:
        rest = F.slice(other, at + 1, F.greatest(F.size(other) - at, F.lit(0)))
        found = F.array_position(rest, x).cast("int")
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

    return (F.size(cells) < F.size(other)) & (F.aggregate(cells, F.lit(0), step) >= 0)


def _commands(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: T.squeezed_command(x)), lambda x: x != "")


def _missing_lines(code: Column, inline: Column, rows: Column, wanted: Column, least: int) -> Column:
    have = F.array_distinct(F.concat(_commands(code), inline, rows))

    def missing(both: Column) -> Column:
        rest = F.array_except(both["wanted"], both["have"])
        # one text of all lines: a line inside it, with no break in it, is inside one of them
        gone = T.let(F.array_join(both["have"], "\n"), lambda whole: F.filter(rest, lambda x: (F.length(x) < least) | ~F.contains(whole, x)))
        return T.let(gone, lambda g: F.filter(both["wanted"], lambda x: F.array_contains(g, x)))

    none = F.array().cast("array<string>")
    return F.when(F.size(wanted) == 0, none).otherwise(T.let(F.struct(wanted.alias("wanted"), have.alias("have")), missing))


def _missing_rows(have: Column, code: Column, wanted: Column, least_words: int) -> Column:
    words = lambda c: F.transform(T.words(c), lambda w: F.lower(w))

    def found(row: Column, have: Column, code: Column) -> Column:
        cells = F.split(row, r" \| ", -1)
        full = F.filter(cells, lambda x: x != "")
        partial = (F.size(full) < F.size(cells)) | (F.size(cells) == 1)
        row_words = words(row)
        named = F.size(F.filter(row_words, lambda w: ~w.rlike(r"^[\p{N}]+$")))
        coded = (named >= least_words) & (F.size(F.array_except(row_words, code)) == 0)
        inside = lambda h: partial & _in_order(full, F.filter(F.split(h, r" \| ", -1), lambda x: x != ""))
        return coded | F.exists(have, inside)

    both = F.struct(have.alias("have"), F.array_distinct(words(F.array_join(code, "\n"))).alias("code"))
    left = lambda b: F.filter(wanted, lambda r: ~(F.array_contains(b["have"], r) | found(r, b["have"], b["code"])))
    return F.when(F.size(F.array_except(wanted, have)) == 0, F.array().cast("array<string>")).otherwise(T.let(both, left))


def lost_lines(note: Column, source: Column, least: int = 8) -> Column:
    """Listing lines of the source that the note has nowhere in its code: not
    as a line, nor, from ``least`` characters on, inside one.  Equal lines are
    taken out as sets; only what is left is searched for inside the rest."""
    return _missing_lines(code_lines(note), inline_code(note), table_rows(note), _commands(code_lines(source)), least)


def lost_rows(note: Column, source: Column, least_words: int = 2) -> Column:
    """Table rows of the source that the note doesn't have: whole; for rows
    with an empty cell or of one cell, in order inside a longer row; or, for
    rows that name ``least_words`` words, with all words in its code."""
    return _missing_rows(table_rows(note), code_lines(note), table_rows(source), least_words)


def report(pairs: DataFrame) -> DataFrame:
    """One row per pair (id, chapter, note, source); a null note is unwritten.
    Counts are of bags: repeated lines count each time.  With a column
    ``listings`` only pairs where it holds are checked for listing lines."""
    listings = F.coalesce("listings", F.lit(True)) if "listings" in pairs.columns else F.lit(True)
    note, source, c = F.coalesce("note", F.lit("")), F.coalesce("source", F.lit("")), F.col
    # parsed once per pair; what is compared with what comes after
    read = pairs.select(
        "id", "chapter", c("note").isNotNull().alias("written"), listings.alias("listings"), note.alias("note"), source.alias("source"), code_lines(note).alias("code"), code_lines(source).alias("wanted"),
        inline_code(note).alias("inline"), table_rows(note).alias("have"), table_rows(source).alias("cells"),
    )
    commands = read.withColumn("commands", _commands(c("wanted")))
    exact = F.filter("wanted", lambda x: F.array_contains("code", x))
    mails = F.array_except(F.regexp_extract_all("note", F.lit(T.MAIL), 0), F.regexp_extract_all("source", F.lit(T.MAIL), 0))
    digest = lambda x: F.filter(F.regexp_extract_all(x, F.lit(DIGEST), 0), lambda d: d.rlike("[a-f]") & d.rlike("[0-9]"))
    counted = commands.select(
        "id", "chapter", "written", F.when(c("listings"), F.size("commands")).otherwise(0).alias("lines"),
        F.when(c("listings"), F.size(_missing_lines(c("code"), c("inline"), c("have"), c("commands"), 8))).otherwise(0).alias("lines_lost"), F.when(c("listings"), F.size(exact)).otherwise(0).alias("lines_exact"),
        F.size("cells").alias("rows"), F.size(_missing_rows(c("have"), c("code"), c("cells"), 2)).alias("rows_lost"),
        F.array_min(mails).alias("stray_mail"), (F.size(F.array_except(digest("note"), digest("source"))) > 0).alias("stray_digest"),
        F.size(T.words(c("note"))).alias("note_words"), F.size(T.words(c("source"))).alias("source_words"),
    )
    lost = lambda part, whole, share: (F.col(whole) > 0) & (F.col(part) > (1 - share) * F.col(whole) + 1e-9)
    flags = {
        "lines": lost("lines_lost", "lines", 0.9), "rows": lost("rows_lost", "rows", 0.9), "mail": F.col("stray_mail").isNotNull(),
        "digest": F.col("stray_digest"), "short": (F.col("source_words") > 0) & (F.col("note_words") < 0.1 * F.col("source_words")),
    }
    problems = F.array_compact(F.array(*(F.when(F.col("written") & c, F.lit(k)) for k, c in flags.items()), F.when(~F.col("written"), F.lit("unwritten"))))
    return counted.withColumn("problems", problems)


def summary(reports: DataFrame) -> DataFrame:
    """Per chapter: how many notes there are, and of the written ones their
    listing lines and table rows, how many are kept, and how many notes have a
    problem."""
    of_written = lambda c: F.coalesce(F.sum(F.when(F.col("written"), c)), F.lit(0).cast("bigint"))
    c = F.col
    return reports.groupBy("chapter").agg(
        F.count("*").alias("notes"), F.count_if("written").alias("written"),
        of_written(c("lines")).alias("lines"), of_written(c("lines") - c("lines_lost")).alias("lines_found"), of_written(c("lines_exact")).alias("lines_exact"),
        of_written(c("rows")).alias("rows"), of_written(c("rows") - c("rows_lost")).alias("rows_found"),
        F.count_if(c("written") & (F.size("problems") > 0)).alias("flagged"),
    )


def body(note: Column) -> Column:
    """A note without the header block it begins with."""
    return F.regexp_replace(note, r"\A---\n(?:(?!---\n)[^\n]*\n)*---\n", "")


def check_plan(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Reports on every chunk (book, chunk_id, chapter, text) of a plan, by its
    note (book, chunk_id, note) if there is one."""
    written = notes.select("book", "chunk_id", body(F.col("note")).alias("note"))
    pairs = chunks.select("book", "chunk_id", "chapter", F.col("text").alias("source")).join(written, ["book", "chunk_id"], "left")
    return report(pairs.select(F.struct("book", "chunk_id").alias("id"), F.struct("book", "chapter").alias("chapter"), "note", "source"))

"""Scalar functions on text, as column expressions.

Patterns avoid lookaround and the classes \\w, \\s and \\d, whose meaning
differs between regex engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is stripped and squeezed.
BLANK = r"[ \t\n\r\f\x{0B}\x{A0}]"
SECTION = r"^ *([0-9]+(?:\.[0-9]+)*)(?:\. *| +)([^0-9 ].*)$"
CHAPTER_PREFIX = r"^ *(?:[Cc][Hh][Aa][Pp][Tt][Ee][Rr]|[Rr][Oo][Zz][Dd][Zz][Ii][Aa][LlŁł])? *[0-9]{1,2}(?:[.] *|[-—:] *| +|$)"
CHAPTER_NUMBER = r"^ *(?:[Cc][Hh][Aa][Pp][Tt][Ee][Rr]|[Rr][Oo][Zz][Dd][Zz][Ii][Aa][LlŁł])? *([0-9]{1,2})(?:$|[^0-9\p{L}_‐–-])"
#: A chapter's number that is the first of a section's: no chapter heading.
CHAPTER_SECTION = r"^ *(?:[Cc][Hh][Aa][Pp][Tt][Ee][Rr]|[Rr][Oo][Zz][Dd][Zz][Ii][Aa][LlŁł])? *[0-9]{1,2} *[.] *[0-9]"
# Titles of a book's apparatus, as letters and digits, and how
# longer ones begin.
APPARATUS = (
    "spistreści contents tableofcontents skorowidz index stronatytułowa stronaredakcyjna bibliografia bibliography references "
    "odwołanialiteraturowe aboutbootlin genericcourseinformation lastslides aboutthisdocument copyingthisdocument cover titlepage "
    "copyrightandcredits dedication contributors aboutpackt otherbooksyoumayenjoy"
).split()
APPARATUS_BEGINS = ("bibliografia", "bibliography")
ACCENTED = "ąćęłńóśźżàáâäåçèéêëìíîïñòôöùúûüý"
PLAIN = "acelnoszzaaaaaceeeeiiiinooouuuuy"
MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
LEADER_ENTRY = r"(?m)^[^\n]*?(?:\. ?){4,} *[0-9]{1,4}[ \t]*$"
#: A line that opens a numbered section: its number, and its title without a page number.
NUMBERED_LINE = r"(?m)^[ \t\r]*(?:#{1,6}[ \t]+)?([0-9]{1,2}\.[0-9]{1,2})[ \t\r]+([^ \t\r\n][^\n]*?)[ \t\r]*(?:[0-9]{1,4})?[ \t\r]*$"
WORD = r"[\p{L}\p{N}_]+"
#: Estimated characters of a token.
TOKEN_CHARS = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once.  Inside the lambda of a higher
    order function an expression would be computed again for every element."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(c: Column) -> Column:
    """White space collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def letters_key(c: Column) -> Column:
    """Letters and digits only, in lower case: how titles are compared."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def furniture_key(c: Column) -> Column:
    """The key of a line whose numbers change from page to page."""
    return F.regexp_replace(letters_key(c), "[0-9]+", "0")


def slugify(c: Column) -> Column:
    """Lower-case ASCII with hyphens; "untitled" where nothing is left."""
    plain = F.translate(F.lower(c), ACCENTED, PLAIN)
    slug = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled"))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def section_number(c: Column) -> Column:
    return _first(squeeze(c), SECTION)


def section_title(c: Column) -> Column:
    return F.coalesce(_first(squeeze(c), SECTION, 2), squeeze(c))


def chapter_number(c: Column) -> Column:
    """The leading number of one or two digits that no hyphen joins to a word."""
    return _first(c, CHAPTER_NUMBER).cast("int")


def is_chapter_heading(c: Column) -> Column:
    """A chapter's number that no section's follows."""
    return chapter_number(c).isNotNull() & ~c.rlike(CHAPTER_SECTION)


def is_apparatus(c: Column) -> Column:
    """Contents, index, bibliography and the like."""
    key = F.regexp_replace(letters_key(c), "^[0-9]+", "")
    return key.isin(*APPARATUS) | key.rlike("^(?:" + "|".join(APPARATUS_BEGINS) + ")")


def owner_chapter(title: Column, outline_chapter: Column) -> Column:
    """The chapter of an entry: of its section's number, else of its title,
    else the one the outline puts it in."""
    of_section = F.regexp_extract(section_number(title), "^([0-9]+)", 1).try_cast("int")
    return F.coalesce(of_section, chapter_number(title), outline_chapter)


def chapter_name(c: Column) -> Column:
    """A title without its chapter word and number, never empty."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(c, CHAPTER_PREFIX, "")), F.lit("")), strip(c))


def padded_section(c: Column) -> Column:
    """Every number of a section padded to two digits."""
    return F.array_join(F.transform(F.split(c, "[.]"), lambda n: F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)), ".")


def tokens(c: Column) -> Column:
    return F.floor(F.length(c) / TOKEN_CHARS).cast("int")


def is_heading_title(c: Column) -> Column:
    """No leader dots, and a first character that is a letter or digit and not
    in lower case."""
    return ~c.rlike(r"(?:\. ?){4,}") & c.rlike(r"^[\p{Lu}\p{Lt}\p{Lo}\p{N}]")


def is_contents_page(c: Column) -> Column:
    """At least five dotted entries, or entries on half of the page."""
    entries = F.regexp_extract_all(c, F.lit(LEADER_ENTRY), 0)
    dotted = F.aggregate(entries, F.lit(0), lambda n, e: n + F.length(e))
    return (F.size(entries) >= 5) | ((F.size(entries) > 0) & (dotted >= F.length(c) * 0.5))


def opens_section(c: Column) -> Column:
    """Whether a line opens a numbered section: its title begins with a letter
    or digit that isn't in lower case and has no leader dots.  A digit that
    stands apart from the number belongs to it."""
    heads = F.arrays_zip(F.regexp_extract_all(c, F.lit(NUMBERED_LINE), 1).alias("number"), F.regexp_extract_all(c, F.lit(NUMBERED_LINE), 2).alias("title"))
    split = lambda h: h["number"].rlike("^[0-9]+[.][0-9]$") & h["title"].rlike("^[0-9][ \t]+[^ \t]")
    titles = F.transform(heads, lambda h: F.when(split(h), F.regexp_replace(h["title"], "^[0-9][ \t]+", "")).otherwise(h["title"]))
    return F.exists(titles, is_heading_title)


def garbled(c: Column, share: float = 0.2) -> Column:
    """A share of unprintable characters; empty text isn't garbled."""
    bad = F.length(c) - F.length(F.regexp_replace(c, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]", ""))
    return (F.length(c) > 0) & (bad >= F.length(c) * share)


def polish_share(c: Column) -> tuple[Column, Column]:
    """Polish letters and all letters of a text."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    polish = F.length(F.regexp_replace(c, "[^ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]", ""))
    return polish, letters


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def file_stem(c: Column) -> Column:
    """A safe file name and link target."""
    parted = F.regexp_replace(c, r" *[/\\|] *", " - ")
    return squeeze(F.regexp_replace(parted, r'[<>:"?*#^\[\]]', ""))


def page_ranges(c: Column) -> Column:
    """ "60-120, 131" as an array of (first, last); nonsense is an error."""
    parts = F.filter(F.transform(F.split(c, "[,;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    pattern = r"^([0-9]+)(?: *[-–] *([0-9]+))?$"

    def one(p: Column) -> Column:
        first = F.regexp_extract(p, pattern, 1).try_cast("int")
        last = F.coalesce(F.regexp_extract(p, pattern, 2).try_cast("int"), first)
        good = p.rlike(pattern) & (first >= 1) & (first <= last)
        bad = F.raise_error(F.concat(F.lit("not a range of pages: "), p)).cast("struct<first:int,last:int>")
        return F.when(good, F.struct(first.alias("first"), last.alias("last"))).otherwise(bad)

    return F.transform(parts, one)


def normalise_math(c: Column) -> Column:
    """LaTeX brackets to dollars."""
    shown = F.regexp_replace(c, r"(?s)\\\[[ \n]*(.*?)[ \n]*\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(shown, r"(?s)\\\([ \n]*(.*?)[ \n]*\\\)", r"\$$1\$")


def compact_row(c: Column) -> Column:
    """A table row without padding and with short rules."""
    return F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), "-{4,}", "---")


def squeezed_command(c: Column) -> Column:
    """A listing line squeezed, without a shell prompt."""
    return squeeze(F.regexp_replace(c, r"^[ \t]*\$[ \t]+", ""))


def bbox_to_pixels(bbox: Column, height: float, dpi: int = 200, pad: float = 6.0) -> Column:
    """A box in points from the bottom left as pixels from the top left, padded
    and kept on the page at 0; halves go to the even number."""

    def edge(x: Column) -> Column:
        return F.greatest(F.bround(x * dpi / 72, 0), F.lit(0.0)).cast("int")

    top, bottom = F.greatest(bbox["t"], bbox["b"]), F.least(bbox["t"], bbox["b"])
    return F.struct(
        edge(bbox["l"] - pad).alias("left"), edge(F.lit(height) - top - pad).alias("top"),
        edge(bbox["r"] + pad).alias("right"), edge(F.lit(height) - bottom + pad).alias("bottom"),
    )

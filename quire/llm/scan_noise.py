"""Repairing text that was read from scanned pages.

Method: words of the corpus are counted into a frequency lexicon with bigrams.
A symmetric-delete index over the lexicon gives correction candidates: both
the unknown form and the lexicon's words are reduced to a skeleton in which
characters that scanners confuse are one, and meet where their skeletons are
equal after at most one deletion on either side.  Candidates are ranked by an
edit distance that is cheap for confusion pairs, by frequency, and by how often
they stand beside the words before and after.

Words broken over lines and pages are joined where the lexicon knows the
joint; running heads are lines at the edge of a page, in the dress of a head,
that spell a title of the book; page numbers are lines at the edge that hold a
number only.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.lookalikes import mapping
from quire.operators.pages import holding, page_text, scanned_pages
from quire.session import cut, table

#: A word or pattern of the lexicon occurs so often outside scanned pages.
LEAST_COUNT = 3
#: How much more often than a token's own pattern the pattern of its repair
#: must occur.
TIMES_OFTENER = 20
#: Most frequent words that tasks hold to pass over known words at once; all
#: other forms, and all joints, are looked up in the whole lexicon by a join.
HELD_WORDS = 50_000
#: Forms longer than this are looked up by their quarters, one of which no
#: repair touches, and not by deletions, of which there would be too many.
LONG = 48
#: By how many characters a form and its word can differ in length.
LENGTHS_APART = 3
#: Lines at either end of a page, blank ones aside, that count as its edge.
EDGE = 2
#: Distinct words or pairs that a task counts before it hands them on.
COUNTED_TOGETHER = 400_000

# What is read for what, and what it costs to undo it.
CONFUSIONS = {
    "e": "c", "c": "e", "a": "o", "o": "0", "ó": "6", "l": "1 i", "i": "1 l", "s": "5", "z": "2", "t": "f", "f": "t",
    "n": "u ii", "u": "ii li n", "h": "b li", "b": "8 6 h", "m": "rn ru", "rn": "m", "d": "cl ci", "cl": "d",
    "li": "h", "ri": "n", "nn": "rm", "w": "vv", "v": "y", "g": "9", "q": "9", "r": "k",
}
CONFUSIONS_UPPER = {"R": "K", "E": "F", "O": "0", "B": "8", "I": "1", "S": "5", "Z": "2"}
DIGITS_READ = {"l": "1", "I": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2"}
CONFUSED, ACCENT_LOST, STRAY, OTHER = 0.3, 0.3, 0.3, 1.0
STRAYS = "'.~|`’"
MARKS = "-¬\xad‐‑~"
# classes of the skeleton: single characters that are read for each other
_CLASSES = str.maketrans("cftoó06l1|!j52uhb89k", "eeeaaaaiiiiisznnnngr")
# pairs: what was read, what it may have been
_PAIRS = tuple(
    (read, right) for right, all_read in CONFUSIONS.items() for read in all_read.split() if len(read) + len(right) > 2
)

# single confusions that the classes don't make one
_SINGLES = tuple(
    (read, right) for right, all_read in CONFUSIONS.items() for read in all_read.split()
    if len(read) + len(right) == 2 and read.translate(_CLASSES) != right.translate(_CLASSES)
)

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_EDGE_PUNCT = ".,;:!?()[]{}<>\"“”„‚‘«»…*_`#=+/\\"
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")
_RUN = re.compile(r"[^\W_]+")
_FORM = re.compile(r"[\w\-'’.~|]+")
_NO = r"[-–]?[0-9OoIlSBZ]{1,5}"
_PAGE_NO = re.compile(
    rf"(?:(?i:page|pg\.|p\.|strona|str\.|s\.|seite)\s*({_NO})|[-–—]\s*({_NO})\s*[-–—]|({_NO})\s*/\s*{_NO}|\[\s*({_NO})\s*\]|\(\s*({_NO})\s*\)|[|·•~]\s*({_NO})\s*[|·•~]|({_NO}))$"
)
# dresses of a head around its title, and how it counts: with a number it may
# recur or spell a title, with a suffix it must spell one, and capitals alone,
# too
_DRESSES = (
    (re.compile(rf"{_NO}\s{{3,}}(?P<t>\S.*)$"), "numbered"),
    (re.compile(rf"(?P<t>.*\S)\s{{3,}}{_NO}$"), "numbered"),
    (re.compile(rf"\[\s*{_NO}\s*\]\s+(?P<t>\S.*)$"), "numbered"),
    (re.compile(rf"(?P<t>.*\S)\s+\[\s*{_NO}\s*\]$"), "numbered"),
    (re.compile(rf"(?P<t>.*\S)\s+[|·•]\s+{_NO}$"), "numbered"),
    (re.compile(rf"{_NO}\s+[|·•]\s+(?P<t>\S.*)$"), "numbered"),
    (re.compile(rf"[^\W\d_][\w|]{{0,11}}\.?\s*{_NO}\s+[|·•]\s+(?P<t>\S.*)$"), "numbered"),
    (re.compile(r"(?P<t>.*\S)\s{2,}[—–-]\s{2,}\S.{0,24}$"), "suffixed"),
    (re.compile(r"(?P<t>\S.*)$"), "capitals"),
)
_TITLE_NO = re.compile(r"^(?:(?:chapter|rozdział|ch\.)\s*)?\d+(?:\.\d+)*\.?\s+", re.IGNORECASE)


def bare(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFD", text.casefold().replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c))


def skeleton(text: str) -> str:
    """What is left of a text when single characters that are read for each
    other are one: letters and digits only."""
    return "".join(c for c in bare(text).translate(_CLASSES) if c.isalnum())


def readings(form: str, most: int = 2) -> set[str]:
    """A form and what it is with up to ``most`` of its pairs undone; short
    forms also without a stray sign and with single confusions undone that
    aren't one in the skeleton, since they have no deletions to meet by."""
    out = last = {form}
    for _ in range(most):
        last = {
            w[:k] + right + w[k + len(read) :]
            for w in last
            for read, right in _PAIRS
            for k in range(len(w))
            if w.startswith(read, k)
        } - out
        out = out | last
    if len(form) <= 4:
        out = out | {form[:k] + form[k + 1 :] for k in range(len(form)) if form[k] in STRAYS}
        out = out | {form[:k] + right + form[k + 1 :] for k in range(len(form)) for read, right in _SINGLES if form[k] == read}
    return out


def title_key(text: str) -> str:
    """A key of a title or head in which pairs are one, too; it need not be
    reversible, only alike for what looks alike."""
    one, several, invisible = mapping()
    text = "".join(several.get(c, one.get(c, c)) for c in text.casefold() if c not in invisible)
    s = skeleton(text)
    for pair, to in (("rn", "m"), ("rm", "nn"), ("ei", "d"), ("ii", "n"), ("ri", "n"), ("vv", "w"), ("i", ""), ("nn", "n")):
        s = s.replace(pair, to)
    return s


def deletes(skel: str) -> set[str]:
    """The skeleton and what is left of it after one deletion.  Short ones
    have none: a single cheap step leads to their words, and ``readings`` has
    all of those."""
    return {skel, *(skel[:k] + skel[k + 1 :] for k in range(len(skel)))} if len(skel) > 3 else {skel}


def quarters(word: str) -> list[str]:
    """Keys of a long word: its quarters, each with its place."""
    n = len(word)
    return [f"{n}:{j}:{word[n * j // 4 : n * (j + 1) // 4]}" for j in range(4)]


def shifted_quarters(form: str) -> set[str]:
    """Keys of a long form: every quarter that a word within reach could have,
    wherever up to LENGTHS_APART steps before it may have moved it."""
    out = set()
    for n in range(len(form) - LENGTHS_APART, len(form) + LENGTHS_APART + 1):
        for j in range(4):
            a, b = n * j // 4, n * (j + 1) // 4
            out |= {f"{n}:{j}:{form[a + d : b + d]}" for d in range(-LENGTHS_APART, LENGTHS_APART + 1) if a + d >= 0}
    return out


def word_keys(word: str) -> set[str]:
    """The keys of a word of the lexicon in the index."""
    low = bare(word)
    keys = deletes(skeleton(word)) if len(low) <= LONG + LENGTHS_APART else set()
    return keys | set(quarters(low) if len(low) > LONG - LENGTHS_APART else ())


def form_keys(form: str) -> set[str]:
    """The keys by which an unknown form asks the index."""
    low = bare(form)
    if len(low) > LONG:
        return shifted_quarters(low)
    return {k for r in readings(form.lower()) for k in deletes(skeleton(r))}


def _costs(upper: bool) -> dict[tuple[str, str], float]:
    pairs = {(right.casefold(), read.casefold()) for right, all_read in CONFUSIONS.items() for read in all_read.split()}
    if upper:
        pairs |= {(right.casefold(), read.casefold()) for right, all_read in CONFUSIONS_UPPER.items() for read in all_read.split()}
    else:
        pairs -= {("r", "k")}
    return dict.fromkeys(pairs, CONFUSED)


_LOWER, _UPPER = _costs(False), _costs(True)


def distance(read: str, right: str, upper: bool = False, most: float = 2.0) -> float:
    """Weighted edit distance from a word to what was read, both in lower case."""
    costs = _UPPER if upper else _LOWER
    n, m = len(read), len(right)
    row = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 99.0
            if i:
                best = row[i - 1][j] + (STRAY if read[i - 1] in STRAYS else OTHER)
            if j:
                best = min(best, row[i][j - 1] + OTHER)
            if i and j:
                a, b = read[i - 1], right[j - 1]
                if a == b:
                    best = min(best, row[i - 1][j - 1])
                else:
                    step = costs.get((b, a)) or (ACCENT_LOST if bare(a) == bare(b) else OTHER)
                    best = min(best, row[i - 1][j - 1] + step)
                for p, q in ((2, 1), (1, 2), (2, 2)):
                    if i >= p and j >= q and (step := costs.get((right[j - q : j], read[i - p : i]))):
                        best = min(best, row[i - p][j - q] + step)
            row[i][j] = best
        if i and min(row[i]) > most and (i < 2 or min(row[i - 1]) > most):
            return 99.0
    return row[n][m]


def allowed(form: str) -> float:
    """The greatest distance at which a form of this length is repaired."""
    n = len(form)
    return 0.3 if n <= 3 else 0.6 if n <= 6 else 1.0


def recase(form: str, word: str) -> str:
    """The word in the case in which the form is written."""
    if (letters := [c for c in form if c.isalpha()]) and len(word) > 1:
        capitals = sum(c.isupper() for c in letters)
        if capitals > len(letters) / 2 and (len(letters) > 1 or len(word) < 3):
            return word.upper()
        if form[0].isupper():
            return word[0].upper() + word[1:]
    return word


def pattern(token: str) -> str:
    """The key of what a token with digits is like: its digits as 9.  The zero
    byte keeps patterns apart from words."""
    return "\0" + _DIGIT.sub("9", token)


def digits_undone(token: str) -> str | None:
    """A token with the letters in its runs of mostly digits read as digits, if
    that makes those runs numbers; None where nothing changes.  Whether it is
    meant is for the patterns of the corpus to say."""

    def run(m: re.Match) -> str:
        digits = sum(c.isdigit() for c in m[0])
        return "".join(DIGITS_READ.get(c, c) for c in m[0]) if digits and digits * 2 >= len(m[0]) else m[0]

    out = _RUN.sub(run, token)
    changed = out != token and all(a == b or b.isdigit() for a, b in zip(_RUN.findall(token), _RUN.findall(out)))
    return out if changed else None


# ---------------------------------------------------------------- the corpus


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (text, times): counts of words and of patterns (b is null), and of
    pairs of words."""
    words: Counter = Counter()
    pairs: Counter = Counter()

    def flush() -> pa.RecordBatch:
        a = [*words, *(p[0] for p in pairs)]
        b = [*[None] * len(words), *(p[1] for p in pairs)]
        n = [*words.values(), *pairs.values()]
        words.clear()
        pairs.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    for batch in batches:
        for text, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _WORD.findall(text.lower())
            found_patterns = [pattern(core) for t in text.split() if _DIGIT.search(t) and (core := _core(t))]
            if times == 1:
                words.update(found)
                words.update(found_patterns)
                pairs.update(zip(found, found[1:]))
            else:
                for counted, into in ((found, words), (found_patterns, words), (zip(found, found[1:]), pairs)):
                    for key in counted:
                        into[key] += times
            if len(words) + len(pairs) > COUNTED_TOGETHER:
                yield flush()
    yield flush()


def pair_key(a: Column, b: Column) -> Column:
    """The digest by which a pair of words is counted: pairs are many and only
    weigh candidates, so their words don't move."""
    return F.xxhash64(a, b)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, pair, n) over (text, times): the text counts ``times``, which may
    be negative.  Words have a null pair, pairs of words a null word."""
    counted = texts.where(texts[0].isNotNull()).mapInArrow(_counter, "a string, b string, n bigint")
    single = F.col("b").isNull()
    keyed = counted.select(F.when(single, F.col("a")).alias("word"), F.when(~single, pair_key(F.col("a"), F.col("b"))).alias("pair"), "n")
    return keyed.groupBy("word", "pair").agg(F.sum("n").alias("n"))


# ------------------------------------------------- what stands on scanned pages

# roles: what is looked up in the lexicon for an occurrence, and what it is to it
_OCCURRENCE = (
    "rec_id bigint, book string, start int, stop int, kind string, form string, left string, right string, mark string, "
    "before string, after string, line string, skeleton string, number int, page int, roles array<struct<role:string,form:string>>"
)


def _core(token: str) -> str:
    core = token.strip(_EDGE_PUNCT)
    return core.strip("—–")


def _page_lines(text: str, start: int) -> list[tuple[int, str]]:
    """(offset, line) of the lines of one page."""
    out, at = [], start
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def _in_capitals(line: str) -> bool:
    return sum(c.isupper() for c in line) >= 6 and sum(c.islower() for c in line) <= len(line) / 10


def _heads(lines: list[tuple[int, str]]) -> dict[int, tuple[str, str, int | None]]:
    """Lines at the edges, by place, that may be a head (kind, key, whether it
    is dressed with a number) or a page number (kind, '', number)."""
    full = [k for k, (_, line) in enumerate(lines) if line.strip()]
    edge = dict.fromkeys([*full[:EDGE], *full[-EDGE:]])
    out: dict[int, tuple[str, str, int | None]] = {}
    for k in edge:
        line = lines[k][1].strip()
        if (m := _PAGE_NO.match(line)) and any(c.isdigit() for c in line):
            digits = "".join(DIGITS_READ.get(c, c) for c in next(g for g in m.groups() if g)).replace("–", "-")
            out[k] = ("page_number" if not m.groups()[-1] else "bare_number", "", int(digits) if digits.lstrip("-").isdigit() else None)
            continue
        for pattern, dress in _DRESSES:
            if (m := pattern.match(line)) and (dress != "capitals" or _in_capitals(line)):
                if s := title_key(m["t"]):
                    out[k] = ("header", s, int(dress == "numbered"))
                break
    return out


def occurrences(text: str, segments: list[tuple[int, int, bool]] | None, known: frozenset) -> Iterator[tuple]:
    """What may need repair in one record.  ``segments``: (page, length,
    scanned) of the pages whose texts, joined by empty lines, are the text;
    None for a caption, which has neither heads nor page numbers."""
    if segments is None:
        pages = [(0, 0, len(text), True)]
    else:
        pages, at = [], 0
        for page, length, is_scanned in segments:
            pages.append((page, at, at + length, is_scanned))
            at += length + 2
    flow: list[tuple[int, str] | None] = []  # body lines in order; None: a break of paragraphs or of what was scanned
    for page, start, stop, is_scanned in pages:
        if not is_scanned:
            flow.append(None)
            continue
        lines = _page_lines(text[start:stop], start)
        heads = _heads(lines) if segments is not None else {}
        for k, (at, line) in enumerate(lines):
            if k in heads:
                kind, skel, number = heads[k]
                yield (at, at + len(line), kind, None, None, None, None, None, None, line.strip(), skel, number, page, None)
                # its words are words to repair if it turns out to be no head
                yield from _words(at, line, known, "line_word") if kind == "header" else ()
            elif line.strip():
                flow.append((at, line))
            elif k + 1 < len(lines) and flow and flow[-1] is not None and any(x[1].strip() for x in lines[k:]) and any(j not in heads and lines[j][1].strip() for j in range(k)):
                flow.append(None)
    inner: tuple[int, int] | None = None
    for here, following in zip(flow, [*flow[1:], None]):
        if here is None:
            continue
        at, line = here
        tokens = [(at + m.start(), m.group()) for m in re.finditer(r"\S+", line)]
        skip = inner
        inner = None
        if following is not None and tokens and (nxt := re.match(r"\s*(\S+)", following[1])):
            row = _break(tokens, (following[0] + nxt.start(1), nxt.group(1)), known)
            if row:
                yield row
                if row[6]:
                    inner = (row[0], row[1])
        yield from _words(at, line, known, "word", {p for p in (skip, inner) if p})


def _words(at: int, line: str, known: frozenset, kind: str, broken: set = frozenset()) -> Iterator[tuple]:
    found = [(at + m.start(), m.group()) for m in re.finditer(r"\S+", line)]
    for k, (pos, token) in enumerate(found):
        core = _core(token)
        if not core or core.lower() in known or not _FORM.fullmatch(core):
            continue
        start = pos + token.index(core)
        if any(a <= start < b for a, b in broken):
            continue
        if core[-1] in MARKS or core[0] in MARKS:
            core = core.strip(MARKS)
            if not core or core.lower() in known:
                continue
            start = pos + token.index(core)
        has_letter, has_digit = any(c.isalpha() for c in core), any(c.isdigit() for c in core)
        if not has_letter:
            continue
        roles, value = [("whole", core)] if len(core) > 1 else [], None
        if has_digit:
            value = digits_undone(core)
            roles += [("own", pattern(core)), *([("new", pattern(value))] if value else [])]
        if "-" in core:
            roles += [(f"part{n}", p) for n, p in enumerate(core.split("-"))]
        if roles:
            before = _core(found[k - 1][1]).lower() if k else None
            after = _core(found[k + 1][1]).lower() if k + 1 < len(found) else None
            # a head's words keep its line, by which they go if it is one
            yield (start, start + len(core), kind, core, value, None, None, before, after, line.strip() if kind == "line_word" else None, None, None, None, roles)


def _break(tokens: list[tuple[int, str]], following: tuple[int, str], known: frozenset) -> tuple | None:
    """A word or code that may be broken over the end of a line."""
    pos, last = tokens[-1]
    nxt_at, nxt = following
    mark = last[-1] if last[-1] in MARKS else ""
    left = last[: len(last) - len(mark)].lstrip(_EDGE_PUNCT + "—–")
    right = nxt.rstrip(_EDGE_PUNCT + "—–")
    if m := re.match(r"[\w\-'’.~|]+", right):
        right = m.group()
    if not left or not right or not (right[0].isalnum()) or not left[-1].isalnum():
        return None
    start = pos + last.index(left)
    stop = nxt_at + nxt.index(right) + len(right)
    right = right.rstrip(MARKS + STRAYS)
    joint, hyphened = left + right, left + "-" + right
    if not any(c.isalpha() for c in joint):
        return None
    coded = any(c.isdigit() for c in joint)
    undone = [(role, digits_undone(w) or w) for role, w in (("new", joint), ("hyphened", hyphened))] if coded else []
    codes = [(role, pattern(w)) for role, w in undone if any(c.isalpha() for c in w)]  # numbers aren't joined
    wordly = right[0].islower() or right[0].isdigit() or (left[-1].isupper() and right[0].isupper())
    a = left.lower()
    if not mark and (not wordly or not a.replace("-", "").isalpha() or last[-1] in _EDGE_PUNCT):
        return None
    if not wordly and not codes:
        return None
    kind = ("break" if mark else "loose") if wordly else "code"
    roles = [("whole", joint), ("hyphen", hyphened), ("left", left), ("right", right)] if wordly else []
    before = _core(tokens[-2][1]).lower() if len(tokens) > 1 else None
    return (start, stop, kind, joint, left, right, mark, before, None, None, None, None, None, roles + codes)


_ROLES = pa.list_(pa.struct([("role", pa.string()), ("form", pa.string())]))


def _occurrences(known: frozenset):
    names = [f.split()[0] for f in _OCCURRENCE.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = [types.get(f.split()[1], _ROLES) for f in _OCCURRENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rec, book, text, segments in zip(*(c.to_pylist() for c in batch.columns)):
                held = None if segments is None else [(s["page"], s["length"], s["scanned"]) for s in segments]
                for *row, roles in occurrences(text, held, known):
                    rows.append((rec, book, *row, roles and [{"role": r, "form": f} for r, f in roles]))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


# ------------------------------------------------------------- candidates


def _keyed(keys_of, carried: int):
    """Over (word, ...): a row for every key of the word, the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for k, word in enumerate(batch.column(0).to_pylist()):
                found = keys_of(word)
                at += [k] * len(found)
                keys += found
            rows = pa.array(at, pa.int32())
            columns = [batch.column(c).take(rows) for c in range(carried)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.string())], names=[*batch.schema.names[:carried], "key"])

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = []
        for form, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, most = form.lower(), allowed(form)
            letters = [c for c in form if c.isalpha()]
            upper = sum(c.isupper() for c in letters) > len(letters) / 2
            cost = distance(low, word, upper, most)
            costs.append(cost if cost <= most + 1e-9 else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(costs, pa.float64())], names=["form", "word", "n", "cost"])


def candidates(forms: DataFrame, lexicon: DataFrame, parts: int) -> DataFrame:
    """(form, word, n, cost): words of the lexicon within the allowed distance
    of each unknown form, by the symmetric-delete index.  A word meets only
    forms with which it shares a key; a hot key is split by the adaptive join,
    as the words that share it are few.  Both sides are spread over ``parts``
    tasks before their keys are made, for a form has many.

    A step of the distance changes at most two characters, so pairs too far
    apart by plain edits are passed over before Python measures them."""
    asked = forms.select("form").repartition(parts, "form").mapInArrow(_keyed(form_keys, 1), "form string, key string")
    index = lexicon.select("word", "n").repartition(parts, "word").mapInArrow(_keyed(word_keys, 2), "word string, n bigint, key string")
    steps = F.when(F.length("form") <= 3, 2).when(F.length("form") <= 6, 4).otherwise(6)
    met = asked.join(index, "key").where(F.levenshtein(F.lower("form"), "word") <= steps).select("form", "word", "n").repartition(parts, "form", "word").distinct()
    return met.mapInArrow(_measured, "form string, word string, n bigint, cost double").where("cost IS NOT NULL")


# ------------------------------------------------------------- the operator


def scanned_records(chunks: DataFrame, figures: DataFrame, page_texts: DataFrame, extract_results: DataFrame, parts: int) -> DataFrame:
    """(rec_id, book, text, segments, rows) of chunks with scanned pages, and of
    captions on scanned pages (segments null).  Repeated rows come once; rows
    says how often."""
    scanned = scanned_pages(extract_results).withColumn("scanned", F.lit(True))
    pages = holding(page_texts.withColumn("length", F.length(page_text(page_texts))), F.col("length")).where("length > 0")
    pages = pages.join(scanned, ["book", "page"], "left").select("book", "page", "length", F.coalesce("scanned", F.lit(False)).alias("scanned"))
    last = pages.groupBy("book").agg(F.max("page").alias("last"))
    ranges = chunks.where("chunk_id IS NOT NULL AND page_start IS NOT NULL AND page_end IS NOT NULL").select("chunk_id", "book", "page_start", "page_end").distinct().join(last, "book")
    ranges = ranges.withColumn("a", F.greatest("page_start", F.lit(1))).withColumn("b", F.least("page_end", "last")).where("a <= b")
    on_page = ranges.select("chunk_id", "book", F.explode(F.sequence("a", "b")).alias("page")).join(pages, ["book", "page"])
    segments = on_page.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("page", "length", "scanned"))).alias("segments"))
    segments = segments.where(F.exists("segments", lambda s: s["scanned"]))
    # a number of parts of its own keeps the later Python stages spread, however small the texts are
    texts = chunks.where("text IS NOT NULL").select("chunk_id", F.struct("book", "text").alias("t")).repartition(parts, "chunk_id")
    texts = texts.groupBy("chunk_id").agg(F.max("t").alias("t"), F.count("*").cast("int").alias("rows"))
    texts = texts.join(segments, "chunk_id").select(F.col("chunk_id").alias("rec_id"), "t.book", "t.text", "segments", "rows")
    captions = figures.where("caption <> '' AND figure_id IS NOT NULL").select(F.col("figure_id").alias("rec_id"), "book", "page", "caption").distinct()
    captions = captions.join(scanned, ["book", "page"], "left_semi")
    none = F.lit(None).cast(texts.schema["segments"].dataType)
    return texts.unionAll(captions.select("rec_id", "book", F.col("caption").alias("text"), none.alias("segments"), F.lit(1).alias("rows")))


def _scanned_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (text, segments, rows): the scanned parts, to be counted off."""
    for batch in batches:
        out, times = [], []
        for text, segments, rows in zip(*(c.to_pylist() for c in batch.columns)):
            at = 0
            for s in segments or [{"length": len(text), "scanned": True}]:
                if s["scanned"]:
                    out.append(text[at : at + s["length"]])
                    times.append(-rows)
                at += s["length"] + 2
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(times, pa.int32())], names=["text", "times"])


class ScanNoise:
    """Repairs of all records of a library.

    Only scanned pages are repaired, by the row of a page that holds.  Null and
    empty texts and captions need none; rows with a null id are left out;
    repeated rows count once; extra columns don't matter; with empty tables the
    result is empty.  Texts are read whole, whatever their length."""

    def __init__(self, books: DataFrame, bookmarks: DataFrame, chunks: DataFrame, figures: DataFrame, page_texts: DataFrame, extract_results: DataFrame):
        self.parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.records = cut(scanned_records(chunks, figures, page_texts, extract_results, self.parts))
        captions = figures.select("figure_id", "caption").distinct().select(F.col("caption").alias("text"))
        one = F.lit(1).alias("times")
        texts = chunks.select("text", one).unionAll(captions.select("text", one))
        scanned = self.records.select("text", "segments", "rows").mapInArrow(_scanned_parts, "text string, times int")
        # what stands outside scanned pages; the noise of these is no word
        counts = cut(word_counts(texts.unionAll(scanned)).where("n > 0"))
        self.lexicon = counts.where((F.col("n") >= LEAST_COUNT) & F.col("pair").isNull()).select("word", "n")
        self.bigrams = counts.where("pair IS NOT NULL").select("pair", F.col("n").alias("times"))
        words = self.lexicon.where(~F.col("word").startswith("\0"))
        held = [r.word for r in words.orderBy(F.desc("n"), "word").limit(HELD_WORDS).collect()]
        self.longest = words.agg(F.max(F.length("word"))).first()[0] or 0
        self.found = cut(self.records.select("rec_id", "book", "text", "segments").mapInArrow(_occurrences(frozenset(held)), _OCCURRENCE))
        self.titles = _titles(books, bookmarks)

    def _heads(self) -> DataFrame:
        """Lines in the dress of a head that spell a title of the book, or that
        come with a number on several of its pages."""
        head = self.found.where("kind = 'header'")
        recur = head.where("number = 1").groupBy("book", "skeleton").agg(F.countDistinct("page").alias("pages")).where("pages > 1")
        recur = recur.select("book", "skeleton", F.lit(1).alias("number"))
        titled = self.titles.withColumn("number", F.explode(F.array(F.lit(0), F.lit(1))))
        return head.join(titled.unionByName(recur).distinct(), ["book", "skeleton", "number"], "left_semi")

    def lines(self) -> DataFrame:
        """(rec_id, start, stop, kind, value): heads and page numbers."""
        header = self._heads().select("rec_id", "start", "stop", "kind", F.col("line").alias("value"))
        numbers = self.found.where("kind IN ('page_number', 'bare_number')").withColumn("offset", F.col("number") - F.col("page"))
        # a number without a dress is the page's if it runs with the pages
        per = numbers.groupBy("book", "offset").agg(F.countDistinct("page").alias("n"))
        top = per.groupBy("book").agg(F.max(F.struct("n", "offset")).alias("m")).select("book", F.col("m.offset").alias("usual"), F.col("m.n").alias("n"))
        numbers = numbers.join(top, "book", "left")
        # a misread number keeps all but a digit or so
        right = F.col("offset") == F.col("usual")
        close = F.levenshtein(F.col("number").cast("string"), (F.col("page") + F.col("usual")).cast("string")) <= 1
        taken = F.when(F.col("kind") == "page_number", F.lit(True)).otherwise(right | (close & (F.length(F.trim("line")) > 1) & (F.col("n") >= 3)))
        numbers = numbers.where(taken).select("rec_id", "start", "stop", F.lit("page_number").alias("kind"), F.col("line").alias("value"))
        return header.unionAll(numbers)

    def words(self) -> DataFrame:
        """(rec_id, start, stop, kind, value): joined and misread words."""
        key, facts = ["rec_id", "start", "kind"], ["stop", "form", "left", "right", "mark", "before", "after"]
        line_words = self.found.where("kind = 'line_word'")
        no_head = line_words.join(self._heads().select("rec_id", "line"), ["rec_id", "line"], "left_anti").withColumn("kind", F.lit("word"))
        asked = self.found.where("kind IN ('word', 'break', 'code')").unionByName(no_head).select(*key, *facts, "roles")
        # without a mark a word is broken only where the lexicon has the joint
        loose = self.found.where("kind = 'loose'").select(*key, *facts, "roles")
        joints = F.filter("roles", lambda r: r["role"].isin("whole", "hyphen", "new", "hyphened"))
        joint = loose.select("rec_id", "start", F.explode(joints).alias("r")).select("rec_id", "start", _lookup(F.col("r.form")).alias("word"))
        known = joint.join(self.lexicon.select("word"), "word", "left_semi").select("rec_id", "start").distinct()
        asked = cut(asked.unionByName(loose.join(known, ["rec_id", "start"])))
        sought = asked.select(*key, *facts, F.explode("roles").alias("r")).select(*key, *facts, "r.role", F.col("r.form").alias("asked"))
        forms = sought.select("asked", (F.col("role").isin("whole", "hyphen") & (F.col("kind") != "loose")).alias("near"))
        forms = forms.groupBy(F.col("asked").alias("form")).agg(F.max("near").alias("near")).withColumn("word", _lookup(F.col("form")))
        looked = cut(forms.join(self.lexicon, "word", "left"))
        exact = looked.where("n IS NOT NULL").select("form", "word", "n", F.lit(0.0).alias("cost"))
        # a form longer than any word and what a repair takes away has no word
        unknown = looked.where(F.col("n").isNull() & F.col("near") & (F.length("form") <= self.longest + LENGTHS_APART))
        near = candidates(unknown, self.lexicon.where(~F.col("word").startswith("\0")), self.parts)
        # a form has few words, for they share a key of its few readings
        options = exact.unionByName(near).groupBy(F.col("form").alias("asked")).agg(F.collect_list(F.struct("word", "cost", "n")).alias("options"))
        made = sought.join(options, "asked", "left").withColumn("o", F.explode_outer("options")).drop("asked", "options")
        # context: how often a candidate stands beside its neighbours, and the halves beside each other
        side = lambda name, a, b: F.struct(F.lit(name).alias("side"), a.alias("a"), b.alias("b"))
        word, whole = F.col("o.word"), F.col("role").isin("whole", "hyphen") & F.col("o").isNotNull()
        sides = F.when(whole, F.array(side("before", F.col("before"), word), side("after", word, F.col("after"))))
        sides = sides.when(F.col("role") == "left", F.array(side("apart", F.lower("left"), F.lower("right"))))
        sides = sides.otherwise(F.array(side("none", F.lit(None).cast("string"), F.lit(None).cast("string"))))
        beside = made.withColumn("s", F.explode(F.filter(sides, lambda x: x["side"].isin("none", "apart") | x["a"].isNotNull() & x["b"].isNotNull() | (x["side"] == "before"))))
        # what has no neighbour must not meet on one null key
        pair = F.coalesce(F.when(F.col("s.a").isNotNull() & F.col("s.b").isNotNull(), pair_key(F.col("s.a"), F.col("s.b"))), F.xxhash64(F.lit("\0"), *key, "role"))
        counted = beside.select(*key, *facts, "role", "o", "s.side", pair.alias("pair")).join(self.bigrams, "pair", "left")
        counted = counted.withColumn("times", F.when(~F.col("side").isin("none"), F.col("times")))
        held = F.collect_list(F.struct("role", "o.word", "o.cost", "o.n", "side", "times")).alias("options")
        rows = counted.groupBy(*key).agg(*(F.first(c).alias(c) for c in facts), held)
        return rows.select("rec_id", "start", "stop", "kind", "form", "left", "right", "mark", "options").mapInArrow(
            _decide, "rec_id bigint, start int, stop int, kind string, value string"
        )

    def repairs(self) -> DataFrame:
        """All repairs: (rec_id, start, stop, kind, value), by character."""
        return self.lines().unionAll(self.words())

    def repaired(self) -> DataFrame:
        """(rec_id, text): the repaired texts, each paragraph of a scanned page
        on one line.  Records without scanned pages aren't among them; they
        stay as they are."""
        edits = cut(self.repairs()).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "value"))).alias("edits"))
        return self.records.join(edits, "rec_id", "left").select("rec_id", "text", "segments", "edits").mapInArrow(_apply, "rec_id bigint, text string")


def _lookup(form: Column) -> Column:
    """How a form is spelled in the lexicon: words in lower case."""
    return F.when(form.startswith("\0"), form).otherwise(F.lower(form))


def _titles(books: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(book, skeleton) of the titles of each book and of its bookmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skels = [title_key(_TITLE_NO.sub("", t.strip())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(skels, pa.string())], names=["book", "skeleton"])

    own = books.select(F.col("slug").alias("book"), "title")
    all_titles = own.unionAll(bookmarks.select("book", "title")).where("book IS NOT NULL AND title <> ''").distinct()
    return all_titles.mapInArrow(run, "book string, skeleton string").where("skeleton <> ''").distinct()


def score(cost: float, n: int, n_before: int, n_after: int) -> float:
    return 6 * cost - 0.3 * math.log1p(n) - 0.8 * math.log1p(n_before) - 0.8 * math.log1p(n_after)


def decide(kind: str, form: str, left: str | None, right: str | None, mark: str | None, apart: int, options: list[dict]) -> tuple[str, str] | None:
    """The repair of one occurrence: (kind, value) or None.  ``options``: what
    the lexicon has for each role, with its counts beside its neighbours;
    ``apart``: how often the halves stand beside each other as words."""
    ranked = sorted(options, key=lambda o: (score(o["cost"], o["n"], o["before"], o["after"]), o["word"]))
    by: dict[str, list[dict]] = {}
    for o in ranked:
        by.setdefault(o["role"], []).append(o)
    often = {r: by[r][0]["n"] if r in by else 0 for r in ("own", "new", "hyphened")}
    if kind == "word":
        if left is not None and often["new"] > TIMES_OFTENER * often["own"]:
            return "misread", left
        if often["own"]:
            return None  # tokens like this are meant
        best = by.get("whole", [])[:1]
        if not best or best[0]["cost"] == 0:
            return None
        if "-" in form and all(f"part{k}" in by for k in range(form.count("-") + 1)):
            return None  # a compound of words
        return "misread", recase(form, best[0]["word"])
    if often["new"] or often["hyphened"]:
        joint = left + "-" + right if often["hyphened"] > often["new"] else left + right
        return "hyphen", digits_undone(joint) or joint
    if kind == "code":
        return None
    whole = next((o for o in by.get("whole", ()) if o["cost"] == 0), None)
    hyphened = next((o for o in by.get("hyphen", ()) if o["cost"] == 0), None)
    l_known, r_known = "left" in by, "right" in by
    if kind == "loose":
        pick = max((o for o in (whole, hyphened) if o), key=lambda o: o["n"], default=None)
        if pick is None or (l_known and r_known and apart * 20 > pick["n"]):
            return None
        return "hyphen", recase(left + right, pick["word"])
    if whole or hyphened:
        # with both spellings known the more frequent one is meant
        pick = max((o for o in (whole, hyphened) if o), key=lambda o: o["n"])
        return "hyphen", recase(left + right, pick["word"])
    near = [o for o in ranked if o["role"] in ("whole", "hyphen")]
    if l_known and r_known and mark == "-":
        return None  # a suspended hyphen, or a compound the lexicon doesn't know
    if near:
        return "hyphen", recase(left + right, near[0]["word"])
    if r_known and mark == "-":
        return None
    if left[-1].isalpha() and right[0].isalpha():
        return "hyphen", left + right
    return None


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            options: dict[tuple, dict] = {}
            apart = 0
            for o in r["options"]:
                if o["side"] == "apart":
                    apart = o["times"] or 0
                if o["word"] is not None:
                    held = options.setdefault((o["role"], o["word"]), {"role": o["role"], "word": o["word"], "cost": o["cost"], "n": o["n"], "before": 0, "after": 0})
                    if o["side"] in ("before", "after"):
                        held[o["side"]] = o["times"] or 0
            if made := decide(r["kind"], r["form"], r["left"], r["right"], r["mark"], apart, list(options.values())):
                out.append((r["rec_id"], r["start"], r["stop"], *made))
        columns = list(zip(*out)) or [[] for _ in range(5)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rec_id", "start", "stop", "kind", "value"])


def apply_edits(text: str, segments: list[dict] | None, edits: list[dict]) -> str:
    """A record with its repairs made and the paragraphs of its scanned pages
    joined to one line each.  Unscanned pages stay as they are; scanned pages
    that follow each other are one, for a word may be broken over their edge."""
    runs: list[list] = []
    at = 0
    for s in segments or [{"length": len(text), "scanned": True}]:
        if runs and runs[-1][2] and s["scanned"]:
            runs[-1][1] = at + s["length"]
        else:
            runs.append([at, at + s["length"], s["scanned"]])
        at += s["length"] + 2
    runs[-1][1] = max(runs[-1][1], len(text))
    if not any(scanned for _, _, scanned in runs):
        return text
    parts = [
        _continuous(text, start, stop, [e for e in edits if start <= e["start"] < stop]) if scanned else text[start:stop]
        for start, stop, scanned in runs
    ]
    return "\n\n".join(p for p in parts if p)


def _continuous(text: str, start: int, stop: int, edits: list[dict]) -> str:
    """A stretch of scanned text with its repairs, one line a paragraph."""
    out: list[str] = []
    done, gone = start, "\x00"
    for e in edits:
        if e["start"] < done:
            continue
        out.append(text[done : e["start"]])
        out.append(gone if e["kind"] in ("header", "page_number") else e["value"])
        done = e["stop"]
    out.append(text[done:stop])
    whole = re.sub(r"(?:[ \t]*\n)*[ \t]*\x00[ \t]*(?:\n[ \t]*\x00[ \t]*)*(?:\n[ \t]*)*", "\n", "".join(out))
    paragraphs = [" ".join(line.strip() for line in p.split("\n") if line.strip()) for p in re.split(r"\n[ \t]*\n", whole)]
    return "\n\n".join(p for p in paragraphs if p)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        texts = [apply_edits(r["text"], r["segments"], r["edits"] or []) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rec_id", "text"])


def _library(spark: SparkSession, sf_dir: str) -> ScanNoise:
    return ScanNoise(*(table(spark, sf_dir, t) for t in ("books", "bookmarks", "chunks", "figures", "page_texts", "extract_results")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).repairs().select("rec_id", "kind", "value").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).repaired()

"""Bringing text that looks the same to one form.

Method: DuckDB runs inside each Arrow partition; one embedded SQL expression
takes out invisible characters, spells ligatures out, maps compatibility forms,
spaces and look-alike letters with translate, and composes accents with
nfc_normalize.

Kept apart is whatever a reader can tell apart: case, wording, digits,
punctuation, real accents, and raised, circled or fraction digits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut, table

# Letters and signs of other scripts with the Latin (or Greek)
# character they can't be told from.
LOOKALIKES = {
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԚQ ԜW ӀI "
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ԍG ": "Cyrillic",
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj ": "Greek",
    "օo ՕO ѕs ɡg ɑa ": "other letters",
    "µμ ∆Δ ∑Σ ∏Π ‐- ⁄/ ∕/ ∣| ⋅· ∙· ˚° ‒– ": "signs",
}
#: Records of one string that one task joins to a pair of strings.
IDS_TOGETHER = 50_000
# Invisible characters that aren't format characters (Cf).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def mapping() -> tuple[dict[str, str], dict[str, str], str]:
    """Single characters to one character, single characters to several, and
    the invisible ones.  The tables follow from Unicode's properties and
    LOOKALIKES."""
    base = {p[0]: p[1] for group in LOOKALIKES for p in group.split()}
    one, several, invisible = dict(base), {}, [*INVISIBLE]
    # beyond these there are only ideographs, private use and nothing
    for cp in (*range(0x20000), *range(0xE0000, 0xE0200)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if kind == "Zs" or c in "\t\n\v\f\r\x85  ":
            one[c] = " "
            continue
        if kind in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            if cp:
                invisible.append(c)
            continue
        tag, _, parts = unicodedata.decomposition(c).rpartition(">")
        to = None
        if tag in ("<wide", "<narrow", "<noBreak"):
            to = unicodedata.normalize("NFKC", c)
        elif tag == "<compat" and kind[0] in "LN" and ("LIGATURE" in (name := unicodedata.name(c)) or "ROMAN NUMERAL" in name or name.startswith("LATIN") and len(parts.split()) == 2):
            to = unicodedata.normalize("NFKC", c)
        elif not tag and parts:  # composed: its base may have a look-alike
            split = unicodedata.normalize("NFD", c)
            if split[0] in base:
                to = unicodedata.normalize("NFC", base[split[0]] + split[1:])
        if to and to != c:
            to = "".join(base.get(x, x) for x in to)
            (one if len(to) == 1 else several)[c] = to
    return one, several, "".join(invisible)


@lru_cache(1)
def form_sql(column: str = "s") -> str:
    """The SQL expression of the one form of a column."""
    one, several, invisible = mapping()
    sql = f"translate({column}, {_quoted(invisible)}, '')"
    for c, to in several.items():
        sql = f"replace({sql}, {_quoted(c)}, {_quoted(to)})"
    sql = f"nfc_normalize(translate({sql}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))}))"
    # plain ASCII only needs its ends trimmed
    return rf"trim(CASE WHEN regexp_matches({column}, '[^ -~]') THEN {sql} ELSE {column} END, ' ')"


def one_form(df: DataFrame, column: str, out: str = "form") -> DataFrame:
    """Add ``out``, the one form of a string column; every other column stays.

    Null stays null, an empty text empty; a text of invisible characters and
    spaces only becomes empty.  Repeated rows stay repeated.  An existing
    column ``out`` is replaced.  No shuffle; texts of any length go through
    whole."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields if f.name != out]
    sql = f"SELECT {form_sql()} AS form FROM texts"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                texts = pa.table({"s": batch.column(names.index(column)).cast(pa.string())})
                con.register("texts", texts)
                form = con.sql(sql).to_arrow_table()
                con.unregister("texts")
                forms = form.column(0).combine_chunks().cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, forms], names=[*names, out])

    return df.select(*(df[n] for n in names)).mapInArrow(run, schema)


def same_looking(records: DataFrame) -> DataFrame:
    """Pairs of records of one book whose strings differ and look the same.

    ``records`` has (book, id, s).  Returns distinct (a_id, b_id), a_id < b_id.
    Null and empty strings, null books and null ids are left out; repeated rows
    count once.  The form is made once per distinct string of a book.  Pairs
    are made between distinct strings and only then spread to the records, so
    records with equal strings never meet; a string of many records is spread
    in parts of IDS_TOGETHER.  ``one_form`` gives the same as membership: a row
    per record with its class."""
    rows = records.where("book IS NOT NULL AND id IS NOT NULL AND s <> ''").select("book", "id", "s")
    strings = one_form(rows.select("book", "s").distinct(), "s").where("form <> ''")
    # two strings only differ in form-neutral ways if their form has several strings
    alike = F.count("*").over(Window.partitionBy("book", "form"))
    classes = strings.withColumn("alike", alike).where("alike > 1").select("book", "form", "s")
    members = cut(rows.join(classes, ["book", "s"]).select("book", "form", "s", "id").distinct())
    sizes = members.groupBy("book", "form", "s").agg(F.count("*").alias("n"))
    other = sizes.select("book", "form", F.col("s").alias("t"), F.col("n").alias("m"))
    # distinct strings of one form; each such pair gives at least one row
    pairs = sizes.join(other, ["book", "form"]).where("s < t").select("book", "s", "t", "n", "m")
    parts = lambda n: F.ceil(F.col(n) / IDS_TOGETHER).cast("int")
    members = members.join(sizes.drop("form"), ["book", "s"]).select("book", "s", "id", F.pmod(F.xxhash64("id"), parts("n")).cast("int").alias("part"))
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    left = pairs.withColumn("part", every("n")).join(members.withColumnRenamed("id", "x"), ["book", "s", "part"])
    right = members.select("book", F.col("s").alias("t"), "part", F.col("id").alias("y"))
    out = left.select("book", "t", "m", "x").withColumn("part", every("m")).join(right, ["book", "t", "part"])
    return out.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).where("a_id < b_id").distinct()


def title_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and captions of all books as (book, id, s)."""
    parts = (("bookmarks", "bookmark_id", "title"), ("chunks", "chunk_id", "title"), ("figures", "figure_id", "caption"))
    out = None
    for name, key, text in parts:
        part = table(spark, sf_dir, name).select("book", F.col(key).alias("id"), F.col(text).alias("s"))
        out = part if out is None else out.unionAll(part)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking(title_records(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every title and caption: (id, form)."""
    return one_form(title_records(spark, sf_dir).select("id", "s").distinct(), "s").select("id", "form")

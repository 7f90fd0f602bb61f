"""Lines that one source repeats in many of its documents.

Method: every partition parses the lines of its documents into token trees of
fixed depth, one for each source: the number of tokens, then the first tokens,
then a leaf.  A leaf is a template: the tokens of its path, and wildcard slots
for all tokens behind them; runs of digits are slots, too.  Each leaf counts the
documents with a line in it.  The trees merge over the partitions leaf by leaf,
by adding their counts.  Only lines in leaves that cover many documents of
their source are looked at further: they are told apart by all their tokens,
and those that many documents have are removed.  A line is never in more
documents than its leaf, so none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut, table

#: Tokens by which the tree branches before its leaves.
DEPTH = 4
#: Leaves that a task's trees hold before they are handed on and begun anew;
#: it bounds memory only, since trees merge by adding.
LEAVES_KEPT = 200_000
#: A wildcard slot: a run of the digits 0 to 9, of any length.
SLOT = "<*>"
_DIGITS = re.compile("[0-9]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class TokenTree:
    """Leaves by number of tokens and first tokens, with the documents of each."""

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.leaves: dict[tuple[str, ...], list] = {}  # digest, documents, the last of them

    def add(self, line: str, doc: int) -> tuple[int, int]:
        """Add a line of the ``doc``-th document.  Returns the digests of its
        leaf and of all its tokens."""
        tokens = _DIGITS.sub(SLOT, line.casefold()).split()
        path = (str(len(tokens)), *tokens[: self.depth])
        leaf = self.leaves.get(path)
        if leaf is None:
            leaf = self.leaves[path] = [_digest(" ".join(path)), 0, None]
        if leaf[2] != doc:
            leaf[1] += 1
            leaf[2] = doc
        return leaf[0], _digest(" ".join(tokens))


def letters(line: str) -> int:
    return len(_NOT_LETTERS.sub("", line))


def parsed_lines(docs: DataFrame, source: str, doc_id: str, text: str, least_letters: int, longest: int) -> DataFrame:
    """(source BIGINT, leaf BIGINT, docs, line BIGINT, doc, lines ARRAY<INT>):
    by digests, the leaves of each task's trees with their number of documents
    (line, doc and lines are null), and the lines of each document with the
    leaf they are in and where they stand (docs is null)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["source", "leaf", "docs", "line", "doc", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, TokenTree] = {}

        def rows(columns: list[list], id_type: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), id_type, pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def handed_on(id_type: pa.DataType) -> pa.RecordBatch:
            leaves = [(s, leaf, n) for s, tree in trees.items() for leaf, n, _ in tree.leaves.values()]
            trees.clear()
            none = [None] * len(leaves)
            return rows([*([r[k] for r in leaves] for k in range(3)), none, none, none], id_type)

        at, id_type = 0, None
        for batch in batches:
            id_type = batch.schema.field(1).type
            out: list[list] = [[] for _ in names]
            for src, doc, body in zip(*(c.to_pylist() for c in batch.columns)):
                at += 1
                tree = trees.setdefault(src, TokenTree())
                found: dict[tuple[int, int], list[int]] = {}
                for no, line in enumerate(body.split("\n"), 1):
                    if least_letters <= len(line) <= longest and letters(line) >= least_letters:
                        found.setdefault(tree.add(line, at), []).append(no)
                for column, values in zip(out, ([src] * len(found), [k[0] for k in found], [None] * len(found), [k[1] for k in found], [doc] * len(found), found.values())):
                    column += values
            yield rows(out, id_type)
            if sum(len(tree.leaves) for tree in trees.values()) > LEAVES_KEPT:
                yield handed_on(id_type)
        if id_type is not None:
            yield handed_on(id_type)

    held = docs.where(docs[source].isNotNull() & docs[doc_id].isNotNull() & docs[text].isNotNull())
    held = held.select(F.xxhash64(docs[source]), docs[doc_id], docs[text])
    return held.mapInArrow(run, f"source bigint, leaf bigint, docs bigint, line bigint, doc {kind}, lines array<int>")


def repeated_lines(
    docs: DataFrame,
    source: str = "book",
    doc_id: str = "chunk_id",
    text: str = "text",
    least_docs: int = 4,
    least_share: float = 0.2,
    least_letters: int = 8,
    longest: int = 400,
) -> DataFrame:
    """Lines to remove: (doc_id, line_no), lines counted from 1.

    Lines are separated by LF.  Two lines are the same if they differ only in
    letter case, white space or runs of the digits 0 to 9.  A line of at least
    ``least_letters`` letters and at most ``longest`` characters is removed if
    it stands in at least ``least_docs`` documents and in at least
    ``least_share`` of the documents of its source.

    Documents are told apart by doc_id, so repeated rows count once; a document
    with a null text counts as one of its source.  Rows with a null source or
    id are left out.  Extra columns don't matter."""
    parsed = cut(parsed_lines(docs, source, doc_id, text, least_letters, longest))
    sizes = (
        docs.where(docs[source].isNotNull() & docs[doc_id].isNotNull())
        .select(F.xxhash64(docs[source]).alias("source"), docs[doc_id].alias("doc"))
        .groupBy("source")
        .agg(F.countDistinct("doc").alias("of"))
    )
    enough = lambda n: (n >= least_docs) & (n >= least_share * F.col("of"))
    # merged trees; where rows are repeated the counts are too high, never too low
    leaves = parsed.where("docs IS NOT NULL").groupBy("source", "leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= least_docs)
    leaves = leaves.join(sizes, "source").where(enough(F.col("n"))).select("source", "leaf", "of")
    lines = parsed.where("docs IS NULL").drop("docs").join(leaves, ["source", "leaf"]).select("source", "line", "doc", "lines", "of")
    lines = cut(lines)
    often = lines.groupBy("source", "line").agg(F.countDistinct("doc").alias("n"), F.first("of").alias("of")).where(enough(F.col("n")))
    gone = lines.join(often.select("source", "line"), ["source", "line"], "left_semi").select("doc", F.explode("lines").alias("line_no"))
    return gone.distinct().withColumnRenamed("doc", doc_id)


def without_repeated_lines(docs: DataFrame, source: str = "book", doc_id: str = "chunk_id", text: str = "text", **limits) -> DataFrame:
    """The documents with the lines of ``repeated_lines`` taken out of their
    text; everything else, rows repeated or null included, stays as it was."""
    gone = repeated_lines(docs, source, doc_id, text, **limits)
    per = gone.groupBy(F.col(doc_id).alias("__doc")).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda _, k: ~F.array_contains("__gone", (k + 1).cast("int")))
    clean = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return docs.join(per, F.col("__doc") == docs[doc_id], "left").withColumn(text, clean).drop("__doc", "__gone")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "chunks"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "chunks")).select("chunk_id", "book", "text")

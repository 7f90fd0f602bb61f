"""Encoding a corpus with a public byte-level BPE tokenizer.

Method: prefix dynamic programming.  For every byte prefix of a word exactly
one token ends a valid encoding of that prefix: the token t for which the
encoding of what precedes t, followed by t, is what the merges would give.
``PrefixTable`` stores that last token for every prefix.  Reading it backwards
gives the encoding of any prefix; appending bytes only adds entries, so an
append is exact; after an edit only entries from the edit on are computed
again, until the table has fallen into step with the old one.

Whether two tokens may stand side by side is decided by undoing the merges
that made them, latest first (``Vocabulary.adjacent``).

Texts are cut into words, the tokenizer's pattern cuts the words further, and
the result for each distinct word is kept per Python worker.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quire.session import table

#: Words kept per worker and vocabulary; beyond it the memory of words starts
#: anew.  It bounds memory only, never the result.
WORDS_KEPT = 300_000

# A word with the space before it, or a run of white space up to the last
# character before a word.  Each end of such a unit also ends a match of the
# tokenizer's pattern, so units can be encoded one by one.
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Characters that are white space here and not in the pattern.
_ODD = re.compile("[\x1c-\x1f]")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer: a path is taken as it is, a bare name is
    looked up among the installed ones (.json before .tiktoken and .model)."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    for end in ("", ".json", ".tiktoken", ".model"):
        if os.path.isfile(path := str(public_tokenizers.path(name + end))):
            return path
    raise FileNotFoundError(f"no public tokenizer {name!r}")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies in JSON write bytes:
    printable Latin-1 stands for itself, the rest is numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE: their ids, and how each was merged."""

    def __init__(self, ids: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]] | None, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ids = ids
        self.longest = max(map(len, ids))
        self.words: dict[str, tuple[int, ...]] = {}
        #: Rank of the merge that makes a token; a byte is there from the start.
        self.born = {i: -1 for t, i in ids.items() if len(t) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        if merges is None:  # ids in order of the merges; the halves are what the earlier merges leave
            for token, i in sorted(ids.items(), key=lambda x: x[1]):
                for k in range(1, len(token)):
                    a, b = ids.get(token[:k]), ids.get(token[k:])
                    if a in self.born and b in self.born and self.adjacent(a, b):
                        self._merge(a, b, i)
                        break
        else:
            for a, b in merges:
                if a in ids and b in ids and a + b in ids:
                    self._merge(ids[a], ids[b], ids[a + b])
        self.suffixes = {t[k:] for t in ids for k in range(len(t))}
        self.adjacent_kept = lru_cache(1 << 17)(self.adjacent)
        self.encode_piece = lru_cache(1 << 16)(self._encode_piece)

    def _merge(self, a: int, b: int, made: int) -> None:
        if made not in self.born:
            self.born[made], self.halves[made] = len(self.halves), (a, b)
        self.merged.setdefault((a, b), self.born[made])

    def adjacent(self, a: int, b: int) -> bool:
        """Whether a followed by b is what the merges give for their bytes."""
        born, limit = self.born, 1 << 60
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False  # at this seam another merge would have come first
            if born[a] > born[b]:
                limit, a = born[a], self.halves[a][1]
            elif born[b] >= 0:  # of equal merges the left one comes first
                limit, b = born[b] + 1, self.halves[b][0]
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word as _UNIT cuts it, or of any text cut nowhere."""
        return tuple(chain.from_iterable(map(self.encode_piece, self.pattern.findall(word))))

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ids.get(raw)
        return (whole,) if whole in self.born else tuple(PrefixTable(self, raw).encoding())

    def lookup(self, words: Iterable[str]) -> list[tuple[int, ...]]:
        known = self.words
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = self.encode_word(word)
            return list(map(known.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(self.lookup(self.cut(text))))

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text) if _ODD.search(text) else _UNIT.findall(text)

    def count(self, text: str | None) -> int:
        return sum(map(len, self.lookup(self.cut(text)))) if text else 0


class PrefixTable:
    """The last token of every prefix of a piece that the pattern doesn't cut."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last, self.sizes = vocabulary, b"", [-1], [0]
        self.append(raw)

    def _entry(self, raw: bytes, end: int) -> tuple[int, int]:
        v = self.vocabulary
        for size in range(1, min(end, v.longest) + 1):
            token = raw[end - size : end]
            if token not in v.suffixes:
                break
            t = v.ids.get(token)
            if t in v.born and (size == end or v.adjacent_kept(self.last[end - size], t)):
                return t, size
        raise ValueError("the vocabulary has no token for some byte")

    def append(self, raw: bytes) -> None:
        """Add bytes at the end; no entry made before changes."""
        done, self.raw = len(self.raw), self.raw + raw
        for end in range(done + 1, len(self.raw) + 1):
            t, size = self._entry(self.raw, end)
            self.last.append(t)
            self.sizes.append(size)

    def replace(self, start: int, stop: int, raw: bytes) -> int:
        """Put other bytes in place of start..stop; returns how many entries
        were computed."""
        old_last, old_sizes, old_len = self.last, self.sizes, len(self.raw)
        self.raw = self.raw[:start] + raw + self.raw[stop:]
        self.last, self.sizes = old_last[: start + 1], old_sizes[: start + 1]
        shift, same = len(raw) - (stop - start), 0
        for end in range(start + 1, len(self.raw) + 1):
            t, size = self._entry(self.raw, end)
            self.last.append(t)
            self.sizes.append(size)
            old = end - shift
            # an entry depends on as many entries as the longest token has bytes
            same = same + 1 if stop < old <= old_len and old_last[old] == t else 0
            if same > self.vocabulary.longest:
                self.last += old_last[old + 1 :]
                self.sizes += old_sizes[old + 1 :]
                return end - start
        return len(self.raw) - start

    def encoding(self, end: int | None = None) -> list[int]:
        end, out = len(self.raw) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= self.sizes[end]
        return out[::-1]


class EncodedText:
    """A text and its ids, kept right under appends and edits by cutting and
    encoding again only the words near the change."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.words = vocabulary, text, _UNIT.findall(text)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Put ``new`` in place of characters start..stop; returns how many
        words were cut again."""
        at, first = 0, 0
        # the end of a word can depend on the word after it
        while first + 1 < len(self.words) and at + len(self.words[first]) + len(self.words[first + 1]) < start:
            at += len(self.words[first])
            first += 1
        ends, where = {}, at
        for k in range(first, len(self.words)):
            ends[where] = k
            where += len(self.words[k])
        text = self.text[:start] + new + self.text[stop:]
        shift, again = len(new) - (stop - start), []
        while at < len(text):
            if at - shift >= stop and at - shift in ends and (at - shift > stop or not again):
                break
            again.append(_UNIT.match(text, at).group())
            at += len(again[-1])
        self.words[first:] = again + (self.words[ends[at - shift] :] if at < len(text) else [])
        self.text = text
        return len(again)

    def append(self, new: str) -> int:
        return self.replace(len(self.text), len(self.text), new)

    def ids(self) -> list[int]:
        if _ODD.search(self.text):
            return self.vocabulary.encode(self.text)
        return list(chain.from_iterable(self.vocabulary.lookup(self.words)))


@lru_cache(4)
def vocabulary(name: str) -> Vocabulary:
    """A vocabulary by name or path, loaded once per process."""
    import public_tokenizers

    path = tokenizer_path(name)
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} isn't a byte-level BPE")
        letter = _byte_letters()
        spell = lambda s: bytes(letter[c] for c in s)
        ids = {spell(t): i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        merges = [tuple(map(spell, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        return Vocabulary(ids, merges, public_tokenizers.PATTERN)
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(ids, None, public_tokenizers.PATTERN)


@lru_cache(4)
def counter(name: str):
    """A function that counts the tokens of a text under any public tokenizer;
    byte-level ones go through the prefix tables."""
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1)) if text else 0
    try:
        return vocabulary(name).count
    except ValueError:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda text: len(model.encode(text, add_special_tokens=False).ids) if text else 0


def encode_documents(
    documents: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of each document's text, without special tokens.

    Returns (id_col, ids ARRAY<INT>), one row per input row.  Null and empty
    texts give an empty list; a special token's string inside a text is
    ordinary text; repeated rows come out as often as they came in; a null id
    stays null; other columns are left out, whatever their names.  No shuffle:
    one pass over two columns of the scan."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            values, offsets = array("i"), np.zeros(batch.num_rows + 1, dtype=np.int32)
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    values.extend(chain.from_iterable(vocab.lookup(vocab.cut(text))))
                offsets[k + 1] = len(values)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    out = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    return out.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(
    documents: DataFrame, tokenizers: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Numbers of tokens of each text: (id_col, sizes ARRAY<INT>), in the order
    of ``tokenizers``; null and empty texts have 0.  One pass for all."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [counter(t) for t in tokenizers]
        for batch in batches:
            sizes = [[c(text) for c in counts] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.list_(pa.int32()))], names=["id", "sizes"])

    out = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    return out.mapInArrow(run, f"id {kind}, sizes array<int>").withColumnRenamed("id", id_col)


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))

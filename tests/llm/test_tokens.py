import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.tokens import EncodedText, PrefixTable, counter, encode_documents, token_counts, vocabulary

TEXT = st.text(alphabet="ab 's\n\t  éż\x1c\x85\xa0　½²12.,<|endoftext|>'ll𝄞ñ--==AA", max_size=60)


def public(name):
    with open(public_tokenizers.path(name + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_equals_the_public_encoder(name):
    ours, theirs = vocabulary(name), public(name)

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def check(text):
        assert ours.encode(text) == theirs.encode_ordinary(text)
        assert ours.count(text) == len(ours.encode(text))

    check()
    long = "x" * 30000 + " " * 5000 + "ab1" * 3000
    assert ours.encode(long) == theirs.encode_ordinary(long)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.data())
def test_edits_and_appends(text, new, data):
    vocab = vocabulary("byte_bpe_50k")
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    edited = EncodedText(vocab, text)
    edited.replace(a, b, new)
    edited.append(new)
    assert edited.text == text[:a] + new + text[b:] + new and edited.ids() == vocab.encode(edited.text)
    raw = text.encode()
    table = PrefixTable(vocab, raw)
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    table.replace(a, b, new.encode())
    assert table.last == PrefixTable(vocab, table.raw).last


def test_an_edit_encodes_little_again():
    vocab = vocabulary("byte_bpe_50k")
    text = EncodedText(vocab, "word " * 1000)
    assert text.replace(2500, 2501, "xyz") < 5


def test_documents(spark):
    rows = [(1, "Hello <|endoftext|>", 9), (2, "", 9), (3, None, 9), (3, None, 9), (None, "a", 9), (4, "a" * 20000, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = encode_documents(docs)
    assert out.columns == ["doc_id", "ids"] and out.count() == 6
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    for r in out.collect():
        if r.doc_id in (1, 4):
            assert r.ids == model.encode(dict((x[0], x[1]) for x in rows)[r.doc_id], add_special_tokens=False).ids
        elif r.doc_id:
            assert r.ids == []
    assert encode_documents(docs.limit(0)).count() == 0
    sizes = {r.doc_id: r.sizes for r in token_counts(docs, ["byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k"]).collect()}
    assert sizes[2] == [0, 0, 0] and min(sizes[1]) > 0
    with pytest.raises(FileNotFoundError):
        counter("none_such")

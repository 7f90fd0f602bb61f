import random

import pytest

from quire.llm import shared_spans
from quire.llm.shared_spans import SharedSpans, shared_characters, without_shared


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))[:n]
    part, notice = fresh(260), fresh(199)
    docs = {1: fresh(300) + part + fresh(90), 2: part[:200] + fresh(40), 3: fresh(50) + part[60:], 4: part[61:] + fresh(5), 5: fresh(700)}
    for k in range(6, 14):  # 199 characters are none
        docs[k] = fresh(120) + notice + fresh(120)
    whole = fresh(210)
    for k in range(30, 36):  # a paragraph of its own
        docs[k] = fresh(90) + "\n\n" + whole + "\n \n" + fresh(30)
    docs |= {20: docs[5], 21: docs[5], 22: "z" * 900, 23: "z" * 400 + fresh(30), 24: "short", 25: "", 26: None}
    return docs


def expected(docs, least=200):
    grams = {i: {t[k : k + least] for k in range(len(t) - least + 1)} for i, t in docs.items() if t}
    pairs = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    shared = {}
    for i, t in docs.items():
        others = set().union(*(g for j, g in grams.items() if j != i)) if t else set()
        shared[i] = len({p for k in range(len(t or "") - least + 1) if t[k : k + least] in others for p in range(k, k + least)})
    return pairs, shared


def test_paragraphs():
    a, b = "x y\n" * 60, "long line " * 30
    text = f"  {a} \t\n\r\n{b}\n\nshort\n \n{a}"
    found = shared_spans.paragraphs(text, 200)
    assert [text[s:e] for s, e in found.items()] == [a.strip(), b.strip(), a.strip()]


@pytest.mark.parametrize("compared, together", [(64, 4096), (1, 2)])
def test_against_brute_force(spark, monkeypatch, compared, together):
    monkeypatch.setattr(shared_spans, "COMPARED", compared)
    monkeypatch.setattr(shared_spans, "PAIRED_TOGETHER", together)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [(1, docs[1], "x"), (None, docs[1], "x")], "doc_id bigint, text string, size string")
    pairs, shared = expected(docs)
    found = SharedSpans(df)
    rows = [tuple(r) for r in found.pairs().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == pairs
    assert {r.doc_id: r.shared for r in shared_characters(df).collect()} == shared
    members = {(r.doc_id, r.earliest) for r in found.members().collect()}
    linked = lambda a, b: any((a, e) in members and (b, e) in members for e in docs)
    assert all(linked(a, b) for a, b in pairs) and {d for d, _ in members} == {d for d, n in shared.items() if n}
    kept = {r.doc_id: r.text for r in without_shared(df).collect() if r.doc_id}
    assert kept[20] == "" and kept[5] == docs[5] and kept[26] is None and kept[1] == docs[1] and len(kept[2]) < 45


def test_one_id_with_two_texts(spark):
    a, b = "first text of the two " * 20, "quite another one than that " * 20
    df = spark.createDataFrame([(1, a + "\n\n" + b), (1, b[:300] + "x"), (2, a), (3, b)], "doc_id bigint, text string")
    assert {(r.doc_a, r.doc_b) for r in SharedSpans(df).pairs().collect()} <= {(1, 2), (1, 3)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert SharedSpans(df).pairs().count() == 0 and shared_characters(df).count() == 0

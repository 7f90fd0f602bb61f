import re
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import repeated_lines as repeated_lines_module
from quire.llm.repeated_lines import TokenTree, repeated_lines, without_repeated_lines

SCHEMA = "chunk_id bigint, book string, text string, source string, lines string"


@given(st.lists(st.text(alphabet="aB 12\t\xa0", max_size=30), max_size=12))
def test_leaves_and_lines(lines):
    key = lambda s: tuple(re.sub("[0-9]+", "<*>", s.casefold()).split())
    tree, leaves, keys = TokenTree(depth=2), {}, {}
    for doc, line in enumerate(lines):
        leaf, whole = tree.add(line, doc // 2)
        assert leaves.setdefault((len(key(line)), key(line)[:2]), leaf) == leaf
        assert keys.setdefault(key(line), whole) == whole
    assert len(set(keys.values())) == len(keys) and len(set(leaves.values())) == len(leaves)
    docs = {leaf: {n // 2 for n, x in enumerate(lines) if (len(key(x)), key(x)[:2]) == path} for path, leaf in leaves.items()}
    assert {leaf: n for leaf, n, _ in tree.leaves.values()} == {leaf: len(d) for leaf, d in docs.items()}


def rows():
    notice = ["Shared 12 times  here", "SHARED 7 TIMES HERE", "shared\t99999 times here ", "  Shared 1 times here\r"]
    out = [(k, "b", f"own line number {'x' * k}\n{notice[k % 4]}\nshort 1\n{'long notice ' * 40}", "s", "l") for k in range(8)]
    out += [(100 + k, "c", f"Shared 3 times here\nbody {'y' * k} text", "s", "l") for k in range(3)]
    return out + [(200, "b", None, "s", "l"), (201, "b", "", "s", "l"), (None, "b", "Shared 12 times here", "s", "l"), (202, None, "Shared 12 times here", "s", "l"), out[0]]


@pytest.mark.parametrize("kept", [200_000, 1])
def test_against_brute_force(spark, monkeypatch, kept):
    monkeypatch.setattr(repeated_lines_module, "LEAVES_KEPT", kept)
    found = {tuple(r) for r in repeated_lines(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()}
    seen, docs, at = defaultdict(set), defaultdict(set), []
    for doc, book, text, *_ in rows():
        if doc is None or book is None:
            continue
        docs[book].add(doc)
        for no, line in enumerate((text or "").split("\n"), 1):
            if len(line) <= 400 and sum(c.isalpha() for c in line) >= 8:
                key = book, " ".join(re.sub("[0-9]+", "#", line.casefold()).split())
                seen[key].add(doc)
                at.append((key, doc, no))
    assert found == {(d, n) for k, d, n in at if len(seen[k]) >= 4 and len(seen[k]) >= 0.2 * len(docs[k[0]])} and found


def test_removed(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    clean = without_repeated_lines(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    texts = {r.chunk_id: r.text for r in clean.collect()}
    assert texts[3].startswith("own line number xxx\nshort 1\n") and texts[200] is None and texts[201] == "" and "Shared" in texts[100]
    assert repeated_lines(df.limit(0)).count() == 0

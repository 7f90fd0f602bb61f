from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from quire.llm import packing
from quire.llm.packing import best_fit, fill_report, pack, pack_documents


@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 90))
def test_best_fit(sizes, capacity):
    bins, fills = best_fit(sizes, capacity)
    held = defaultdict(int)
    for b, s in zip(bins, sizes):
        held[b] += s
    assert [held[k] for k in range(len(fills))] == fills and all(f <= capacity for f in fills)
    # two bins that fit into one would not both be open
    assert sum(f * 2 <= capacity for f in fills) <= 1 or not sizes


def check(rows, items, capacities):
    for c, capacity in enumerate(capacities):
        fill, parts = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.c == c:
                fill[r.bin] += r.size
                parts[r.id].append((r.start, r.size))
        assert all(f <= capacity for f in fill.values())
        for i, sizes in items.items():
            got = sorted(parts[i])
            size = max(sizes[c] or 0, 0)
            assert sum(s for _, s in got) == size
            assert len(got) == (1 if size <= capacity else -(-size // capacity))
            assert [a for a, _ in got] == [k * capacity for k in range(len(got))]


def test_rounds(spark):
    items = {k: [(k * 37) % 60, (k * 53) % 300] for k in range(3000)} | {9000: [None, -1], 9001: [0, 1000], 9002: [64, 100]}
    df = spark.createDataFrame([(k, v) for k, v in items.items()], "id bigint, sizes array<int>").repartition(6)
    rows = pack(df, [64, 100], block=40).collect()
    check(rows, items, [64, 100])
    total = sum(v[0] or 0 for v in items.values())
    assert len({r.bin for r in rows if r.c == 0}) < 1.3 * total / 64
    assert pack(df.limit(0), [64]).count() == 0


def test_bins_that_nothing_joins_end_the_rounds(spark, monkeypatch):
    groups = []
    merge = packing._merge_bins
    monkeypatch.setattr(packing, "_merge_bins", lambda capacities, no: groups.append(no) or merge(capacities, no))
    df = spark.createDataFrame([(k, [60]) for k in range(4000)], "id bigint, sizes array<int>").repartition(8)
    rows = pack(df, [100], block=50).collect()
    assert len({r.bin for r in rows}) == 4000 and not groups
    # a few small ones among them: groups stay near ``block`` however many bins there are
    df = spark.createDataFrame([(k, [60 if k % 100 else 35]) for k in range(4000)], "id bigint, sizes array<int>").repartition(8)
    rows = pack(df, [100], block=50).collect()
    check(rows, {k: [60 if k % 100 else 35] for k in range(4000)}, [100])
    assert len({r.bin for r in rows}) == 3960 and len(groups) < 5


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c " * 900, 5), (2, None, 5), (3, "", 5), (4, "short", 5)], "doc_id bigint, text string, bin int")
    kinds = spark.createDataFrame([("s", "byte_bpe_50k", 512), ("l", "byte_bpe_multi_50k", 4096), ("x", None, 3), ("y", "byte_bpe_50k", None)], "container string, tokenizer string, capacity int")
    out = pack_documents(docs, kinds).cache()
    assert {r.container for r in out.collect()} == {"s", "l"}
    assert out.where("container = 's' AND doc_id = 1").count() > 1 and out.where("container = 'l' AND doc_id = 1").count() == 1
    assert {r.tokens for r in out.where("doc_id IN (2, 3)").collect()} == {0}
    assert all(r.fullest <= {"s": 512, "l": 4096}[r.container] for r in fill_report(out, kinds).collect())
    assert pack_documents(docs, kinds.limit(0)).count() == 0

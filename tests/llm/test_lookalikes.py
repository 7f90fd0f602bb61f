from quire.llm import lookalikes
from quire.llm.lookalikes import one_form, same_looking

SAME = ["Ｆｕｌｌ ﬁt", "Full fit", "Fu​ll\xa0fit ", "F­ull ﬁt", "Fulⅼ fit", "Fulӏ fit".replace("ӏ", "l")]


def test_forms(spark):
    pairs = [("é", "é"), ("Ω", "Ω"), ("Å", "А̊"), ("µ", "μ"), ("Ο", "O"), ("ö", "ӧ"), ("a b", "a b"), ("Ⅳ", "IV"), ("‐", "-")]
    apart = [("a", "A"), ("x²", "x2"), ("①", "1"), ("½", "1⁄2"), ("e", "é"), ("a.", "a"), ("1", "l"), ("–", "-")]
    rows = [(k, s) for k, p in enumerate(pairs + apart) for s in p]
    form = {}
    for r in one_form(spark.createDataFrame(rows, "k int, s string"), "s").collect():
        form.setdefault(r.k, set()).add(r.form)
    for k, p in enumerate(pairs + apart):
        assert (len(form[k]) == 1) == (k < len(pairs)), p


def test_pairs(spark):
    rows = [("b", k, s, "x") for k, s in enumerate(SAME)] + [("b", 50, "Full fit", "x"), ("b", 50, "Full fit", "x"), ("c", 60, "Full fit", "x"), ("b", 70, None, "x"), ("b", 71, "", "x"), (None, 72, "Full fit", "x"), ("b", None, "Full fit", "x")]
    df = spark.createDataFrame(rows, "book string, id bigint, s string, form string")
    found = {tuple(r) for r in same_looking(df).collect()}
    ids = {**dict(enumerate(SAME)), 50: "Full fit"}
    assert found == {(a, b) for a in ids for b in ids if a < b and ids[a] != ids[b]}
    assert same_looking(df.limit(0)).count() == 0


def test_many_records_of_one_string(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "IDS_TOGETHER", 1000)
    many = spark.range(100_000).selectExpr("'b' AS book", "id", "'One caption' AS s")
    odd = spark.createDataFrame([("b", 100_001, "One\u00a0caption"), ("b", 100_002, "One caption ")], "book string, id bigint, s string")
    found = same_looking(many.unionAll(odd))
    assert found.count() == 200_001 and found.where("a_id < 100001 AND b_id < 100001").count() == 0


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a​", "old"), (2, None, None)], "id int, s string, form string")
    assert {(r.id, r.s, r.form) for r in one_form(df, "s").collect()} == {(1, "a​", "a"), (2, None, None)}

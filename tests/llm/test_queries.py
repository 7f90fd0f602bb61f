import duckdb
import pytest

from quire.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in queries.ORACLE:
        con = duckdb.connect()
        for name_ in ("chunks", "spans", "budgets", "page_texts", "bookmarks", "figures", "documents"):
            con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{FOLDER}/{name_}.parquet'")
        found = con.execute(queries.ORACLE[name])
        assert df.columns == [c[0] for c in found.description]
        assert sorted(rows, key=repr) == sorted(found.fetchall(), key=repr)

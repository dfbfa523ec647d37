"""The SQL oracles over nulls, empty and long texts, ties, repeated rows and an empty table."""

import duckdb
import pytest
from oracle_compare import canonical

from vecsnap.llm.queries import QUERIES, oracle_sql

SQL = oracle_sql()
# Their SQL joins on doc_id.
BY_ID = {"op2_jaccard", "op8_secrets"}


def both(spark, docs, folder, name):
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, cur = QUERIES[name](spark, str(folder)), con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    return canonical(got.collect(), got.columns), canonical(cur.fetchall(), columns)


@pytest.mark.parametrize("name", SQL)
def test_odd_rows(spark, odd, tmp_path, name):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) if name in BY_ID else odd
    got, want = both(spark, docs, tmp_path, name)
    assert got == want


@pytest.mark.parametrize("name", SQL)
def test_no_rows(spark, empty, tmp_path, name):
    assert both(spark, empty, tmp_path, name) == ([], [])

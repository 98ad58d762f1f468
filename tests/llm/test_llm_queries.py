"""Every registered corpus query runs over whole tables; those with SQL match it."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallyfold.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_the_entry_lists_them():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q[: q.index("_") + 1] for q in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(res.fetchall())


@pytest.mark.parametrize("name", ["op1_token_files", "op3_toxicity", "op7_byte_bpe", "op10_quality"])
def test_one_row_per_document(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())

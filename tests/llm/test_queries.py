"""The registered corpus queries on the smallest tables: against their SQL, or one row per document."""

import duckdb
import pytest

from check import TABLES, rows_of
from strandloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PER_DOCUMENT = ["op5_spotsigs", "op6_language", "op8_mixing", "op9_simhash", "op10_toxicity"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, result.fetchall())


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, name):
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()) == want

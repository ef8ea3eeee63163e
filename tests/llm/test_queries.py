"""The registered queries: against their SQL where they have one, else for their columns and rows."""

import sys
from pathlib import Path

import duckdb
import pytest
from sentispark.llm import queries

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracles import TABLES, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = db.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_pipeline_stages_follow_one_another(spark):
    """Every stage works on what the one before kept; the operators have brute-force tests of their own."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).persist()
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        assert now and now <= kept
        kept = now
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    final = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    import hashlib

    assert {r["doc_id"]: r["decoded_sha256"] for r in final} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}

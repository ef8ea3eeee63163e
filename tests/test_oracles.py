"""Every registered query against its SQL on the smallest data folder."""

import sys
from pathlib import Path

import duckdb
import pytest
from fixture_values import FOLDER

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_oracles import TABLES, rows_of  # noqa: E402

from sentispark.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)

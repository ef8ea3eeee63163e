import pytest
from fixture_values import seconds
from pyspark.sql import functions as F

from sentispark.session import fresh_dir
from sentispark.sources import store

SCHEMA = "id string, job_id string, source_url string, published_at timestamp_ntz, collected_at timestamp_ntz, text_content string"
DAY = 86_400


def rows(spark, spec):
    """Rows from (id, job, url, day)."""
    return spark.createDataFrame(
        [(i, j, u, seconds(d * DAY), seconds(d * DAY), "t") for i, j, u, d in spec], SCHEMA
    )


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_insert_if_absent_is_idempotent_and_null_urls_never_conflict(spark):
    path = fresh_dir(spark, "rows")
    batch = rows(spark, [("1", "a", "u", 0), ("2", "a", "u", 0), ("3", "a", None, 0), ("4", "a", None, 0), ("5", "b", "u", 0)])
    assert ids(store.insert_if_absent(batch, path)) == ["1", "3", "4", "5"]
    again = batch.filter("source_url is not null")
    assert store.insert_if_absent(again, path).count() == 0
    late = rows(spark, [("6", "a", "u", -400), ("7", "a", "u", 0)])
    assert ids(store.insert_if_absent(late, path)) == ["6"]
    assert ids(store.scan_rows(spark, path)) == ["1", "3", "4", "5", "6"]
    assert ids(store.scan_rows(spark, path, "b")) == ["5"]


def test_append_fails_as_a_whole_on_a_duplicate(spark):
    path = fresh_dir(spark, "rows")
    assert store.append_rows(rows(spark, []), path) == 0
    assert store.append_rows(rows(spark, [("1", "a", "u", 0), ("2", "a", None, 0)]), path) == 2
    with pytest.raises(ValueError):
        store.append_rows(rows(spark, [("3", "a", "v", 0), ("4", "a", "u", 0)]), path)
    with pytest.raises(ValueError):
        store.append_rows(rows(spark, [("5", "a", "w", 0), ("6", "a", "w", 0)]), path)
    assert store.scan_rows(spark, path).count() == 2


def test_chunks_are_epoch_aligned(spark):
    df = spark.createDataFrame([("2026-01-25",), ("2026-01-22",), ("1969-12-31",)], "d string")
    got = df.select(store.chunk_start(F.col("d").cast("timestamp_ntz")).cast("string").alias("c")).collect()
    assert [r["c"] for r in got] == ["2026-01-22", "2026-01-22", "1969-12-25"]


def test_delete_rewrites_touched_chunks_only(spark):
    path = fresh_dir(spark, "rows")
    store.write_rows(rows(spark, [("1", "a", "u", 0), ("2", "b", "u", 0), ("3", "a", "u", 30), ("4", "b", "u", 60)]), path)
    doomed = spark.createDataFrame([("a",), ("none",)], "job_id string")
    assert {r["job_id"]: r["deleted"] for r in store.deleted_counts(store.scan_rows(spark, path), doomed).collect()} == {
        "a": 2,
        "none": 0,
    }
    assert store.delete_jobs(spark, path, doomed) == 2
    assert ids(store.scan_rows(spark, path)) == ["2", "4"]
    assert store.delete_jobs(spark, path, doomed) == 0


def test_retention_drops_whole_chunks(spark):
    path = fresh_dir(spark, "rows")
    store.write_rows(rows(spark, [("1", "a", "u", 0), ("2", "a", "u", 8), ("3", "a", "u", 100)]), path)
    as_of = F.lit("2024-04-05").cast("timestamp_ntz")  # cut-off 2024-01-06, inside a chunk
    assert ids(store.within_retention(store.scan_rows(spark, path), as_of)) == ["2", "3"]
    assert ids(store.apply_retention(store.scan_rows(spark, path), as_of)) == ["2", "3"]
    assert [str(c) for c in store.drop_expired(spark, path, as_of)] == ["2023-12-28"]
    assert ids(store.scan_rows(spark, path)) == ["2", "3"]

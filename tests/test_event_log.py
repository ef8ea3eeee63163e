"""The event log as a source: replay after a cursor, streams that go on from their offset."""

import json

import pytest
from pyspark.sql import functions as F

from sentispark.session import fresh_dir
from sentispark.sources import event_log
from sentispark.streaming.sinks import batch_folder, read_batches, start

BASE = 1_704_067_200_000_000  # 2024-01-01
HOURS = 6


def lines(spark, times):
    return spark.createDataFrame([(json.dumps({"did": f"d{t}", "time_us": t, "kind": "identity"}),) for t in times], "value string")


def at(hour, k=0):
    return BASE + hour * event_log.HOUR_US + k


@pytest.fixture
def log(spark):
    event_log.register(spark)
    path = fresh_dir(spark, "log")
    event_log.write_log(lines(spark, [at(h, k) for h in range(HOURS) for k in range(4)]).union(spark.createDataFrame([("{broken",)], "value string")), path)
    return path


def times(df):
    return sorted(r["time_us"] for r in df.collect())


def replay(spark, path, cursor=None):
    reader = spark.read.format("event_log").option("path", path)
    return (reader if cursor is None else reader.option("cursor", cursor)).load()


@pytest.mark.parametrize("cursor", [None, at(0, 1), at(2, 3), at(3) - 1, at(5, 3), at(9)])
def test_replay_after_a_cursor(spark, log, cursor):
    want = [t for t in sorted(at(h, k) for h in range(HOURS) for k in range(4)) if cursor is None or t > cursor]
    assert times(replay(spark, log, cursor)) == want
    assert times(event_log.read_log(spark, log, cursor)) == want


def test_replay_opens_only_later_hours(spark, log):
    found = event_log._partitions(log, at(4, 1), at(5, 3))
    assert [[f.rpartition("=")[2] for f in p.folders] for p in found] == [[str(at(h) // event_log.HOUR_US)] for h in (4, 5)]
    assert {f.rpartition("hour=")[2].partition("/")[0] for f in event_log.read_log(spark, log, at(4, 1)).inputFiles()} == {str(at(h) // event_log.HOUR_US) for h in (4, 5)}


def test_a_restarted_stream_yields_the_rows_after_its_offset(spark, log):
    out, ckpt = fresh_dir(spark, "out"), fresh_dir(spark, "ckpt")

    def go():
        stream = spark.readStream.format("event_log").option("path", log).option("cursor", at(1, 2)).load()
        query = start(stream, batch_folder(out), ckpt)
        query.awaitTermination()
        assert query.exception() is None

    go()
    first = [t for t in sorted(at(h, k) for h in range(HOURS) for k in range(4)) if t > at(1, 2)]
    assert times(read_batches(spark, out)) == first
    go()  # nothing new
    assert times(read_batches(spark, out)) == first
    # Events of two more hours, some in the hour that was read last, and one that comes too late.
    more = [at(5, 9), at(6), at(7)]
    event_log.write_log(lines(spark, [*more, at(0, 50)]), log)
    go()
    assert times(read_batches(spark, out)) == first + more
    # Another stream, from the offset of the first.
    other = fresh_dir(spark, "other")
    stream = spark.readStream.format("event_log").option("path", log).option("cursor", at(5, 3)).load()
    start(stream, batch_folder(other), fresh_dir(spark, "ckpt")).awaitTermination()
    assert times(read_batches(spark, other)) == more


def test_an_empty_log(spark):
    event_log.register(spark)
    path = fresh_dir(spark, "log")
    event_log.write_log(lines(spark, [5]).limit(0), path)
    assert replay(spark, path).count() == 0 and event_log.read_log(spark, path, 7).count() == 0
    with pytest.raises(ValueError):
        event_log.read_log(spark, fresh_dir(spark, "none"))


def test_values_are_the_lines(spark, log):
    row = replay(spark, log, at(5, 2)).select(F.get_json_object("value", "$.time_us").alias("t"), "time_us").first()
    assert int(row["t"]) == row["time_us"] == at(5, 3)

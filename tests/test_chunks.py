"""Chunked tables: all-or-nothing changes, key filters, compaction."""

import random

import pytest
from fixture_values import seconds
from pyspark.sql import functions as F

from sentispark.session import fresh_dir
from sentispark.sources import chunks, store
from sentispark.streaming import live
from sentispark.streaming.sinks import batch_folder, keep_state, latest_state, read_batches

SCHEMA = "id string, job_id string, source_url string, published_at timestamp_ntz, collected_at timestamp_ntz, text_content string"
DAY = 86_400
WEEKS = 20


def rows(spark, spec):
    """Rows from (id, job, url, day)."""
    return spark.createDataFrame([(i, j, u, seconds(d * DAY), seconds(d * DAY), "t") for i, j, u, d in spec], SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def files_of(spark, path):
    return sum(e.files for e in chunks.manifest_of(spark, path).entries)


@pytest.fixture
def stored(spark):
    """Twenty chunks, one row each of two jobs."""
    path = fresh_dir(spark, "rows")
    store.write_rows(rows(spark, [(f"{j}{w}", j, f"u{w}", 7 * w) for w in range(WEEKS) for j in "ab"]), path)
    return path


def test_a_deletion_over_many_chunks_is_seen_whole_or_not_at_all(spark, stored, monkeypatch):
    doomed = spark.createDataFrame([("a",)], "job_id string")
    before = ids(store.scan_rows(spark, stored))
    open_reader = store.scan_rows(spark, stored)

    def crash(*args):
        raise OSError("gone")

    with monkeypatch.context() as m:
        # All chunks are rewritten by then, but nothing names them yet.
        m.setattr(chunks.Files, "publish", crash)
        with pytest.raises(OSError):
            store.delete_jobs(spark, stored, doomed)
    assert ids(store.scan_rows(spark, stored)) == before
    assert store.delete_jobs(spark, stored, doomed) == WEEKS
    assert ids(store.scan_rows(spark, stored)) == sorted(f"b{w}" for w in range(WEEKS))
    assert ids(open_reader) == before  # what a reader has open stays for one more change
    assert store.delete_jobs(spark, stored, doomed) == 0


def test_a_crash_between_two_chunks_leaves_the_table_as_it_was(spark, stored, monkeypatch):
    before = ids(store.scan_rows(spark, stored))
    # Half the chunks of a write are there, of a writer that then died.
    half = rows(spark, [("x", "c", "u", 0)]).withColumn("chunk_start", store.chunk_start())
    half.write.partitionBy("chunk_start").parquet(f"{stored}/write=999")
    assert ids(store.scan_rows(spark, stored)) == before
    store.write_rows(rows(spark, [("y", "c", "u", 70)]), stored)
    assert ids(store.scan_rows(spark, stored)) == sorted([*before, "y"])


def test_two_writers_do_not_overwrite_one_another(spark, stored):
    now = chunks.manifest_of(spark, stored)
    chunks.swap(spark, stored, store.LAYOUT, now, now.entries[:1], None)
    with pytest.raises(RuntimeError):
        chunks.swap(spark, stored, store.LAYOUT, now, now.entries[1:2], store.with_chunk(rows(spark, [("x", "c", "u", 0)])))
    assert store.scan_rows(spark, stored).count() == 2 * WEEKS - 2
    store.write_rows(rows(spark, [("y", "c", "u", 0)]), stored)
    assert store.scan_rows(spark, stored).count() == 2 * WEEKS - 1


def test_old_folders_and_manifests_go(spark, stored):
    for j in "ab":
        store.delete_jobs(spark, stored, spark.createDataFrame([(j,)], "job_id string"))
    store.write_rows(rows(spark, [("z", "c", "u", 0)]), stored)
    files = chunks.Files(spark, stored)
    assert len(files.names("_manifest")) <= 4
    # Of the two manifests left only the newer names a write: all else was deleted.
    named = {f"write={e.write}" for e in chunks.manifest_of(spark, stored).entries}
    assert {n for n in files.names("") if n.startswith("write=")} == named == {n for n in files.names("_filter") if n.startswith("write=")}
    assert ids(store.scan_rows(spark, stored)) == ["z"]


def test_an_insert_reads_only_chunks_it_touches(spark, stored, monkeypatch):
    read = []
    original = chunks.read_entries
    monkeypatch.setattr(chunks, "read_entries", lambda s, p, n, e=None: read.append(list(n.entries if e is None else e)) or original(s, p, n, e))
    first, last = 0, 7 * (WEEKS - 1)
    batch = rows(spark, [("n1", "new", "fresh", first), ("n2", "new", "fresh", last)])
    now = chunks.manifest_of(spark, stored)
    assert chunks.known_keys(store.with_chunk(batch), stored, store.LAYOUT) is None and read == []
    # A stored key among them: one folder is read, not the twenty between first and last.
    batch = rows(spark, [("n1", "new", "fresh", first), ("n3", "a", f"u{WEEKS - 1}", last)])
    known = chunks.known_keys(store.with_chunk(batch), stored, store.LAYOUT)
    assert [len(e) for e in read] == [1] and read[0][0].chunk == max(e.chunk for e in now.entries)
    assert [(r["job_id"], r["source_url"]) for r in known.collect()] == [("a", f"u{WEEKS - 1}")]


def test_filters_have_no_false_negatives_and_few_false_positives(spark):
    path = fresh_dir(spark, "ids")
    layout = chunks.Layout("bucket", ("id",), ("id",))
    bucketed = lambda df: df.withColumn("bucket", F.pmod("id", F.lit(4)).cast("int"))
    chunks.append(bucketed(spark.range(0, 20_000)), path, layout)
    now = chunks.manifest_of(spark, path)
    wanted, entries = chunks.holders(bucketed(spark.range(0, 40_000)), path, layout, now)
    assert len(entries) == 4 and wanted.filter("id < 20000").count() == 20_000
    assert wanted.filter("id >= 20000").count() < 0.02 * 20_000
    known = chunks.known_keys(bucketed(spark.range(19_990, 20_010)), path, layout)
    assert sorted(r["id"] for r in known.collect()) == list(range(19_990, 20_000))


def test_rows_without_a_whole_key_are_never_known(spark):
    path = fresh_dir(spark, "rows")
    batch = rows(spark, [("1", "a", None, 0), ("2", None, "u", 0), ("3", "a", "u", 0)]).unionByName(
        spark.createDataFrame([("4", "a", "u", None, seconds(0), "t")], SCHEMA)
    )
    for _ in range(2):
        store.insert_if_absent(batch, path)
    assert ids(store.scan_rows(spark, path)) == ["1", "1", "2", "2", "3", "4", "4"]
    store.delete_jobs(spark, path, spark.createDataFrame([("a",)], "job_id string"))
    assert ids(store.scan_rows(spark, path)) == ["2", "2"]


def test_many_small_inserts_leave_few_files(spark):
    path = fresh_dir(spark, "rows")
    for b in range(8):
        store.store_absent(rows(spark, [(f"{b}-{k}", f"j{k % 3}", f"u{b}", 7 * (k % 4)) for k in range(12)]), path)
    before = ids(store.scan_rows(spark, path))
    assert files_of(spark, path) >= 32
    assert store.compact_rows(spark, path) >= 32
    assert ids(store.scan_rows(spark, path)) == before and files_of(spark, path) <= 2 * 4
    assert store.compact_rows(spark, path, least=9) == 0
    # Order and key filters are there after the merge as well.
    now = chunks.manifest_of(spark, path)
    for e in now.entries:
        kept = [r["job_id"] for r in spark.read.parquet(f"{path}/{now.folder(e)}").collect()]
        assert e.files > 1 or kept == sorted(kept)
    store.store_absent(rows(spark, [("again", "j0", "u3", 0), ("new", "j0", "u99", 0)]), path)
    assert ids(store.scan_rows(spark, path)) == sorted([*before, "new"])


def test_full_files_are_left_alone(spark, stored):
    assert store.compact_rows(spark, stored, target=1) == 0


def test_state_is_merged_to_the_newest_row_per_key(spark):
    path = fresh_dir(spark, "state")
    write = keep_state(path, ["k"], merge_every=3)
    for b in range(8):
        write(spark.createDataFrame([("hot", b), (f"k{b}", b)], "k string, v long"), b)
        write(spark.createDataFrame([("hot", b), (f"k{b}", b)], "k string, v long"), b)  # runs again
    want = {f"k{b}": b for b in range(8)} | {"hot": 7}
    assert {r["k"]: r["v"] for r in latest_state(spark, path, ["k"]).collect()} == want
    assert {r["k"]: r["v"] for r in latest_state(spark, path, ["k"], before=7).collect()} == {f"k{b}": b for b in range(7)} | {"hot": 6}
    assert sum(r.rows or 1 for r in chunks.manifest_of(spark, path).entries) < 16
    with pytest.raises(ValueError):
        write(spark.createDataFrame([("hot", 0)], "k string, v long"), 0)


def test_batches_are_packed_and_replaced(spark):
    path = fresh_dir(spark, "batches")
    write = batch_folder(path, merge_every=4)
    for b in range(10):
        write(spark.createDataFrame([(b,)], "v long"), b)
    write(spark.createDataFrame([(90,)], "v long"), 9)
    assert sorted((r["batch_id"], r["v"]) for r in read_batches(spark, path).collect()) == [(b, b) for b in range(9)] + [(9, 90)]
    assert len(chunks.manifest_of(spark, path).entries) <= 5


def test_dedupe_by_id_reads_filters_not_keys(spark, monkeypatch):
    src, out, ckpt = (fresh_dir(spark, n) for n in ("src", "out", "ckpt"))
    schema = "id string, job_id string, received_at timestamp"
    read = []
    original = chunks.read_entries

    def go(*part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = live.run_dedupe(spark.readStream.schema(schema).parquet(src), out, ckpt, ("id",), ("received_at", "job_id"), None, merge_every=3)
        q.awaitTermination()
        assert q.exception() is None

    go(*[(str(k), "j", seconds(k)) for k in range(50)])
    with monkeypatch.context() as m:
        m.setattr(chunks, "read_entries", lambda s, p, n, e=None: read.append(e) or original(s, p, n, e))
        go(("1000", "j", seconds(60)), ("1001", "j", seconds(60)))
    # Only what the filter of the new write is made from.
    assert all(e and e[0].batch == 1 for e in read)
    for k in range(4):
        go(("7", "j", seconds(70 + k)), (f"n{k}", "j", seconds(70)))
    got = sorted(r["id"] for r in read_batches(spark, out).collect())
    assert got == sorted([str(k) for k in range(50)] + ["1000", "1001"] + [f"n{k}" for k in range(4)])


def test_a_text_of_many_jobs_is_kept_once_in_a_file(spark):
    """Rows lie by job, so the copies of a text are far from each other; its file grows with the texts, not with the jobs."""
    rng = random.Random(8)
    spec = [(f"{k}", f"u{k}", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=5000))) for k in range(400)]
    posts = spark.createDataFrame(spec, "id string, source_url string, text_content string").coalesce(1)
    jobs = spark.range(40).select(F.col("id").cast("string").alias("job_id"))
    path = fresh_dir(spark, "rows")
    when = F.lit(seconds(DAY)).cast("timestamp_ntz")
    store.write_rows(posts.crossJoin(F.broadcast(jobs)).withColumns({"published_at": when, "raw_content": F.col("text_content")}), path)
    assert store.scan_rows(spark, path).agg(F.sum(F.length("text_content"))).first()[0] == 40 * 400 * 5000
    # Two columns of 2 MB of texts.
    assert sum(e.size for e in chunks.manifest_of(spark, path).entries) < 3 * 2 * 2_000_000


def test_the_filter_of_the_store_holds_an_address_once_for_all_jobs(spark):
    path = fresh_dir(spark, "rows")
    store.write_rows(rows(spark, [(f"{k}", f"j{k}", f"u{k % 2}", 0) for k in range(40)]), path)
    assert [e.rows for e in chunks.manifest_of(spark, path).entries] == [2]
    batch = rows(spark, [("a", "j0", "u0", 0), ("b", "j1", "u0", 0), ("c", "new", "u1", 0), ("d", "j0", "u9", 0), ("e", "j0", "u0", 9)])
    known = chunks.known_keys(store.with_chunk(batch), path, store.LAYOUT)
    assert [(r["job_id"], r["source_url"]) for r in known.collect()] == [("j0", "u0")]
    assert ids(store.insert_if_absent(batch, path)) == ["b", "c", "d", "e"]


def test_jobs_stored_for_an_address(spark, monkeypatch):
    path = fresh_dir(spark, "rows")
    given = [("1", "a", "u", 0), ("2", "b", "u", 0), ("3", "b", "u", 9), ("4", "c", "v", 0), ("5", "d", None, 0), ("6", None, "u", 0)]
    addresses = rows(spark, [("x", "-", "u", 0), ("y", "-", "u", 0), ("z", "-", None, 0), ("w", "-", "new", 0)])
    assert store.stored_jobs(addresses, path) is None
    store.write_rows(rows(spark, given), path)

    def found():
        return [(r["source_url"], sorted(r["known"])) for r in store.stored_jobs(addresses, path).collect()]

    assert found() == [("u", ["a", "b"])]
    monkeypatch.setattr(chunks, "fits_broadcast", lambda df: False)
    assert found() == [("u", ["a", "b"])]


def test_folders_with_filters_of_whole_keys_are_found_by_address(spark):
    path = fresh_dir(spark, "rows")
    older = chunks.Layout("chunk_start", ("job_id", "published_at"), store.LAYOUT.keys)
    chunks.append(store.with_chunk(rows(spark, [("1", "a", "u", 0), ("2", "a", "v", 7)])), path, older)
    store.write_rows(rows(spark, [("3", "b", "u", 0)]), path)
    again = rows(spark, [("4", "a", "u", 0), ("5", "b", "u", 0), ("6", "a", "v", 7), ("7", "b", "v", 7)])
    assert ids(store.insert_if_absent(again, path)) == ["7"]

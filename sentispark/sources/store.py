"""Stored scored rows: a chunked table (``chunks``) with a chunk per 7 days of ``published_at``.

Rows lie sorted by job and time inside a chunk, with a bloom filter on the job, also after deletions and compaction, so
readers of one job pass over the row groups of others. Read with ``scan_rows``, which follows the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.scale import fits_broadcast, join_per_key, keep_first
from sentispark.session import materialize
from sentispark.sources import chunks

CHUNK_DAYS = 7
RETENTION_DAYS = 90
_KEY = ("job_id", "source_url", "published_at")
#: What the rows of the jobs that matched a post agree in, beside its text.
_ADDRESS = ("source_url", "published_at")
LAYOUT = chunks.Layout("chunk_start", ("job_id", "published_at"), _KEY, ("job_id",), repeats=True, probe=_ADDRESS)


def chunk_start(published_at: Column | str = "published_at") -> Column:
    """First day of the epoch-aligned 7-day chunk."""
    ts = F.col(published_at) if isinstance(published_at, str) else published_at
    days = F.unix_date(ts.cast("date"))
    return F.date_from_unix_date((F.floor(days / F.lit(CHUNK_DAYS)) * CHUNK_DAYS).cast("int"))


def with_chunk(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk_start", chunk_start())


def id_address() -> Column:
    """What the ids of all rows of a post have in common before its text."""
    return F.concat_ws("\u0001", F.coalesce(F.col("source_url"), F.lit("")), F.col("published_at").cast("string"))


def row_id(address: Column | None = None) -> Column:
    """Id that stays the same when a task or a batch runs again; ``address`` is a ready ``id_address``, if there is one."""
    address = id_address() if address is None else address
    return F.sha2(F.concat_ws("\u0001", F.col("job_id"), address, F.col("text_content")), 256)


def scan_rows(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """Stored rows, of one job if named; a table that was never written is an error."""
    rows = chunks.read_table(spark, path)
    if rows is None:
        raise ValueError(f"no rows are stored at {path}")
    return rows if job_id is None else rows.filter(F.col("job_id") == job_id)


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Keys that occur more than once. Null addresses never equal one another."""
    return (
        rows.filter(F.col("source_url").isNotNull())
        .groupBy(*_KEY)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def write_rows(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Add rows, chunk by chunk. A micro-batch that names itself replaces what it has written before.

    Every task sorts by chunk, job and time and keeps one file open; a chunk holding most rows
    stays spread over all tasks, as no shuffle brings a chunk together. Rows that have their chunk may come sorted already.
    """
    chunks.append(rows if "chunk_start" in rows.columns else with_chunk(rows), path, LAYOUT, batch)


def append_rows(rows: DataFrame, path: str) -> int:
    """Append a batch as a whole; a duplicate key inside it, or in the store, fails all of it."""
    spark = rows.sparkSession
    batch = materialize(rows)
    size = batch.count()
    if size == 0:
        return 0
    if not duplicate_keys(batch).isEmpty():
        raise ValueError("duplicate key within the batch")
    known = chunks.known_keys(with_chunk(batch), path, LAYOUT)
    if known is not None and not known.isEmpty():
        raise ValueError("duplicate key: row already stored")
    write_rows(batch, path)
    return size


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored rows, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def first_arrivals(batch: DataFrame, arrival: list[Column]) -> DataFrame:
    """First row per key of a batch; a row without address never conflicts."""
    no_url = F.when(F.col("source_url").isNull(), F.struct(*arrival))
    return keep_first(batch, [*[F.col(k) for k in _KEY], no_url], arrival)


def absent_rows(batch: DataFrame, stored: DataFrame | None, arrival: list[Column]) -> DataFrame:
    """Rows of ``batch`` an insert-if-absent would store: first arrivals not stored yet."""
    return not_stored(first_arrivals(batch, arrival), stored)


def not_stored(rows: DataFrame, stored: DataFrame | None, keys: tuple[str, ...] = _KEY) -> DataFrame:
    if stored is None:
        return rows
    known = stored.select(*keys)
    wanted = rows.select(*keys)
    if fits_broadcast(wanted):
        # A small batch goes to the store's tasks, so the store is not shuffled.
        known = known.join(F.broadcast(wanted), list(keys), "left_semi")
    # Null keys are unequal to everything in an anti join, which is the wanted meaning.
    return rows.join(known, list(keys), "left_anti").select(*rows.columns)


def stored_jobs(addresses: DataFrame, path: str) -> DataFrame | None:
    """The addresses (``source_url``, ``published_at``) among those given that are stored, a row each with the jobs they are
    stored for, as ``known``; None if there are none. An address is looked up once for all jobs."""
    near = chunks.near_keys(with_chunk(addresses.select(*_ADDRESS)), path, LAYOUT)
    if near is None:
        return None
    stored, wanted, small = near
    if small:
        stored = stored.join(wanted, list(_ADDRESS), "left_semi")
    # By time first: the addresses begin alike.
    known = stored.groupBy("published_at", "source_url").agg(F.collect_set("job_id").alias("known"))
    # Many addresses are met when the tasks that read the store have put together the jobs of each.
    return known if small else known.join(wanted, list(_ADDRESS), "left_semi")


def _new_rows(rows: DataFrame, path: str) -> DataFrame:
    """Rows whose key is not stored. Chunks the rows do not touch are not looked at, nor folders whose filter has none of their keys."""
    known = chunks.known_keys(with_chunk(rows), path, LAYOUT, exact=False)
    return rows if known is None else rows.join(known, list(_KEY), "left_anti").select(*rows.columns)


def insert_if_absent(batch: DataFrame, path: str, arrival: list[Column] | None = None) -> DataFrame:
    """Store the rows whose (job, address, time) is new and return them.

    Written once before appending, so the returned rows do not change when read again; running
    the same batch twice stores nothing more.
    """
    order = arrival or [F.col("collected_at"), F.col("id")]
    # Written before they are looked up, as the chunks, the keys and the rows are read from it.
    inserted = materialize(_new_rows(materialize(first_arrivals(batch, order)), path))
    if not inserted.isEmpty():
        write_rows(inserted, path)
    return inserted


def store_absent(rows: DataFrame, path: str) -> None:
    """``insert_if_absent`` for rows whose keys are known to differ, without returning them."""
    # Written once, as the chunks, the keys and the rows are read from it: a model runs once a row.
    write_rows(_new_rows(materialize(rows), path), path)


def mark_copies(rows: DataFrame, path: str, arrival: list[str], before: int | None = None) -> DataFrame:
    """Add ``is_duplicate``: a row of the same key came earlier in ``rows`` or is stored (by a micro-batch before ``before``).

    ``arrival`` is total. The first row per key is found by an aggregate and met on key and arrival together, so copies
    that make up a third of the rows meet nothing and no key is gathered. A row with a null in its key is no copy.
    """
    whole = F.greatest(*[F.col(k).isNull() for k in _KEY], F.lit(False)) == F.lit(False)
    keyed = rows.withColumns({"_key": F.struct(*_KEY), "_arrival": F.struct(*arrival)})
    firsts = materialize(keyed.filter(whole).groupBy("_key").agg(F.min("_arrival").alias("_arrival")))
    known = chunks.known_keys(with_chunk(firsts.select("_key.*")), path, LAYOUT, before, exact=False)
    if known is not None:
        firsts = materialize(firsts.join(known.select(F.struct(*_KEY).alias("_key")), "_key", "left_anti"))
    new = firsts.withColumn("_new", F.lit(True))
    if fits_broadcast(firsts):
        new = F.broadcast(new)
    return keyed.join(new, ["_key", "_arrival"], "left").select(*rows.columns, (whole & F.col("_new").isNull()).alias("is_duplicate"))


def without_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows left after deleting ``jobs`` (and, by cascade, their rows)."""
    return join_per_key(rows, jobs.select("job_id").distinct(), "job_id", "left_anti")


def deleted_counts(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Number of rows each deletion removes, 0 where there are none."""
    counts = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        jobs.select("job_id")
        .distinct()
        .join(counts, "job_id", "left")
        .select("job_id", F.coalesce("_n", F.lit(0)).alias("deleted"))
    )


def delete_jobs(spark: SparkSession, path: str, jobs: DataFrame) -> int:
    """Delete the rows of ``jobs``; returns how many there were.

    Only folders that hold any are rewritten, in the same order and with the same filters; readers see the deletion in
    all chunks or in none.
    """
    now = chunks.manifest_of(spark, path)
    if now is None:
        return 0
    doomed = materialize(jobs.select("job_id").distinct())
    hit = join_per_key(chunks.with_write(spark, path, now), doomed, "job_id", "left_semi")
    # A row per folder of the manifest, which is on the driver anyway.
    found = hit.groupBy("write", F.col("chunk_start").cast("string").alias("chunk")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["write"], r["chunk"] or chunks.NULL_CHUNK): r["n"] for r in found}
    if not counts:
        return 0
    touched = [e for e in now.entries if (e.write, e.chunk) in counts]
    kept = join_per_key(chunks.read_entries(spark, path, now, touched), doomed, "job_id", "left_anti")
    chunks.swap(spark, path, LAYOUT, now, touched, kept)
    return sum(counts.values())


def compact_rows(spark: SparkSession, path: str, target: int = chunks.TARGET_BYTES, least: int = 2) -> int:
    """Pack the small files that many inserts leave in a chunk into sorted ones; returns the number of folders replaced."""
    return chunks.compact(spark, path, LAYOUT, target, least)


def expired(as_of: Column, days: int = RETENTION_DAYS) -> Column:
    """Whether a whole chunk lies before the cut-off; chunks go as a unit."""
    cutoff = as_of.cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    end = F.date_add(F.col("chunk_start"), CHUNK_DAYS).cast("timestamp_ntz")
    return end <= cutoff


def apply_retention(rows: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows left once the expired chunks are gone (prunes folders on a stored table)."""
    out = rows if "chunk_start" in rows.columns else with_chunk(rows)
    return out.filter(~expired(as_of, days))


def within_retention(rows: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Row-exact variant."""
    cutoff = as_of.cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return rows.filter(F.col("published_at").cast("timestamp_ntz") >= cutoff)


def drop_expired(spark: SparkSession, path: str, as_of: Column, days: int = RETENTION_DAYS) -> list:
    """Take the expired chunks out of a stored table, without reading or writing a row; returns their first days."""
    now = chunks.manifest_of(spark, path)
    if now is None:
        return []
    days_stored = spark.createDataFrame([(e.chunk,) for e in now.entries if e.chunk != chunks.NULL_CHUNK], "chunk string")
    over = days_stored.distinct().withColumn("chunk_start", F.col("chunk").cast("date")).filter(expired(as_of, days))
    gone = {r["chunk"]: r["chunk_start"] for r in over.collect()}
    if gone:
        chunks.swap(spark, path, LAYOUT, now, [e for e in now.entries if e.chunk in gone], None)
    return sorted(gone.values())

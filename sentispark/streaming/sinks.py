"""Stream sinks that may run a batch again without changing the outcome.

What batches write is a chunked table (``sources.chunks``): a batch's rows appear at once, a repeated batch replaces its
rows, and every ``MERGE_EVERY`` batches the small files of earlier ones are packed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentispark.sources import chunks

MERGE_EVERY = 16
BUCKETS = 16
_OUTPUT = chunks.Layout("chunk", ("batch_id",))
#: State is dealt by its keys, so that merging reads and writes all versions of a key at one place.
_STATE = chunks.Layout("bucket", ("batch_id",))


def start(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Run ``write`` per batch: continuously every ``every``, else over what is there now."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def batch_folder(path: str, merge_every: int = MERGE_EVERY) -> Callable[[DataFrame, int], None]:
    """Write every batch with its ``batch_id``; a repeated batch replaces what it wrote. ``chunk`` and ``write`` are no column names here."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"batch_id": F.lit(batch_id).cast("long"), "chunk": F.lit(0)})
        chunks.append(rows, path, _OUTPUT, batch_id)
        if (batch_id + 1) % merge_every == 0:
            chunks.compact(batch.sparkSession, path, _OUTPUT)

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that batches have written, with their ``batch_id``."""
    now = chunks.manifest_of(spark, path)
    if now is None:
        raise ValueError(f"no batch has been written to {path}")
    return chunks.read_entries(spark, path, now).drop(now.chunk)


def _newest(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(*rows.columns), "batch_id").alias("_row")
        return rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(newest).select("_row.*")

    return merge


def keep_state(
    path: str, keys: Sequence[str], merge_every: int = MERGE_EVERY, wanted: Column | None = None
) -> Callable[[DataFrame, int], None]:
    """Store the changed rows of an update-mode stream, one per key and batch; read with ``latest_state``.

    Every ``merge_every`` batches the versions of a key are reduced to the newest, so a read goes over the state
    and a few batches, not over all that was ever written. Keys whose newest row is not ``wanted`` (finished, or too old) are
    dropped then, so the state is bounded by what is still wanted.
    """

    def merge(rows: DataFrame) -> DataFrame:
        newest = _newest(keys)(rows)
        return newest if wanted is None else newest.filter(wanted)

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        rows = batch.withColumns({"batch_id": F.lit(batch_id).cast("long"), "bucket": bucket})
        chunks.append(rows, path, _STATE, batch_id)
        if (batch_id + 1) % merge_every == 0:
            # Rows become unwanted with time, so a chunk may shrink though nothing has been added to it.
            chunks.compact(batch.sparkSession, path, _STATE, least=2 if wanted is None else 1, merge=merge)

    return write


def latest_state(spark: SparkSession, path: str, keys: Sequence[str], before: int | None = None) -> DataFrame | None:
    """Newest row per key of what ``keep_state`` stored; None before the first batch. ``before`` leaves out that and later batches."""
    now = chunks.manifest_of(spark, path)
    if now is None:
        return None
    entries = [e for e in now.entries if before is None or e.batch is None or e.batch < before]
    rows = chunks.read_entries(spark, path, now, entries)
    return _newest(keys)(rows).drop("batch_id", "bucket")


def per_row(handle: Callable[[DataFrame], DataFrame], out: Callable[[DataFrame, int], None]) -> Callable:
    """A ``foreachBatch`` callback: ``handle`` maps the rows of a batch, ``out`` stores them; empty batches are passed over."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            out(handle(batch), batch_id)

    return write

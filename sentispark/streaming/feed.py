"""The numbered update feed of a stream: consecutive numbers per job, each given once.

Numbers continue from a stored count per job. A batch looks at the counts of earlier batches only and replaces what it
wrote itself, so a batch that runs again after a crash gives the same rows the same numbers. Within
a batch rows are numbered over range slices (``scale.number_rows``): a job with a third of all posts is no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.operators.feed import update_messages
from sentispark.scale import join_per_key, number_and_count
from sentispark.session import materialize
from sentispark.sources import store
from sentispark.streaming.sinks import batch_folder, keep_state, latest_state, start


def _numbering(path: str, order: Sequence[str]):
    """Two functions: the rows of a batch with their numbers and the counts after it, and one that stores these counts at the batch's end."""
    record = f"{path}/_counts"

    def number(batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        numbered, here = number_and_count(batch, ["job_id"], list(order), "total_processed")
        before = latest_state(batch.sparkSession, record, ["job_id"], before=batch_id)
        if before is None:
            return numbered, here.withColumnRenamed("total_processed", "processed")
        offsets = materialize(before.select("job_id", F.col("processed").alias("_before")))
        total = F.col("total_processed") + F.coalesce("_before", F.lit(0))
        numbered = join_per_key(numbered, offsets, "job_id", "left").withColumn("total_processed", total).drop("_before")
        return numbered, here.join(offsets, "job_id", "left").select("job_id", total.alias("processed"))

    return number, keep_state(record, ["job_id"])


def feed_writer(path: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the messages of processed rows; ``read_batches`` gives them back.

    The rows have ``is_duplicate``: copies advance their job's count and emit nothing. ``order`` is total within a
    job and a batch; earlier batches come first.
    """
    emit, (number, remember) = batch_folder(path), _numbering(path, order)

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered, total = number(batch, batch_id)
        emit(update_messages(numbered), batch_id)
        remember(total, batch_id)

    return write


def run_update_feed(processed: DataFrame, path: str, checkpoint: str, order: Sequence[str], every: str | None = None):
    """Number a stream of processed rows and write their messages."""
    return start(processed, feed_writer(path, order), checkpoint, every=every)


def run_stored_feed(
    rows: DataFrame, rows_path: str, feed_path: str, checkpoint: str, order: Sequence[str] = ("analyzed_at", "id"), every: str | None = None
):
    """Store the rows whose key is new and write the feed of all: stored rows with their numbers, copies only counted.

    What a batch itself has stored does not make its rows copies when it runs again.
    """
    emit, (number, remember) = batch_folder(feed_path), _numbering(feed_path, order)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Copies count, and that is all they do: past their numbers only new rows are kept.
        numbered, total = number(batch, batch_id)
        new = materialize(store.mark_copies(numbered, rows_path, list(order), before=batch_id).filter(~F.col("is_duplicate")))
        store.write_rows(new.drop("is_duplicate", "total_processed"), rows_path, batch_id)
        emit(update_messages(new), batch_id)
        remember(total, batch_id)

    return start(rows, write, checkpoint, every=every)

"""Job states: lifecycle from events, progress, completion, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.functions.text import message_key
from sentispark.schemas import TERMINAL_STATUSES

COMPLETION_TIMEOUT_MS = 30_000
COMPLETION_RATIO = 0.95
IDLE_TTL_MS = 60 * 60 * 1000
MAX_TTL_MS = 24 * 60 * 60 * 1000
MAX_RETRIES = 3


def fold_events(events: DataFrame) -> DataFrame:
    """What the events of every job amount to; works on a table and on a stream.

    ``initial_batch`` starts a pending job only; ``completed`` and ``failed`` overwrite whatever
    is there. In the order of (ts, seq) the fold thus ends at the last terminal event, or at the
    first start if there is none: a maximum and a minimum, which combine before the shuffle and
    never gather the events of a job.
    """
    kind = F.col("type")
    last = F.struct(
        "ts", "seq", kind.alias("status"), F.col("error_message").alias("error_message")
    )
    return events.groupBy("job_id").agg(
        F.max(F.when(kind.isin(*TERMINAL_STATUSES), last)).alias("last_terminal"),
        F.min(F.when(kind == "initial_batch", F.struct("ts", "seq"))).alias("first_start"),
    )


def apply_lifecycle(jobs: DataFrame, folded: DataFrame) -> DataFrame:
    """Job table after the folded events, with the end time and the error message filled in.

    A job without a terminal event keeps the outcome it has, so folding batch after batch ends
    where folding all events at once does. Batches come in the order of their events.
    """
    last, start = F.col("last_terminal"), F.col("first_start")
    known = {c: F.col(c) if c in jobs.columns else F.lit(None) for c in ("completed_at", "error_message")}
    starts = (F.col("status") == "pending") & start.isNotNull()
    status = (
        F.when(last.isNotNull(), last["status"])
        .when(starts, "in_progress")
        .otherwise(F.col("status"))
    )
    changed = F.when(last.isNotNull(), last["ts"]).when(starts, start["ts"])
    set_here = ("status", "updated_at", "completed_at", "error_message")
    return jobs.join(folded, "job_id", "left").select(
        *[c for c in jobs.columns if c not in set_here],
        status.alias("status"),
        F.coalesce(changed, F.col("updated_at")).alias("updated_at"),
        F.when(last["status"] == "completed", last["ts"])
        .when(last.isNull(), known["completed_at"].cast(folded.schema["last_terminal"].dataType["ts"].dataType))
        .alias("completed_at"),
        F.when(last["status"] == "failed", last["error_message"])
        .when(last.isNull(), known["error_message"].cast("string"))
        .alias("error_message"),
    )


def fold_lifecycle(jobs: DataFrame, events: DataFrame) -> DataFrame:
    return apply_lifecycle(jobs, fold_events(events))


def update_status(jobs: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """Set the status of the listed jobs; unknown ids change nothing.

    Several updates of one job: the latest by ``seq`` counts.
    """
    latest = updates.groupBy("job_id").agg(F.max_by("status", "seq").alias("_status"))
    return jobs.join(latest, "job_id", "left").select(
        *[
            F.coalesce("_status", "status").alias("status")
            if c == "status"
            else F.when(F.col("_status").isNotNull(), at).otherwise(F.col("updated_at")).alias(c)
            if c == "updated_at"
            else c
            for c in jobs.columns
        ]
    )


def updated_jobs(jobs: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """Only the rows the update touched."""
    touched = updates.select("job_id").distinct()
    return update_status(jobs, updates, at).join(touched, "job_id", "left_semi")


def completion_ratio(processed: Column, expected: Column) -> Column:
    return F.when(expected > 0, processed / expected).otherwise(F.lit(1.0))


def completion_decision(
    processed: Column, expected: Column, waited_ms: Column, idle_ms: Column
) -> Column:
    """``complete`` when all is processed; ``fallback`` when enough is and the job went idle.

    ``expected`` is null until ingestion has ended; ``waited_ms`` counts from there. The
    fallback needs a full timeout; until it holds the job is checked again (``wait``).
    """
    ratio = completion_ratio(processed, expected)
    fallback = (
        (waited_ms >= COMPLETION_TIMEOUT_MS)
        & (ratio >= COMPLETION_RATIO)
        & (idle_ms >= COMPLETION_TIMEOUT_MS / 2)
    )
    return (
        F.when(expected.isNull(), "running")
        .when(processed >= expected, "complete")
        .when(fallback, "fallback")
        .otherwise("wait")
    )


def tracker_expired(idle_ms: Column, age_ms: Column, ingestion_complete: Column) -> Column:
    """State that may be dropped: idle before the end of ingestion, or simply too old."""
    return ((idle_ms > IDLE_TTL_MS) & ~ingestion_complete) | (age_ms > MAX_TTL_MS)


def progress(processed: DataFrame, expected: DataFrame) -> DataFrame:
    """Processed against expected items per job."""
    counts = processed.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    done = F.coalesce("_n", F.lit(0))
    return expected.join(counts, "job_id", "left").select(
        "job_id",
        done.alias("processed"),
        "expected",
        completion_ratio(done, F.col("expected")).alias("ratio"),
        F.greatest(F.col("expected") - done, F.lit(0)).alias("missing"),
    )


def route_failures(
    failures: DataFrame, attempts: DataFrame, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """What becomes of failed messages: copies to retry, copies to discard, retries on record.

    ``failures`` has ``content`` and ``permanent``; ``attempts`` the retries so far per content
    key. A message is retried ``max_retries`` times, then discarded and its record cleared, so
    a further copy starts over. Copies of one content are interchangeable, hence counted rather
    than listed: identical messages making up a third of a batch cost one row per task.
    """
    permanent = F.col("permanent")
    counted = (
        failures.groupBy("content")
        .agg(F.count_if(~permanent).alias("_transient"), F.count_if(permanent).alias("_permanent"))
        .withColumn("message_key", message_key("content"))
    )
    known = attempts.select("message_key", F.col("retries").alias("_before"))
    start = F.coalesce("_before", F.lit(0))
    seen = start + F.col("_transient")
    cycle = max_retries + 1
    discarded = F.floor(seen / F.lit(cycle))
    return counted.join(known, "message_key", "left").select(
        "message_key",
        "content",
        (F.col("_transient") - discarded).alias("retried"),
        (discarded + F.col("_permanent")).alias("discarded"),
        F.pmod(seen, F.lit(cycle)).cast("long").alias("retries"),
    )

"""Live results: de-duplication, series, job states, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.functions.numeric import clamp, epoch_ms, score_units
from sentispark.operators.lifecycle import MAX_RETRIES, fold_events, route_failures
from sentispark.operators.series import BUCKET_MS, accumulate
from sentispark.scale import keep_first
from sentispark.session import materialize
from sentispark.sources import chunks, store
from sentispark.streaming.sinks import BUCKETS, MERGE_EVERY, batch_folder, keep_state, latest_state, start

REFRESH = "250 milliseconds"
_BUCKET_KEYS = ["job_id", "bucket_ms"]


def kept_layout(keys: tuple[str, ...], within: str | None) -> chunks.Layout:
    """How the first rows per key lie: by 7-day chunk of a time among the keys, else by bucket of the keys."""
    if within is not None:
        return chunks.Layout("chunk_start", (within,), keys)
    return chunks.Layout("bucket", keys, keys)


def run_dedupe(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    keys: tuple[str, ...] = ("job_id", "source_url", "published_at"),
    order: tuple[str, ...] = ("received_at", "id"),
    within: str | None = "published_at",
    every: str | None = None,
    merge_every: int = MERGE_EVERY,
):
    """Store the first row per key, however late it comes; a row with a null key always counts as new. Read with ``read_batches``.

    Every batch keeps its first arrivals (an aggregate that combines before the shuffle, so copies
    that make up a third of the stream cost a row per task) and drops those of earlier batches. Which of these to look at
    is told by the filters of their keys: a batch of new keys reads filter words of its own chunks and no rows.
    ``within`` names a time among the keys to lay the rows out by; without one (None) they lie in buckets of the keys.
    """
    layout = kept_layout(keys, within)

    def write(batch: DataFrame, batch_id: int) -> None:
        missing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        alone = F.when(missing, F.struct(*order))
        first = keep_first(batch, [*[F.col(k) for k in keys], alone], [F.col(c) for c in order])
        place = store.chunk_start(within) if within is not None else F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        first = materialize(first.withColumns({layout.chunk: place, "batch_id": F.lit(batch_id).cast("long")}))
        known = chunks.known_keys(first, path, layout, before=batch_id)
        fresh = first if known is None else first.join(known, list(keys), "left_anti").select(*first.columns)
        chunks.append(fresh, path, layout, batch_id)
        if (batch_id + 1) % merge_every == 0:
            chunks.compact(batch.sparkSession, path, layout)

    return start(rows, write, checkpoint, every=every)


def live_buckets(rows: DataFrame, bucket_ms: int = BUCKET_MS, at: str = "received_at") -> DataFrame:
    """Score units and count per job and bucket, kept up to date incrementally."""
    bucket = F.floor(epoch_ms(at) / F.lit(bucket_ms)) * F.lit(bucket_ms)
    return rows.groupBy("job_id", bucket.alias("bucket_ms")).agg(
        F.sum(score_units(clamp("sentiment_score"))).alias("units"),
        F.count(F.lit(1)).alias("post_count"),
    )


def run_live_series(
    rows: DataFrame, path: str, checkpoint: str, bucket_ms: int = BUCKET_MS, every: str | None = REFRESH
):
    """Store changed buckets, at most every 250 ms."""
    return start(live_buckets(rows, bucket_ms), keep_state(path, _BUCKET_KEYS), checkpoint, "update", every)


def read_live_series(spark: SparkSession, path: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Chart rows from the stored buckets; running values are added at read time."""
    return accumulate(latest_state(spark, path, _BUCKET_KEYS), bucket_ms)


def run_lifecycle(events: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Keep the folded events of every job up to date; read with ``latest_state``."""
    return start(fold_events(events), keep_state(path, ["job_id"]), checkpoint, "update", every)


def run_retries(
    failures: DataFrame,
    path: str,
    checkpoint: str,
    max_retries: int = MAX_RETRIES,
    every: str | None = None,
    ttl_s: int | None = None,
    now: Column | None = None,
    merge_every: int = MERGE_EVERY,
):
    """Route failed messages batch by batch against the retries on record.

    What a batch routes is written with its ``batch_id`` (``read_batches``); rows with ``discarded`` > 0 are the dead letters.
    The retries on record lie beside it as a state of one row per message. A batch looks at what earlier ones recorded
    only, so a repeated batch routes the same way. A record that is used up is dropped, and with ``ttl_s`` so is one that
    no failure has touched for so many seconds: the message starts over. ``now`` is the time of a batch.
    """
    record = f"{path}/_retries"
    clock = (now if now is not None else F.current_timestamp()).cast("timestamp")
    live = F.col("retries") > 0
    if ttl_s is not None:
        live = live & (F.col("at") > clock - F.make_dt_interval(secs=F.lit(ttl_s)))
    route, remember = batch_folder(path, merge_every), keep_state(record, ["message_key"], merge_every, live)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = latest_state(spark, record, ["message_key"], before=batch_id)
        if known is None:
            known = spark.createDataFrame([], "message_key string, retries long")
        else:
            known = known.filter(live)
        routed = materialize(route_failures(batch, known, max_retries))
        # The routing counts once it is written; a batch that stopped in between runs again and replaces both.
        remember(routed.select("message_key", "retries", clock.alias("at")), batch_id)
        route(routed, batch_id)

    return start(failures, write, checkpoint, every=every)

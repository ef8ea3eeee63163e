"""Continuous matching: raw events in, scored and stored rows out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.operators import enrich, match, normalize, validate
from sentispark.operators.normalize import is_post, post_columns
from sentispark.operators.score import score_with_lexicon
from sentispark.scale import keep_first
from sentispark.session import materialize
from sentispark.sources import store
from sentispark.sources.events import parse_events
from sentispark.streaming.sinks import batch_folder, start

Score = Callable[[DataFrame], DataFrame]
SENTIMENT = ("sentiment_score", "sentiment_label", "confidence")
#: Rows that a task writes, and bytes of their texts, which it holds once.
TASK_ROWS, TASK_BYTES = 100_000, 64 << 20


def checked_lines(lines: DataFrame, as_of: Column) -> DataFrame:
    """Every line parsed once, as a flat post with ``kind``: ``post``, ``rejected`` (with ``reason``) or null for other events.

    Rejected are unreadable lines (``raw`` is the line) and posts with an unusable date (``raw`` is the address).
    ``post_key`` is equal for copies of one post only. There is no filter here, as one would parse the lines once more.
    """
    events = parse_events(lines)
    here = ~F.col("corrupt") & is_post()
    columns = [F.when(here, c).alias(name) for name, c in post_columns().items()]
    raw = F.when(F.col("corrupt"), F.col("value")).alias("raw")
    posts = validate.check_dates(events.select(*columns, raw, "corrupt", here.alias("_post")), as_of, columns=("created_at",))
    return posts.select(
        *[c for c in posts.columns if c not in ("raw", "corrupt", "_post", "reason")],
        F.sha1(F.concat_ws(" ", "uri", F.col("created_at").cast("string"))).alias("post_key"),
        F.when(F.col("corrupt") | (F.col("_post") & F.col("reason").isNotNull()), "rejected").when(F.col("_post"), "post").alias("kind"),
        F.when(F.col("corrupt"), F.lit("malformed json")).when(F.col("_post"), F.col("reason")).alias("reason"),
        F.coalesce("raw", "uri").alias("raw"),
    )


def posts_among(checked: DataFrame) -> DataFrame:
    return checked.filter("kind = 'post'").drop("kind", "reason", "raw")


def rejects_among(checked: DataFrame) -> DataFrame:
    return checked.filter("kind = 'rejected'").select("raw", "reason")


def matched_posts(posts: DataFrame, matched: DataFrame, handles: DataFrame) -> DataFrame:
    """The matched posts: copies of a post are dropped and its author looked up."""
    found = posts.join(matched.select("post_key"), "post_key", "left_semi")
    first = keep_first(found, [F.col("post_key")], [F.col("time_us"), F.col("text")])
    return enrich.attach_handles(first, handles)


def post_records(posts: DataFrame, collected_at: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Of a storable row what all jobs of a post have in common, a row per post."""
    at = F.col("collected_at").cast("timestamp_ntz")
    nameless = posts.withColumn("job_id", F.lit(None).cast("string"))
    records = normalize.raw_records(nameless, collected_at, keep=["post_key", *keep]).drop("job_id")
    return records.withColumns({"collected_at": at, "analyzed_at": at})


def storable_rows(per_job: DataFrame) -> DataFrame:
    """Storable rows of post records that are repeated for every job that matched them."""
    rows = normalize.fill_defaults(per_job).withColumn("id", store.row_id(F.col("_address")))
    return rows.select(
        *("job_id", "text_content", "source", "source_url", "author_name", "upvotes", "comment_count", "published_at"),
        *("collected_at", *SENTIMENT, "raw_content", "id", "analyzed_at", "chunk_start"),
    )


def store_matches(found: DataFrame, matched: DataFrame, score: Score, collected_at: Column, path: str) -> None:
    """Store a row per new (post, job); ``found`` and ``matched`` are written already.

    What is stored is looked up by the addresses of the posts, with all jobs of an address at once, so up to there a post is one
    row. The posts with new jobs are scored. Then a task puts the keys of its rows in order and looks up the text of each, in
    a table with a row per post: texts are neither shuffled nor sorted once per job, and a file holds each of its texts once.
    """
    size = F.octet_length("text").alias("size")
    keys = materialize(
        post_records(found.withColumn("size", size), collected_at, ["size"]).select("post_key", "source_url", "published_at", "size")
    )
    known = store.stored_jobs(keys, path)
    new = keys.join(matched, "post_key")
    if known is not None:
        left = F.when(F.col("known").isNull(), F.col("jobs")).otherwise(F.array_except("jobs", "known"))
        new = new.join(known, ["source_url", "published_at"], "left").withColumn("jobs", left)
    new = materialize(new.filter(F.size("jobs") > 0).select("post_key", "published_at", "size", "jobs"))
    total = new.agg(F.sum(F.size("jobs")).alias("rows"), F.sum("size").alias("bytes")).first()
    # More than one, as a single part counts as dealt out otherwise and the rows would be dealt and sorted again.
    parts = 2 + max((total["rows"] or 0) // TASK_ROWS, (total["bytes"] or 0) // TASK_BYTES)
    scored = score(found.join(new.select("post_key"), "post_key", "left_semi").withColumnRenamed("text", "text_content"))
    records = post_records(scored.withColumnRenamed("text_content", "text"), collected_at, SENTIMENT)
    texts = records.withColumn("_address", store.id_address()).drop("published_at").repartition(parts, "post_key").hint("shuffle_hash")
    dealt = store.with_chunk(new.repartition(parts, "post_key").select("post_key", "published_at", F.explode("jobs").alias("job_id")))
    # The condition holds for every row. Without it the optimizer leaves out the sort, as rows of a join need no order; here the
    # order of the keys is that of the rows, and these are not sorted once more.
    ordered = dealt.sortWithinPartitions("chunk_start", "job_id", "published_at").filter(F.spark_partition_id() >= 0)
    store.write_rows(storable_rows(ordered.join(texts, "post_key")), path)


def processed_counts(posts: DataFrame, matched: DataFrame, at: Column) -> DataFrame:
    """One progress row per job; copies of a post count every time they arrive."""
    arrivals = posts.groupBy("post_key").agg(F.count(F.lit(1)).alias("copies"))
    return (
        matched.join(arrivals, "post_key")
        .select("copies", F.explode("jobs").alias("job_id"))
        .groupBy("job_id")
        .agg(F.sum("copies").alias("amount"))
        .withColumns({"ts": at, "kind": F.lit("processed")})
    )


def run_match_pipeline(
    lines: DataFrame,
    read_jobs: Callable[[SparkSession], DataFrame],
    read_handles: Callable[[SparkSession], DataFrame],
    rows_path: str,
    progress_path: str,
    checkpoint: str,
    event_time: str | None = None,
    collected_at: Column | None = None,
    score: Score = score_with_lexicon,
    every: str | None = None,
    rejected_path: str | None = None,
):
    """Match a stream of event lines against all active jobs.

    Job and handle tables are read again for every batch, so new and cancelled jobs take effect
    at the next one. Rows are stored once however often a batch runs, whatever their age: late
    posts land in their own time chunk. The posts, each with all its jobs, and their texts are written once per batch; a post is scored in the batch that stores rows of it. Per batch and job, one progress row counts what was
    processed, duplicates included; the completion tracker reads those instead of single rows.
    With ``rejected_path`` unreadable lines and posts with unusable dates are stored with their reason.

    A batch is parsed once: pairs, rows, counts and rejects are read from the parsed lines, written for the time of the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = collected_at if collected_at is not None else F.current_timestamp()
        checked = materialize(checked_lines(batch, now))
        posts = posts_among(checked)
        matched = materialize(
            match.match_pairs(posts, read_jobs(spark), key="post_key", event_time=event_time, listed=True)
        )
        found = materialize(matched_posts(posts, matched, read_handles(spark)))
        store_matches(found, matched, score, now, rows_path)
        if rejected_path is not None:
            batch_folder(rejected_path)(rejects_among(checked), batch_id)
        batch_folder(progress_path)(processed_counts(posts, matched, now), batch_id)

    return start(lines, write, checkpoint, every=every)

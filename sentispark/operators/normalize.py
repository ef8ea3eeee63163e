"""Events to posts, posts to raw records, raw records to storable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.functions.text import post_url
from sentispark.sources.events import is_post_creation


def _present(column: Column) -> Column:
    return F.length(column) > 0


def is_post() -> Column:
    """Whether an event is a post creation with the key and content id it needs."""
    commit = F.col("commit")
    return F.coalesce(is_post_creation() & _present(commit["rkey"]) & _present(commit["cid"]), F.lit(False))


def post_columns() -> dict[str, Column]:
    """The columns of a flat post, from those of an event."""
    commit = F.col("commit")
    return {
        "did": F.col("did"),
        "handle": F.lit(None).cast("string"),
        "rkey": commit["rkey"],
        "text": commit["record"]["text"],
        "created_at": F.try_to_timestamp(commit["record"]["createdAt"]),
        "uri": F.concat(F.lit("at://"), F.col("did"), F.lit("/"), commit["collection"], F.lit("/"), commit["rkey"]),
        "cid": commit["cid"],
        "time_us": F.col("time_us"),
        "langs": commit["record"]["langs"],
        "is_reply": commit["record"]["reply"].isNotNull(),
    }


def normalize_posts(events: DataFrame) -> DataFrame:
    """Flat posts from creation events; an event without key or content id is left out."""
    posts = events.filter(~F.col("corrupt") & is_post())
    return posts.select(*[c.alias(name) for name, c in post_columns().items()])


def author_or_did() -> Column:
    """Shown author: the handle, or the account id when it is unknown or empty."""
    return F.coalesce(F.when(_present(F.col("handle")), F.col("handle")), F.col("did"))


def raw_records(
    matches: DataFrame, collected_at: Column | None = None, keep: list[str] = ()
) -> DataFrame:
    """Matched posts (one row per post and job) as records to be scored; ``keep`` passes through."""
    return matches.select(
        "job_id",
        F.col("text").alias("text_content"),
        F.lit("bluesky").alias("source"),
        post_url(author_or_did(), F.col("uri")).alias("source_url"),
        F.coalesce("handle", "did").alias("author_name"),
        F.lit(None).cast("int").alias("upvotes"),
        F.lit(None).cast("int").alias("comment_count"),
        F.col("created_at").alias("published_at"),
        (collected_at if collected_at is not None else F.current_timestamp()).alias("collected_at"),
        *keep,
    )


def fill_defaults(records: DataFrame) -> DataFrame:
    """Counts default to 0 and the raw content is the text itself."""
    return records.withColumns(
        {
            "upvotes": F.coalesce("upvotes", F.lit(0)),
            "comment_count": F.coalesce("comment_count", F.lit(0)),
            "raw_content": F.col("text_content"),
        }
    )


def published_or(as_of: Column) -> Column:
    return F.coalesce("published_at", "analyzed_at", as_of.cast("timestamp_ntz"))


def result_rows(rows: DataFrame) -> DataFrame:
    """Columns a result reader gets: no raw content, confidence or counts."""
    return rows.select(
        "id",
        "text_content",
        "sentiment_label",
        "sentiment_score",
        "source",
        "source_url",
        "author_name",
        F.coalesce("published_at", "analyzed_at").alias("published_at"),
        "analyzed_at",
    )

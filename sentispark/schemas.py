"""Schemas of the domain tables."""

from pyspark.sql import types as T

_REF = T.StructType([T.StructField("uri", T.StringType()), T.StructField("cid", T.StringType())])

_IMAGE = T.StructType(
    [T.StructField("alt", T.StringType()), T.StructField("image", T.MapType(T.StringType(), T.StringType()))]
)

_FACET = T.StructType(
    [
        T.StructField(
            "index",
            T.StructType(
                [T.StructField("byteStart", T.LongType()), T.StructField("byteEnd", T.LongType())]
            ),
        ),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("$type", T.StringType()),
                        T.StructField("uri", T.StringType()),
                        T.StructField("did", T.StringType()),
                        T.StructField("tag", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

# Embeds and facets are carried for the reader; no operator queries them.
RECORD = T.StructType(
    [
        T.StructField("$type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("createdAt", T.StringType()),
        T.StructField("langs", T.ArrayType(T.StringType())),
        T.StructField(
            "reply", T.StructType([T.StructField("parent", _REF), T.StructField("root", _REF)])
        ),
        T.StructField(
            "embed",
            T.StructType(
                [T.StructField("$type", T.StringType()), T.StructField("images", T.ArrayType(_IMAGE))]
            ),
        ),
        T.StructField("facets", T.ArrayType(_FACET)),
    ]
)

RAW_EVENT = T.StructType(
    [
        T.StructField("did", T.StringType()),
        T.StructField("time_us", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField(
            "commit",
            T.StructType(
                [
                    T.StructField("rev", T.StringType()),
                    T.StructField("operation", T.StringType()),
                    T.StructField("collection", T.StringType()),
                    T.StructField("rkey", T.StringType()),
                    T.StructField("cid", T.StringType()),
                    T.StructField("record", RECORD),
                ]
            ),
        ),
        T.StructField(
            "identity",
            T.StructType(
                [
                    T.StructField("handle", T.StringType()),
                    T.StructField("seq", T.LongType()),
                    T.StructField("time", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "account",
            T.StructType(
                [
                    T.StructField("active", T.BooleanType()),
                    T.StructField("status", T.StringType()),
                    T.StructField("seq", T.LongType()),
                ]
            ),
        ),
    ]
)

SEARCH_POST = T.StructType(
    [
        T.StructField("uri", T.StringType()),
        T.StructField("cid", T.StringType()),
        T.StructField(
            "author",
            T.StructType(
                [
                    T.StructField("did", T.StringType()),
                    T.StructField("handle", T.StringType()),
                    T.StructField("displayName", T.StringType()),
                    T.StructField("avatar", T.StringType()),
                ]
            ),
        ),
        T.StructField("record", T.StringType()),
        T.StructField("likeCount", T.IntegerType()),
        T.StructField("repostCount", T.IntegerType()),
        T.StructField("replyCount", T.IntegerType()),
        T.StructField("indexedAt", T.StringType()),
    ]
)

JOB = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("search_strategy", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
    ]
)

RAW_RECORD = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("text_content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("upvotes", T.IntegerType()),
        T.StructField("comment_count", T.IntegerType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("collected_at", T.TimestampType()),
    ]
)

SCORED_ROW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("text_content", T.StringType()),
        T.StructField("raw_content", T.StringType()),
        T.StructField("sentiment_score", T.FloatType()),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("confidence", T.FloatType()),
        T.StructField("upvotes", T.IntegerType()),
        T.StructField("comment_count", T.IntegerType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("collected_at", T.TimestampNTZType()),
        T.StructField("analyzed_at", T.TimestampNTZType()),
    ]
)

JOB_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("amount", T.LongType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# Job states, sentiment labels and message types.
JOB_STATUSES = ("pending", "in_progress", "completed", "failed")
TERMINAL_STATUSES = ("completed", "failed")
LABELS = ("positive", "neutral", "negative")
FEED_TYPES = (
    "job.error",
    "job.status",
    "job.subscribed",
    "job.completed",
    "job.failed",
    "heartbeat",
    "job.data_update",
)
POST_COLLECTION = "app.bsky.feed.post"

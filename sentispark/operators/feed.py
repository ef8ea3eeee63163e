"""The event feed: updates per stored row, envelopes, subscriptions, history and live rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.scale import keep_first, number_rows
from sentispark.schemas import FEED_TYPES, TERMINAL_STATUSES


def running_count(rows: DataFrame, order: list[str], out: str = "total_processed") -> DataFrame:
    """Every row with the number of rows of its job up to it."""
    return number_rows(rows, ["job_id"], order, out)


def update_feed(processed: DataFrame, order: list[str]) -> DataFrame:
    """One message per newly stored row, with the running count of its job.

    ``processed`` also holds the duplicates (``is_duplicate``): they advance the counter but
    emit nothing.
    """
    return update_messages(running_count(processed, order))


def update_messages(numbered: DataFrame) -> DataFrame:
    """The messages of rows that carry ``total_processed`` and ``is_duplicate``."""
    point = F.struct(
        F.col("id"),
        F.col("text_content").alias("textContent"),
        F.col("source"),
        F.col("source_url").alias("sourceUrl"),
        F.col("author_name").alias("authorName"),
        F.col("sentiment_score").alias("sentimentScore"),
        F.col("sentiment_label").alias("sentimentLabel"),
        F.col("published_at").alias("publishedAt"),
    )
    return numbered.filter(~F.col("is_duplicate")).select(
        "job_id",
        "id",
        "total_processed",
        F.to_json(F.struct(F.col("job_id").alias("jobId"), point.alias("dataPoint"), F.col("total_processed").alias("totalProcessed"))).alias(
            "message"
        ),
    )


def envelope(df: DataFrame, kind: str, payload: list[str]) -> DataFrame:
    """Rows as ``{type, data}`` messages."""
    return df.select(
        F.lit(kind).alias("type"), "job_id", F.to_json(F.struct(*payload)).alias("data")
    )


def union_feed(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def subscribe(feed: DataFrame, job_id) -> DataFrame:
    """Known events of one job; heartbeats go to everyone."""
    mine = (F.col("job_id") == job_id) | (F.col("type") == "heartbeat")
    return feed.filter(mine & F.col("type").isin(*FEED_TYPES))


def is_terminal(status: Column | str = "status") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return status.isin(*TERMINAL_STATUSES)


def history_and_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """Stored rows (received when analyzed) followed by streamed ones, first copy of an id wins."""
    seed = history.withColumns(
        {"received_at": F.col("analyzed_at"), "_part": F.lit(0)}
    )
    streamed = live.withColumn("_part", F.lit(1))
    both = seed.unionByName(streamed, allowMissingColumns=True)
    first = keep_first(both, [F.col("id")], [F.col("_part"), F.col("received_at")])
    return first.drop("_part")


def keep_first_by_id(rows: DataFrame, order: list[Column]) -> DataFrame:
    return keep_first(rows, [F.col("id")], order)

"""Input tables and their mapping to jobs, posts and scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.functions.labels import NEUTRAL_CONFIDENCE
from sentispark.functions.numeric import clamp
from sentispark.scale import spread

BASE_TIME = "2024-01-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts, spread out for per-row work."""
    return spread(table(spark, folder, name))


def documents_as_posts(spark: SparkSession, folder: str) -> DataFrame:
    docs = text_table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("post_id"), "text", "lang", "source")


def prompts_as_jobs(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    return items.select(F.col("item_id").alias("job_id"), F.col("text").alias("prompt"))


def events_as_scored(spark: SparkSession, folder: str, job: str = "event_type") -> DataFrame:
    """Events as scored rows of the jobs named by a column; the value, centred on 50, is the score."""
    events = table(spark, folder, "events")
    score = clamp((F.col("value") - F.lit(50.0)) / F.lit(50.0))
    label = (
        F.when(F.abs("sentiment_score") < NEUTRAL_CONFIDENCE, "neutral")
        .when(F.col("sentiment_score") > 0, "positive")
        .otherwise("negative")
    )
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col(job).cast("string").alias("job_id"),
        F.lit("bluesky").alias("source"),
        F.concat(
            F.lit("https://bsky.app/profile/"), F.col("user_id"), F.lit("/post/"), F.col("event_id")
        ).alias("source_url"),
        F.concat(F.lit("user"), F.col("user_id")).alias("author_name"),
        F.concat_ws(" ", "event_type", "props").alias("text_content"),
        score.alias("sentiment_score"),
        F.col("ts").alias("published_at"),
        F.col("ts").alias("collected_at"),
        (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("analyzed_at"),
        F.col("event_id").alias("seq"),
        "user_id",
        "event_type",
        "value",
        "props",
    ).withColumns({"sentiment_label": label, "confidence": F.abs("sentiment_score")})


def users_as_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job per customer, so some have no scored rows."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.col("c_name").alias("prompt")
    )


def orders_as_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The job table: user, status and creation time from the orders."""
    status = (
        F.when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderstatus") == "P", "in_progress")
        .otherwise("completed")
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("prompt"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )

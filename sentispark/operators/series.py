"""Bucketed series per job, and stream throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.functions.numeric import clamp, epoch_ms, round_half_up, score_units, units_mean
from sentispark.scale import running_totals

BUCKET_MS = 1000
# Buckets ordered together by one task when accumulating.
BUCKETS_PER_SPAN = 100_000


def _buckets(rows: DataFrame, time_col: str | Column, bucket_ms: int, score: str) -> DataFrame:
    at = epoch_ms(time_col)
    return (
        rows.select(
            "job_id",
            (F.floor(at / F.lit(bucket_ms)) * F.lit(bucket_ms)).alias("bucket_ms"),
            score_units(clamp(score)).alias("_u"),
        )
        .groupBy("job_id", "bucket_ms")
        .agg(F.sum("_u").alias("units"), F.count(F.lit(1)).alias("post_count"))
    )


def bucket_series(
    rows: DataFrame,
    time_col: str | Column = "published_at",
    bucket_ms: int = BUCKET_MS,
    score: str = "sentiment_score",
) -> DataFrame:
    """Mean and count per tumbling bucket, scores clamped to -1..1; empty buckets are absent.

    ``time_col`` is the publication time for finished jobs and the arrival time for live ones.
    """
    return _buckets(rows, time_col, bucket_ms, score).select(
        "job_id",
        F.floor(F.col("bucket_ms") / F.lit(1000)).alias("time"),
        units_mean(F.col("units"), F.col("post_count")).alias("value"),
        "post_count",
    )


def chart_series(
    rows: DataFrame,
    time_col: str | Column = "published_at",
    bucket_ms: int = BUCKET_MS,
    score: str = "sentiment_score",
) -> DataFrame:
    """``bucket_series`` with the running number of posts and the running average."""
    return accumulate(_buckets(rows, time_col, bucket_ms, score), bucket_ms)


def accumulate(buckets: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Chart rows from per-bucket ``units`` and ``post_count`` (batch or stored by a stream)."""
    totals = running_totals(
        buckets,
        key="job_id",
        position="bucket_ms",
        span=bucket_ms * BUCKETS_PER_SPAN,
        values={"units": "total_units", "post_count": "total_posts"},
    )
    return totals.select(
        "job_id",
        F.floor(F.col("bucket_ms") / F.lit(1000)).alias("time"),
        units_mean(F.col("units"), F.col("post_count")).alias("value"),
        "post_count",
        "total_posts",
        units_mean(F.col("total_units"), F.col("total_posts")).alias("cumulative_average"),
    )


def throughput(
    events: DataFrame, at: Column, is_post: Column, matched: Column, window_s: int = 60
) -> DataFrame:
    """Messages, posts and matches per window, and messages per second to one decimal."""
    start = F.floor(epoch_ms(at) / F.lit(window_s * 1000)) * F.lit(window_s)
    counted = events.groupBy(start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("messages_received"),
        F.count_if(is_post).alias("posts_processed"),
        F.sum(matched.cast("long")).alias("total_matched"),
    )
    rate = round_half_up(F.col("messages_received") / F.lit(float(window_s)) * F.lit(10.0)) / F.lit(10.0)
    return counted.withColumn("messages_per_second", rate)

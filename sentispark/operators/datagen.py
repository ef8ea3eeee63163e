"""Deterministic builders of scored rows and messages, for tests and load runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The labelled sample texts.
POSITIVE_TEXTS = (
    "I absolutely love this product! It exceeded all my expectations.",
    "This is the best purchase I have ever made. Amazing quality!",
    "Fantastic experience, highly recommend to everyone.",
    "Great value for money, works perfectly!",
    "Excellent customer service and fast shipping.",
)
NEGATIVE_TEXTS = (
    "This is terrible. Complete waste of money.",
    "Worst product I have ever bought. Avoid at all costs.",
    "Horrible quality, broke within a day. Very disappointed.",
    "I hate this so much. Returning immediately.",
    "Awful experience, will never buy again.",
)
NEUTRAL_TEXTS = (
    "The product arrived on time.",
    "It works as described in the manual.",
    "Average quality, nothing special.",
    "It is okay for the price.",
    "Standard product, meets basic expectations.",
)

# Rows one task unfolds from a count at a time.
BLOCK = 100_000


def sentiment_batch(distribution: DataFrame) -> DataFrame:
    """Scored rows with the given (job_id, positive, neutral, negative) counts.

    Scores cycle through 0.6..0.9, -0.1..0.1 and -0.6..-0.9.
    """
    n = F.col("i")
    wanted = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(label).cast("long").alias("n"))
            for label in ("positive", "neutral", "negative")
        ]
    )
    tenths = (
        F.when(F.col("label") == "positive", 6 + n % 4)
        .when(F.col("label") == "neutral", n % 3 - 1)
        .otherwise(-6 - n % 4)
    )
    return (
        distribution.select("job_id", F.inline(wanted))
        .filter("n > 0")
        # Blocks are spread over the tasks before they unfold, so one huge count is no one task's work.
        .select("job_id", "label", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))).alias("b"))
        .repartition("job_id", "label", "b")
        .select("job_id", "label", F.explode(F.sequence(F.col("b") * BLOCK, F.least(F.col("n"), (F.col("b") + 1) * BLOCK) - 1)).alias("i"))
        .select(
            F.concat_ws("-", "job_id", "label", F.col("i").cast("string")).alias("id"),
            "job_id",
            F.col("label").alias("sentiment_label"),
            (tenths / F.lit(10.0)).alias("sentiment_score"),
        )
    )


def message_batch(spark, count: int) -> DataFrame:
    """Raw messages cycling through the sample texts, ten to a job."""
    texts = F.array(*[F.lit(t) for t in (*POSITIVE_TEXTS, *NEGATIVE_TEXTS, *NEUTRAL_TEXTS)])
    i = F.col("id")
    return spark.range(count).select(
        F.concat(F.lit("batch-job-"), F.floor(i / F.lit(10)).cast("string")).alias("job_id"),
        F.get(texts, (i % 15).cast("int")).alias("text_content"),
        F.lit("reddit").alias("source"),
        i.alias("seq"),
    )

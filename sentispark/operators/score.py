"""Score texts: the built-in lexicon, or any batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentispark.functions.keywords import word_list
from sentispark.functions.labels import blank_sentiment, class_to_sentiment, is_blank, top_class
from sentispark.functions.lexicon import evidence, lexicon_hits
from sentispark.functions.text import truncate_for_model

Scorer = Callable[[list[str]], list[tuple[str, float]]]
SMOOTHING = 1.0


def lexicon_classes(positive: Column, negative: Column) -> Column:
    """Two class probabilities from summed word weights."""
    total = positive + negative + F.lit(2 * SMOOTHING)
    return F.array(
        F.struct(F.lit("POSITIVE").alias("label"), ((positive + F.lit(SMOOTHING)) / total).alias("score")),
        F.struct(F.lit("NEGATIVE").alias("label"), ((negative + F.lit(SMOOTHING)) / total).alias("score")),
    )


def score_with_lexicon(
    posts: DataFrame,
    text: str = "text_content",
    weights: dict[str, int] | None = None,
    words: str | None = None,
) -> DataFrame:
    """Add the three sentiment columns over the whole text; a text without evidence counts as blank.

    Stays inside the JVM and needs no shuffle. The steps are separate projections, as Spark
    computes an expression used twice in one projection twice. ``words`` names a ready
    ``word_list`` column, if there is one.
    """
    positive, negative = evidence(F.col("_hits"), weights)
    no_evidence = F.col("_positive") + F.col("_negative") == 0
    return (
        posts.withColumn("_hits", lexicon_hits(F.col(words) if words else word_list(text), weights))
        .withColumns({"_positive": positive, "_negative": negative})
        .withColumn("_top", top_class(lexicon_classes(F.col("_positive"), F.col("_negative"))))
        .withColumn(
            "_s",
            F.when(no_evidence, blank_sentiment()).otherwise(
                class_to_sentiment(F.col("_top.label"), F.col("_top.score"))
            ),
        )
        .select(
            *posts.columns,
            F.col("_s.score").alias("sentiment_score"),
            F.col("_s.label").alias("sentiment_label"),
            F.col("_s.confidence").alias("confidence"),
        )
    )


def score_with_model(
    posts: DataFrame,
    factory: Callable[..., Scorer],
    text: str = "text_content",
    batch_size: int = 256,
    max_chars: int | None = None,
    **options,
) -> DataFrame:
    """Add the three sentiment columns from a user's model.

    ``factory(**options)`` loads the model once per task; the scorer it returns maps a list of
    texts to their top (label, probability), at most ``batch_size`` at a time; a task holds the texts
    of one Arrow batch. Blank texts never reach the model. ``max_chars`` cuts the
    model's input (not the stored text) for models with an input limit.
    """
    model_input = truncate_for_model(text, max_chars) if max_chars else F.col(text)
    result = T.StructType([T.StructField("label", T.StringType()), T.StructField("probability", T.DoubleType())])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = None
        for texts in batches:
            scorer = scorer or factory(**options)
            labels: list[str | None] = [None] * len(texts)
            scores: list[float | None] = [None] * len(texts)
            values = texts.tolist()
            wanted = [i for i, value in enumerate(values) if value is not None]
            for start in range(0, len(wanted), batch_size):
                part = wanted[start : start + batch_size]
                for i, (label, probability) in zip(part, scorer([values[i] for i in part])):
                    labels[i], scores[i] = label, float(probability)
            yield pd.DataFrame({"label": labels, "probability": pd.array(scores, dtype="Float64")})

    # Only the text goes to Python; all other columns stay as they are.
    model = F.pandas_udf(run, result)
    scored = posts.withColumn("_m", model(F.when(~is_blank(text), model_input)))
    sentiment = F.when(F.col("_m.label").isNull(), blank_sentiment()).otherwise(
        class_to_sentiment(F.col("_m.label"), F.col("_m.probability"))
    )
    return scored.withColumn("_s", sentiment).select(
        *posts.columns,
        F.col("_s.score").alias("sentiment_score"),
        F.col("_s.label").alias("sentiment_label"),
        F.col("_s.confidence").alias("confidence"),
    )

"""Labels, class mapping and short descriptions of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentispark.functions.numeric import clamp

# The bands. The model band is on confidence, the others on the score.
NEUTRAL_CONFIDENCE = 0.6
DISPLAY_BAND = 0.1
LIVE_BAND = 0.2


def _ladder(value: Column, steps, default: str) -> Column:
    """First label whose (operator, bound) holds."""
    chain = None
    for op, bound, label in steps:
        test = {">=": value >= bound, ">": value > bound, "<=": value <= bound}[op]
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return F.when(value.isNull(), F.lit(None)).otherwise(chain.otherwise(default))


def top_class(classes: Column) -> Column:
    """The class with the higher probability; the earlier one wins a tie."""
    ranked = F.transform(
        classes,
        lambda c, i: F.struct(c["score"].alias("score"), (-i).alias("back"), c["label"].alias("label")),
    )
    best = F.array_max(ranked)
    return F.struct(best["label"].alias("label"), best["score"].alias("score"))


def class_to_sentiment(label: Column, probability: Column) -> Column:
    """Model class and probability -> struct(score, label, confidence)."""
    confidence = clamp(probability, 0.0, 1.0)
    is_positive = F.upper(label) == F.lit("POSITIVE")
    score = clamp(F.when(is_positive, confidence).otherwise(-confidence))
    name = (
        F.when(confidence < NEUTRAL_CONFIDENCE, "neutral")
        .when(is_positive, "positive")
        .otherwise("negative")
    )
    return F.struct(score.alias("score"), name.alias("label"), confidence.alias("confidence"))


def blank_sentiment() -> Column:
    """What a text without any evidence gets."""
    return F.struct(
        F.lit(0.0).alias("score"), F.lit("neutral").alias("label"), F.lit(0.5).alias("confidence")
    )


def is_blank(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.isNull() | text.rlike(r"^[\s\x{feff}\p{Z}]*$")


def normalize_label(label: Column | str) -> Column:
    lowered = F.lower(F.col(label) if isinstance(label, str) else label)
    return F.when(lowered.isin("positive", "negative", "neutral"), lowered).otherwise("neutral")


def score_label(score: Column | str, band: float = DISPLAY_BAND) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (
        F.when(score.isNull(), F.lit(None))
        .when(score < -band, "negative")
        .when(score > band, "positive")
        .otherwise("neutral")
    )


def nss_description(nss: Column) -> Column:
    return _ladder(
        nss,
        [
            (">=", 50, "Very Positive"),
            (">=", 20, "Positive"),
            (">=", -20, "Neutral"),
            (">=", -50, "Negative"),
        ],
        "Very Negative",
    )


def nss_market_label(nss: Column) -> Column:
    return _ladder(
        nss,
        [
            (">=", 50, "Very Bullish"),
            (">=", 20, "Bullish"),
            (">", -20, "Neutral"),
            (">", -50, "Bearish"),
        ],
        "Very Bearish",
    )


def velocity_label(velocity: Column) -> Column:
    return _ladder(
        velocity,
        [
            (">=", 0.2, "Rapidly Improving"),
            (">=", 0.05, "Improving"),
            ("<=", -0.2, "Rapidly Declining"),
            ("<=", -0.05, "Declining"),
        ],
        "Stable",
    )


def score_emoji(score: Column) -> Column:
    return _ladder(
        score,
        [
            (">=", 0.4, "\U0001f60a"),
            (">=", 0.1, "\U0001f642"),
            (">=", -0.1, "\U0001f610"),
            (">=", -0.4, "\U0001f615"),
        ],
        "\U0001f61e",
    )


def signed_score(score: Column) -> Column:
    """Two decimals with a plus sign on positive scores."""
    return F.concat(F.when(score > 0, "+").otherwise(""), F.format_string("%.2f", score.cast("double")))


def score_percent(score: Column) -> Column:
    return (score + F.lit(1.0)) / F.lit(2.0) * F.lit(100.0)


def capitalized(label: Column) -> Column:
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))

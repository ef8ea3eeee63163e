"""A scorer learned from labelled texts: one weight per word, stored as a table and joined.

A word's weight is the smoothed log-odds of the positive class among the labelled texts that hold it, from counts grouped on Spark.
The evidence of a text is the sum over its distinct words; a logistic curve fitted to labelled texts makes a probability
of it. Only words and keys are shuffled, never texts, and the vocabulary is as large as the labelled texts make it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.functions.keywords import token_set
from sentispark.functions.labels import blank_sentiment, class_to_sentiment
from sentispark.scale import SALTS, fits_broadcast

SMOOTHING = 1.0
#: Weights and evidence are whole units of this size, so sums do not depend on the order of rows.
UNIT = 1e-6


@dataclass(frozen=True)
class Curve:
    """P(positive) = 1 / (1 + exp(-(slope * evidence + bias))), evidence in units of one."""

    slope: float = 1.0
    bias: float = 0.0


def learn_weights(labelled: DataFrame, text: str = "text", positive: str = "positive", least: int = 5, smoothing: float = SMOOTHING) -> DataFrame:
    """(token, weight, texts) for every word that at least ``least`` labelled texts hold; ``weight`` in units of ``UNIT``.

    ``positive`` is 1 or 0; rows with a null label or text teach nothing. A word counts once per text; counts are combined
    before the shuffle, so a word of every text costs a row per task.
    """
    rows = labelled.filter(F.col(positive).isNotNull() & F.col(text).isNotNull())
    up = F.col(positive).cast("double") > 0.5
    # One row: the number of texts of either class.
    total = rows.agg(F.count_if(up).alias("up"), F.count_if(~up).alias("down")).first()
    tokens = rows.select(up.alias("up"), F.explode(token_set(text)).alias("token"))
    counted = tokens.groupBy("token").agg(F.count_if("up").alias("ups"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= least)

    def log_share(count: Column, of: int) -> Column:
        return F.log((count + F.lit(smoothing)) / F.lit(of + 2 * smoothing))

    odds = log_share(F.col("ups"), total["up"]) - log_share(F.col("texts") - F.col("ups"), total["down"])
    return counted.select("token", F.round(odds / F.lit(UNIT)).cast("long").alias("weight"), "texts")


def evidence(posts: DataFrame, weights: DataFrame, key: str = "post_id", text: str = "text") -> DataFrame:
    """(key, evidence, known): the summed weights of a post's distinct words and how many of them have one; only posts with any.

    The weights go to the tasks if they measure small; otherwise (key, word) rows are shuffled, salted, so that a word
    of every post is spread over many tasks.
    """
    tokens = posts.select(key, F.explode(token_set(text)).alias("token"))
    table = weights.select("token", "weight")
    if fits_broadcast(table):
        hits = tokens.join(F.broadcast(table), "token")
    else:
        salted = tokens.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = salted.join(copies, ["token", "_salt"])
    return hits.groupBy(key).agg(F.sum("weight").alias("evidence"), F.count(F.lit(1)).alias("known"))


def fit_curve(found: DataFrame, positive: str = "positive", steps: int = 12) -> Curve:
    """The curve that fits the evidence of labelled posts best: Newton steps, each one aggregate of five numbers."""
    x = F.col("evidence").cast("double") * F.lit(UNIT)
    y = F.col(positive).cast("double")
    rows = found.filter(F.col(positive).isNotNull())
    slope, bias = 1.0, 0.0
    for _ in range(steps):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(x * F.lit(slope) + F.lit(bias))))
        curved = p * (F.lit(1.0) - p)
        parts = {"gs": (y - p) * x, "gb": y - p, "ss": curved * x * x, "sb": curved * x, "bb": curved}
        sums = rows.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in parts.items()]).first()
        # A little is added to the diagonal: a separable sample has no finite best slope.
        ss, bb, sb = sums["ss"] + 1e-3, sums["bb"] + 1e-3, sums["sb"]
        size = ss * bb - sb * sb
        step = (bb * sums["gs"] - sb * sums["gb"]) / size, (ss * sums["gb"] - sb * sums["gs"]) / size
        # Half steps at most keep the curve rising and finite.
        slope, bias = max(slope + max(min(step[0], 0.5), -0.5), 1e-3), bias + max(min(step[1], 2.0), -2.0)
        if max(map(abs, step)) < 1e-6 or not all(map(math.isfinite, step)):
            break
    return Curve(slope, bias)


def score_with_weights(posts: DataFrame, weights: DataFrame, curve: Curve, key: str = "post_id", text: str = "text") -> DataFrame:
    """(key, sentiment_score, sentiment_label, confidence) of every post; a post without known words counts as blank.

    Keyed and narrow, to be joined where it is needed. ``key`` is unique among the posts; a post without a key is blank.
    """
    found = evidence(posts.filter(F.col(key).isNotNull()), weights, key, text)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") * F.lit(UNIT) * F.lit(curve.slope) + F.lit(curve.bias))))
    top = F.when(p >= 0.5, class_to_sentiment(F.lit("POSITIVE"), p)).otherwise(class_to_sentiment(F.lit("NEGATIVE"), F.lit(1.0) - p))
    scored = posts.select(key).join(found, key, "left").withColumn("_s", F.when(F.col("evidence").isNull(), blank_sentiment()).otherwise(top))
    return scored.select(
        key,
        F.col("_s.score").alias("sentiment_score"),
        F.col("_s.label").alias("sentiment_label"),
        F.col("_s.confidence").alias("confidence"),
    )

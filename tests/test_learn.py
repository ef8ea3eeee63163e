"""The learned scorer: weights by hand, held-out accuracy, plans without shuffled texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sentispark.functions.lexicon import WEIGHTS
from sentispark.operators import learn


def test_weights_by_hand(spark):
    rows = [("good good day", 1), ("good night", 1), ("bad day", 0), ("Bad, bad night", 0), ("good bad", 1), (None, 1), ("good", None), ("", 0)]
    found = {r["token"]: (r["weight"], r["texts"]) for r in learn.learn_weights(spark.createDataFrame(rows, "text string, positive int"), least=2).collect()}

    def weight(ups, texts, up=3, down=3):
        return round((math.log((ups + 1) / (up + 2)) - math.log((texts - ups + 1) / (down + 2))) * 1e6)

    assert found == {"good": (weight(3, 3), 3), "bad": (weight(1, 3), 3), "day": (weight(1, 2), 2), "night": (weight(1, 2), 2)}


@pytest.fixture(scope="module")
def corpus(spark):
    """Two thousand words; each tells a little about the class of the texts that hold it."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(2000)]
    rows = []
    for k in range(3000):
        positive = rng.random() < 0.5
        own, other = (words[:1000], words[1000:]) if positive else (words[1000:], words[:1000])
        text = " ".join(rng.choice(own) if rng.random() < 0.6 else rng.choice(other) for _ in range(60))
        rows.append((k, text, int(positive)))
    return spark.createDataFrame(rows, "post_id long, text string, positive int").repartition(4).persist()


def test_held_out_accuracy(spark, corpus):
    learned, held, test = (corpus.filter(f"post_id % 5 {c}") for c in ("> 1", "= 1", "= 0"))
    weights = learn.learn_weights(learned).persist()
    assert weights.count() > 10 * len(WEIGHTS)
    found = learn.evidence(held, weights).join(held.select("post_id", "positive"), "post_id")
    curve = learn.fit_curve(found)
    scored = learn.score_with_weights(test, weights, curve).join(test.select("post_id", "positive"), "post_id").collect()
    right = sum((r["sentiment_score"] > 0) == bool(r["positive"]) for r in scored) / len(scored)
    assert right > 0.85
    # Calibrated: of the rows scored near p about a share of p is right.
    for low, high in ((0.5, 0.8), (0.8, 0.95), (0.95, 1.01)):
        some = [r for r in scored if low <= r["confidence"] < high]
        if len(some) > 60:
            share = sum((r["sentiment_score"] > 0) == bool(r["positive"]) for r in some) / len(some)
            assert abs(share - sum(r["confidence"] for r in some) / len(some)) < 0.12
    assert {r["sentiment_label"] for r in scored} == {"positive", "negative", "neutral"}


def test_either_join_gives_the_same_evidence(corpus, monkeypatch):
    weights = learn.learn_weights(corpus)
    want = sorted(map(tuple, learn.evidence(corpus, weights).collect()))
    monkeypatch.setattr(learn, "fits_broadcast", lambda df: False)
    spread = learn.evidence(corpus, weights)
    assert sorted(map(tuple, spread.collect())) == want
    exchanges = [x for x in spread._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert exchanges and not any("text" in x for x in exchanges)


def test_odd_posts_are_blank(spark, corpus):
    weights = learn.learn_weights(corpus)
    rows = [(1, None), (2, ""), (3, "unknown words only"), (None, corpus.first()["text"])]
    scored = learn.score_with_weights(spark.createDataFrame(rows, "post_id long, text string"), weights, learn.Curve()).collect()
    assert len(scored) == 4 and {(r["sentiment_score"], r["sentiment_label"], r["confidence"]) for r in scored} == {(0.0, "neutral", 0.5)}
    none = corpus.limit(0)
    assert learn.learn_weights(none).count() == 0
    assert learn.fit_curve(learn.evidence(none, weights).withColumn("positive", F.lit(1))) == learn.Curve(1.0, 0.0)

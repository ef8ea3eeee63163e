"""The join on keyword and time bin: equal to brute force, candidates independent of past jobs."""

import random

import pytest
from fixture_values import seconds
from pyspark.sql import functions as F

from sentispark.operators import match

JOBS = "job_id string, keywords array<string>, started_at timestamp_ntz, ends_at timestamp_ntz"


def brute(posts, jobs):
    found = set()
    for p, text, at in posts:
        for j, keywords, begin, end in jobs:
            inside = at is not None and begin is not None and begin <= at and (end is None or at < end)
            if inside and set(text.split()) & set(keywords):
                found.add((p, j))
    return found


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_interval_join_equals_brute_force(spark, strategy):
    rng = random.Random(3)
    words = ["tea", "coffee", "milk", "water", "wine"]
    posts = [(k, " ".join(rng.choices(words, k=3)), seconds(rng.randint(-50, 1000))) for k in range(150)] + [(999, "tea", None)]
    jobs = []
    for k in range(60):
        begin = rng.randint(-100, 900)
        length = rng.choice([0, 1, 10, 10, 20, 30, 100_000, None, -5])
        jobs.append((f"j{k}", rng.sample(words, 2), seconds(begin), None if length is None else seconds(begin + length)))
    jobs += [("unstarted", ["tea"], None, None), ("on a border", ["tea"], seconds(0), seconds(10))]
    posts += [(1000, "tea", seconds(0)), (1001, "tea", seconds(10)), (1002, "tea", seconds(9.999999))]
    found = match.match_pairs(
        spark.createDataFrame(posts, "post_id int, text string, at timestamp_ntz"), spark.createDataFrame(jobs, JOBS), event_time="at", strategy=strategy
    )
    got = [(r["post_id"], r["job_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(posts, jobs)


def test_jobs_without_end_and_without_jobs(spark):
    posts = spark.createDataFrame([(1, "tea", seconds(5))], "post_id int, text string, at timestamp_ntz")
    jobs = spark.createDataFrame([("open", ["tea"], seconds(0), None), ("later", ["tea"], seconds(9), None)], JOBS)
    assert [r["job_id"] for r in match.match_pairs(posts, jobs, event_time="at").collect()] == ["open"]
    assert match.match_pairs(posts, jobs.limit(0), event_time="at").count() == 0


def test_candidates_do_not_grow_with_past_jobs(spark):
    counts = []
    for many in (50, 500):
        jobs = spark.createDataFrame([(f"j{k}", ["tea"], seconds(-60 * k), seconds(-60 * k + 60)) for k in range(many)], JOBS)
        index = match.binned_index(match.keyword_index(jobs, ["started_at", "ends_at"]), match.bin_width(jobs))
        now = F.floor(F.unix_micros(F.lit(str(seconds(30))).cast("timestamp")) / F.lit(match.bin_width(jobs)))
        counts.append(index.filter((F.col("_bin") == now) & (F.col("_keyword") == "tea")).count())
    assert counts[0] == counts[1] <= 2


def test_long_intervals_do_not_multiply_the_index(spark):
    spans = [(f"j{k}", ["tea"], seconds(0), seconds(1)) for k in range(100)] + [("ages", ["tea"], seconds(0), seconds(10**8))]
    jobs = spark.createDataFrame(spans, JOBS)
    index = match.keyword_index(jobs, ["started_at", "ends_at"])
    assert match.binned_index(index, match.bin_width(jobs)).count() <= 2 * len(spans)
    assert match.binned_index(index, 1_000_000).filter("_bin IS NULL").count() == 1


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_listed_matches_are_those_of_the_pairs(spark, strategy):
    posts = [("a", "tea milk", 0), ("a", "tea milk", 0), ("b", "Wine, tea", 5), ("c", "", 5), ("d", None, 5), ("e", "milk", None)]
    jobs = [("x", ["tea", "milk"], 0, 3), ("y", ["tea"], 0, None), (None, ["milk", "wine"], 0, 99), ("z", [], 0, None), ("w", None, 0, None)]
    table = spark.createDataFrame([(j, k, seconds(b), None if e is None else seconds(e)) for j, k, b, e in jobs], JOBS)
    texts = spark.createDataFrame([(p, t, None if at is None else seconds(at)) for p, t, at in posts], "post_id string, text string, ts timestamp")
    for at in (None, "ts"):
        pairs = match.match_pairs(texts, table, event_time=at, strategy=strategy).collect()
        lists = match.match_pairs(texts, table, event_time=at, strategy=strategy, listed=True).collect()
        assert len({r["post_id"] for r in lists}) == len(lists) > 0
        order = lambda pair: (pair[0], pair[1] or "")
        assert sorted([(r["post_id"], j) for r in lists for j in r["jobs"]], key=order) == sorted([(r["post_id"], r["job_id"]) for r in pairs], key=order)
    assert {r["post_id"] for r in lists} == {"a", "b"}

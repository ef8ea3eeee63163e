"""Pages from the inverted index equal those of a scan and read little of it."""

import random

import pytest
from fixture_values import seconds
from pyspark.sql import functions as F

from sentispark.session import fresh_dir
from sentispark.sources import search, search_index

SCHEMA = "uri string, text string, langs array<string>, created_at timestamp_ntz, like_count long, repost_count long, reply_count long"
WORDS = ["the"] * 30 + ["rare", "Coffee", "coffee", "tea", "x_1", "naïve", "KELVIN", "the-end", "42"]


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))
        langs = rng.choice([["en"], ["fr", "en"], ["de"], [], None])
        rows.append((f"at://{k:05d}", text, langs, seconds(rng.randint(0, 500)), rng.randint(0, 40), rng.choice([None, 1, 9]), None))
    rows += [("at://none", None, None, None, None, None, None), ("at://blank", "", ["en"], seconds(3), 999, 1, 1), ("at://untimed", "rare tea", ["en"], None, 3, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(spark, posts):
    path = fresh_dir(spark, "index")
    for batch in range(3):
        for _ in range(2 if batch == 1 else 1):  # one batch runs again
            search_index.index_posts(posts.filter(F.pmod(F.xxhash64("uri"), F.lit(3)) == batch), path, batch, block=32)
    return path


@pytest.mark.parametrize("query", ["rare", "the", "coffee tea", "THE rare", "x_1, 42!", "naïve", "absent", "", "--"])
@pytest.mark.parametrize("sort", search_index.SORTS)
def test_pages_equal_those_of_a_scan(spark, posts, index, query, sort):
    cursor = None
    for page in range(3):
        want = [(r["uri"], r["sort_key"]) for r in search.search_posts(posts, query, 25, cursor, sort).collect()]
        got = [(r["uri"], r["sort_key"]) for r in search_index.search_pages(spark, index, query, 25, cursor, sort).collect()]
        assert got == want, (query, sort, page)
        if len(want) < 25 or want[-1][1] is None:
            break
        cursor = want[-1][::-1]


@pytest.mark.parametrize("lang", [None, "en"])
def test_filtered_pages_equal_those_of_a_scan(spark, posts, index, lang):
    since, until = F.lit(str(seconds(100))).cast("timestamp_ntz"), F.lit(str(seconds(130))).cast("timestamp_ntz")
    for options in ({"since": since}, {"until": until}, {"since": since, "until": until}, {}):
        for sort in search_index.SORTS:
            want = search.search_posts(posts, "the rare", 40, sort=sort, lang=lang, **options).select("uri", "sort_key").collect()
            got = search_index.search_pages(spark, index, "the rare", 40, sort=sort, lang=lang, **options).collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_a_page_reads_a_fraction_of_the_postings(spark, posts, index, monkeypatch):
    read = []
    original = search_index._rows_of
    monkeypatch.setattr(search_index, "_rows_of", lambda blocks, *a: read.append(blocks.agg(F.sum("size")).first()[0] or 0) or original(blocks, *a))
    page = search_index.search_pages(spark, index, "the", 25, sort="latest")
    assert page.count() == 25
    matching = search.search_posts(posts, "the", 10_000, sort="latest").count()
    assert sum(read) < 0.25 * matching
    # A later page passes over the blocks before its cursor.
    read.clear()
    deep = search.search_posts(posts, "the", 1000, sort="latest").collect()[-1]
    search_index.search_pages(spark, index, "the", 25, (deep["sort_key"], deep["uri"]), "latest").count()
    assert sum(read) < 0.25 * matching


def test_no_index_and_no_posts(spark, posts):
    path = fresh_dir(spark, "index")
    with pytest.raises(ValueError):
        search_index.search_pages(spark, path, "tea")
    search_index.index_posts(posts.limit(0), path)
    assert search_index.search_pages(spark, path, "tea").count() == 0


def test_blocks_are_full_ordered_and_never_shuffled(spark, monkeypatch):
    """Posts go to ranges with their words; what is written are blocks made in these tasks."""
    rows = [(f"at://{k:04d}", "the tea" if k % 2 else "the x_1 the", ["en"], seconds(k % 7), k % 5, None, None) for k in range(300)]
    rows += [rows[0], ("at://null", "tea", None, None, None, None, None), (None, "tea the", [None], seconds(1), 2, None, None)]
    written = []
    original = search_index.chunks.append
    monkeypatch.setattr(search_index.chunks, "append", lambda blocks, *a: written.append(blocks) or original(blocks, *a))
    monkeypatch.setattr(search_index, "POSTINGS", 100)
    path = fresh_dir(spark, "index")
    search_index.index_posts(spark.createDataFrame(rows, SCHEMA), path, 0, block=32)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(sort" in plan
    stored = search_index.chunks.read_table(spark, path).collect()
    for sort in search_index.SORTS:
        for word, n in (("the", 302), ("tea", 152), ("x_1", 151)):
            blocks = [r for r in stored if (r["sort"], r["token"]) == (sort, word)]
            assert sum(r["size"] for r in blocks) == n == sum(len(r["postings"]) for r in blocks)
            for r in blocks:
                keys = [p["key"] for p in r["postings"]]
                known = [k for k in keys if k is not None]
                assert len(keys) <= 32 and keys == sorted(known, reverse=True) + [None] * (len(keys) - len(known))
                assert (r["best"], r["worst"]) == ((known[0], known[-1]) if known else (None, None))

"""An inverted index for search pages: the postings of a word, best first, in blocks.

A block is a row: up to ``BLOCK`` posts of one word in the order of a sort key, with the best and the worst key in it. Words
of many posts have many blocks and no group larger than one. A page needs the blocks whose best key can still
enter it: they are read from the best down, a few and then four times as many, until the last row of the page is no worse
than the best of all that is unread. Matching, filters and order are those of ``search.search_posts``.

The index is a chunked table: posts are added batch by batch, each with blocks of its own. Posts go to ranges of a sort key
with all their words, once per sort key, and the tasks of the ranges make the blocks: postings are never shuffled, and those of a
file come from few posts, so addresses and times are small in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.functions.keywords import token_set
from sentispark.session import materialize
from sentispark.sources import chunks
from sentispark.sources.search import engagement

BLOCK = 1024
SORTS = ("top", "latest")
POSTINGS = 1 << 20  # postings of a task
_LAYOUT = chunks.Layout("sort", ("token", "best"))
_POST = "struct<key: bigint, uri: string, created: bigint, langs: array<string>>"
_FIRST = 4  # blocks of a word that are read at first


def _sort_key(sort: str) -> Column:
    return engagement().cast("long") if sort == "top" else F.unix_micros(F.col("created_at").cast("timestamp"))


def _blocks_of(block: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of up to ``block`` posts per word from posts in order; posts of an Arrow batch of some ``POSTINGS`` share blocks."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.sum(pc.count_substring(batch["words"], " ")).as_py() + batch.num_rows
            step = max(1, batch.num_rows * most // words)
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batch for batch in batches if batch.num_rows):
            lists = pc.split_pattern(batch["words"], " ")
            posts, words = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
            sorts = batch["sort"].dictionary_encode()
            group = sorts.indices.to_numpy()[posts].astype("int64") * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            group = group[order]
            at = np.arange(len(group))
            first = np.r_[True, group[1:] != group[:-1]]
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) % block == 0)
            rows = batch.select(["key", "uri", "created", "langs"]).take(pa.array(posts[order]))
            postings = pa.StructArray.from_arrays(rows.columns, rows.schema.names)
            yield pa.RecordBatch.from_arrays(
                [
                    sorts.dictionary.take(pa.array(group[starts] // len(words.dictionary))),
                    words.dictionary.take(pa.array(group[starts] % len(words.dictionary))),
                    pa.ListArray.from_arrays(pa.array(np.r_[starts, len(group)], pa.int32()), postings),
                ],
                ["sort", "token", "postings"],
            )

    return run


def index_posts(posts: DataFrame, path: str, batch: int | None = None, block: int = BLOCK) -> None:
    """Add posts (uri, text, created_at, langs, like_count, repost_count, reply_count) to the index at ``path``.

    Every post counts once per word, with both sort keys as they are now. The distinct words of a post are shuffled, as one
    string, once per sort key. A post without a sort key comes last, as in a scan.
    """
    # Written once: texts are cut once, for the size, the bounds of the ranges and the rows.
    cut = materialize(
        posts.select(
            "uri",
            F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"),
            "langs",
            *[_sort_key(s).alias(s) for s in SORTS],
            F.array_join(token_set("text"), " ").alias("words"),
        ).filter("words <> ''")
    )
    held = cut.agg(F.sum(F.regexp_count("words", F.lit(" ")) + F.lit(1)).alias("n")).first()["n"] or 0
    keys = F.explode(F.array(*[F.struct(F.lit(s).alias("sort"), F.col(s).alias("key")) for s in SORTS]))
    rows = cut.withColumn("_sorted", keys).select("_sorted.sort", "_sorted.key", "uri", "created", "langs", "words")
    order = ["sort", F.col("key").desc_nulls_last(), "uri"]
    ranged = rows.repartitionByRange(1 + len(SORTS) * held // POSTINGS, *order).sortWithinPartitions(*order)
    blocks = ranged.mapInArrow(_blocks_of(block, POSTINGS), f"sort string, token string, postings array<{_POST}>").select(
        "sort",
        "token",
        F.array_max("postings.key").alias("best"),
        F.array_min("postings.key").alias("worst"),
        F.array_max("postings.created").alias("newest"),
        F.array_min("postings.created").alias("oldest"),
        F.size("postings").cast("long").alias("size"),
        "postings",
    )
    chunks.append(blocks, path, _LAYOUT, batch)


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def relevant_blocks(
    spark: SparkSession, path: str, query: str, cursor: tuple | None, sort: str, since: Column | None, until: Column | None
) -> DataFrame:
    """Blocks of the query's words that may hold a row after ``cursor`` and within the times."""
    rows = chunks.read_table(spark, path)
    if rows is None:
        raise ValueError(f"no index at {path}")
    words = sorted({w.lower() for w in re.findall("[A-Za-z0-9_]+", query)})
    found = rows.filter((F.col("sort") == sort) & (F.col("token").isin(*words) if words else F.lit(False)))
    if cursor is not None:
        found = found.filter(F.col("worst") <= F.lit(cursor[0]))
    if since is not None:
        found = found.filter(F.col("newest") >= _micros(since))
    if until is not None:
        found = found.filter(F.col("oldest") < _micros(until))
    return found


def _rows_of(blocks: DataFrame, cursor: tuple | None, since: Column | None, until: Column | None, lang: str | None) -> DataFrame:
    rows = blocks.select(F.explode("postings").alias("p")).select("p.uri", F.col("p.key").alias("sort_key"), "p.created", "p.langs")
    if since is not None:
        rows = rows.filter(F.col("created") >= _micros(since))
    if until is not None:
        rows = rows.filter(F.col("created") < _micros(until))
    if lang is not None:
        rows = rows.filter(F.array_contains("langs", lang))
    if cursor is not None:
        key, uri = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.filter((F.col("sort_key") < key) | ((F.col("sort_key") == key) & (F.col("uri") > uri)))
    # A post with several of the words is in several blocks.
    return rows.select("uri", "sort_key").distinct()


def search_pages(
    spark: SparkSession,
    path: str,
    query: str,
    limit: int = 25,
    cursor: tuple | None = None,
    sort: str = "top",
    since: Column | None = None,
    until: Column | None = None,
    lang: str | None = None,
) -> DataFrame:
    """(uri, sort_key) of one page: the posts that ``search.search_posts`` finds with the same arguments.

    Rows without a sort key are on a page only when no others are left. Building the page runs a few small jobs, which
    find out how far down the blocks have to be read.
    """
    blocks = relevant_blocks(spark, path, query, cursor, sort, since, until)
    words = max(1, len(set(re.findall("[a-z0-9_]+", query.lower()))))
    order = [F.col("sort_key").desc(), F.col("uri")]
    many = _FIRST * words
    while True:
        heads = blocks.select("best").orderBy(F.col("best").desc_nulls_last()).limit(many).collect()
        bound = heads[-1]["best"] if len(heads) == many else None
        # All blocks from the bound up; without a bound all there are.
        read = blocks if bound is None else blocks.filter(F.col("best") >= F.lit(bound))
        page = _rows_of(read, cursor, since, until, lang).orderBy(*order).limit(limit)
        if bound is None:
            return page
        last = page.agg(F.count(F.lit(1)).alias("n"), F.min("sort_key").alias("key")).first()
        if last["n"] == limit and last["key"] is not None and last["key"] >= bound:
            return page
        many *= 4

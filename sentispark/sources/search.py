"""Search over a table of posts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_records(posts: DataFrame) -> DataFrame:
    """Add ``reason`` (null when usable), ``text``, ``created_at`` and ``langs``.

    ``record`` is the JSON of the post. It must be an object with a string ``createdAt`` and,
    if present, a string ``text``; a missing text counts as '', a null one is no string. Only the
    record's own fields count, however their names are written; it is parsed once.
    """
    record = F.col("_record")

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(record, path, "variant"))

    created = F.try_variant_get(record, "$.createdAt", "string")
    text = F.try_variant_get(record, "$.text", "string")
    is_object = F.coalesce(F.startswith(kind("$"), F.lit("OBJECT")), F.lit(False))
    has_created = F.coalesce((kind("$.createdAt") == "STRING") & (created != ""), F.lit(False))
    reason = (
        F.when(~is_object, "record absent")
        .when(~has_created, "createdAt missing")
        .when(kind("$.text") != "STRING", "text not a string")
    )
    return posts.withColumn("_record", F.try_parse_json("record")).select(
        *posts.columns,
        reason.alias("reason"),
        F.coalesce(text, F.lit("")).alias("text"),
        created.alias("created_at"),
        F.try_variant_get(record, "$.langs", "array<string>").alias("langs"),
    )


def engagement() -> Column:
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("like_count", "repost_count", "reply_count")]
    return parts[0] + parts[1] + parts[2]


def any_word_pattern(query: str) -> str:
    """Pattern for any ASCII word of a query; compiled once, as it is a literal."""
    words = re.findall("[A-Za-z0-9_]+", query)
    if not words:
        return "(?!)"
    return f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def search_posts(
    posts: DataFrame,
    query: str,
    limit: int = 25,
    cursor: tuple | None = None,
    sort: str = "top",
    since: Column | None = None,
    until: Column | None = None,
    lang: str | None = None,
) -> DataFrame:
    """One page of the posts that contain any word of ``query`` as a whole word.

    ``top`` ranks by likes + reposts + replies, ``latest`` by creation; ties go by ``uri``. The
    cursor is the (sort key, uri) of the last row of the page before, so a page never depends
    on how many rows came earlier. The page comes out of a top-k, not of a full sort.
    """
    found = posts.filter(F.col("text").rlike(any_word_pattern(query)))
    if since is not None:
        found = found.filter(F.col("created_at") >= since)
    if until is not None:
        found = found.filter(F.col("created_at") < until)
    if lang is not None:
        found = found.filter(F.array_contains("langs", lang))
    key = engagement().cast("long") if sort == "top" else F.unix_micros(F.col("created_at").cast("timestamp"))
    found = found.withColumn("sort_key", key)
    if cursor is not None:
        last_key, last_uri = cursor
        found = found.filter(
            (F.col("sort_key") < F.lit(last_key))
            | ((F.col("sort_key") == F.lit(last_key)) & (F.col("uri") > F.lit(last_uri)))
        )
    return found.orderBy(F.col("sort_key").desc(), F.col("uri")).limit(limit)


def search_posts_since(posts: DataFrame, query: str, since: Column, **options) -> DataFrame:
    """Posts from ``since`` on, for polling."""
    return search_posts(posts, query, since=since, **options)

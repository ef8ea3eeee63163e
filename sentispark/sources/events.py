"""Raw post events: scan, replay, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentispark.scale import join_per_key
from sentispark.schemas import POST_COLLECTION, RAW_EVENT


def read_lines(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int = 64):
    """Event lines as one string column ``value``."""
    if streaming:
        return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return spark.read.text(path)


def parse_events(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Parse event lines; keeps ``raw`` and marks unreadable ones in ``corrupt``."""
    schema = T.StructType([*RAW_EVENT.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(
        F.col(raw),
        schema,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return lines.withColumn("_event", parsed).select(
        *lines.columns,
        *[F.col(f"_event.{f}").alias(f) for f in RAW_EVENT.fieldNames()],
        (F.col("_event").isNull() | F.col("_event._corrupt").isNotNull()).alias("corrupt"),
    )


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return parse_events(read_lines(spark, path, streaming))


def good_events(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("corrupt"))


def quarantined(events: DataFrame, raw: str = "value") -> DataFrame:
    return events.filter("corrupt").select(F.col(raw).alias("raw"), F.lit("malformed json").alias("reason"))


def replay_from(events: DataFrame, cursor_us: int) -> DataFrame:
    """Events after a stored position."""
    return events.filter(F.col("time_us") > F.lit(cursor_us))


def last_position(events: DataFrame, arrival: str | None = None) -> DataFrame:
    """Position after reading ``events``: every readable event with a non-zero time moves it.

    With an ``arrival`` column the position is that of the last arrived event, else the latest.
    """
    seen = events.filter(~F.col("corrupt") & (F.col("time_us") != 0))
    position = F.max_by("time_us", arrival) if arrival else F.max("time_us")
    return seen.agg(position.alias("cursor_us"))


def is_post_creation() -> Column:
    commit = F.col("commit")
    return (
        (F.col("kind") == "commit")
        & (commit["operation"] == "create")
        & (commit["collection"] == POST_COLLECTION)
        & (F.length(commit["record"]["text"]) > 0)
    )


def post_creations(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("corrupt") & is_post_creation())


def restrict(
    events: DataFrame,
    collections: list[str] | None = None,
    authors: DataFrame | None = None,
    max_bytes: int = 0,
    raw: str = "value",
) -> DataFrame:
    """Wanted collections, wanted authors (a ``did`` table) and message size; unset = no limit.

    As at the source, a collection list applies to commits only.
    """
    out = events
    if collections:
        out = out.filter(
            (F.col("kind") != "commit") | F.col("commit.collection").isin(*collections)
        )
    if max_bytes > 0:
        out = out.filter(F.octet_length(raw) <= max_bytes)
    if authors is not None:
        out = join_per_key(out, authors.select("did").distinct(), "did", "left_semi")
    return out

"""Reading position for batch replays; streams keep theirs in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentispark.sources.events import good_events, last_position, replay_from
from sentispark.sources.store import stored_rows


def load_position(spark: SparkSession, path: str) -> int | None:
    stored = stored_rows(spark, path)
    row = None if stored is None else stored.first()
    return None if row is None else row["cursor_us"]


def save_position(spark: SparkSession, path: str, cursor_us: int) -> bool:
    """Store the position; an unchanged one is not written again."""
    if load_position(spark, path) == cursor_us:
        return False
    spark.createDataFrame([(cursor_us,)], "cursor_us long").coalesce(1).write.mode("overwrite").parquet(path)
    return True


def clear_position(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "cursor_us long").coalesce(1).write.mode("overwrite").parquet(path)


def next_events(events: DataFrame, path: str) -> tuple[DataFrame, int | None]:
    """Readable events after the stored position, and the position to save once they are done."""
    spark = events.sparkSession
    since = load_position(spark, path)
    fresh = good_events(events) if since is None else replay_from(good_events(events), since)
    latest = last_position(fresh).first()["cursor_us"]
    return fresh, latest if latest is not None else since

"""Browse scored rows: filter, sort, page, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.functions.text import safe_url, strip_html, trim_space, truncate_text

PAGE = 25


def filter_posts(rows: DataFrame, label: str = "all", query: str = "") -> DataFrame:
    """Rows of one label (or all) whose text or author contains ``query``, ignoring case."""
    out = rows if label == "all" else rows.filter(F.col("sentiment_label") == label)
    needle = F.lower(trim_space(F.lit(query)))
    found = F.lower("text_content").contains(needle) | F.coalesce(
        F.lower("author_name").contains(needle), F.lit(False)
    )
    return out.filter((needle == "") | found)


def sort_key(mode: str) -> Column:
    """Ascending key of a sort mode; a missing time sorts as the epoch."""
    if mode == "newest":
        return -F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))
    score = F.col("sentiment_score").cast("double")
    return {"most-positive": -score, "most-negative": score}[mode]


def sort_posts(rows: DataFrame, mode: str = "newest", seq: str = "seq") -> DataFrame:
    """Sorted rows; ties keep the input order given by the unique column ``seq``."""
    return rows.orderBy(sort_key(mode), F.col(seq))


def first_posts(rows: DataFrame, n: int, mode: str = "newest", seq: str = "seq") -> DataFrame:
    """The first n rows, by a top-k over the tasks instead of a full sort."""
    return sort_posts(rows, mode, seq).limit(n)


def paged_view(
    rows: DataFrame,
    mode: str = "newest",
    visible: int = PAGE,
    selected: Column | None = None,
    seq: str = "seq",
) -> DataFrame:
    """The visible rows plus ``has_more``, extended to include a selected row.

    The page ends at a sort key: that of the last visible row or that of the selected row,
    whichever is later. Both are single-row aggregates, so no row number over the whole table
    is needed, and rows beyond the page are only counted.
    """
    keyed = rows.withColumn("_key", F.struct(sort_key(mode).alias("k"), F.col(seq).alias("s")))
    last_visible = keyed.select("_key").orderBy("_key").limit(visible).agg(F.max("_key").alias("end"))
    if selected is None:
        ends = last_visible
    else:
        chosen = keyed.filter(selected).agg(F.max("_key").alias("end"))
        ends = last_visible.unionByName(chosen).agg(F.max("end").alias("end"))
    end = ends.first()["end"]
    if end is None:
        return rows.limit(0).withColumn("has_more", F.lit(False))
    beyond = (F.col("_key.k") > F.lit(end["k"])) | (
        (F.col("_key.k") == F.lit(end["k"])) & (F.col("_key.s") > F.lit(end["s"]))
    )
    has_more = not keyed.filter(beyond).isEmpty()
    return keyed.filter(~beyond).drop("_key").withColumn("has_more", F.lit(has_more))


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 10) -> DataFrame:
    """One page of a list, counted from 1."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def jobs_of(jobs: DataFrame, user_id, job_id=None) -> DataFrame:
    """Jobs of one user, or one job if it belongs to that user."""
    out = jobs.filter(F.col("user_id") == user_id)
    return out if job_id is None else out.filter(F.col("job_id") == job_id)


def newest_jobs(jobs: DataFrame, user_id) -> DataFrame:
    return jobs_of(jobs, user_id).orderBy(F.col("created_at").desc())


def snippets(rows: DataFrame, limit: int = 120) -> DataFrame:
    """Card view of the rows: plain text cut to ``limit``, shown author, safe address."""
    plain = strip_html("text_content")
    author = F.coalesce(F.when(F.length("author_name") > 0, F.col("author_name")), F.lit("anonymous"))
    return rows.select(
        "id",
        truncate_text(plain, limit).alias("snippet"),
        (F.length(plain) > limit).alias("expandable"),
        author.alias("author"),
        safe_url("source_url").alias("link"),
    )

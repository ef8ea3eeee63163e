"""Match posts against the keywords of all jobs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.functions.keywords import (
    anchor_token,
    extract_keywords,
    gap_set,
    is_plain,
    keyword_pattern,
    token_set,
)
from sentispark.scale import BROADCAST_BYTES, SALTS, fits_broadcast

DEFAULT_DURATION_MS = 120_000
#: Bins up to which an interval is cut.
MOST_BINS = 64


def active_jobs(
    jobs: DataFrame,
    prompt: str = "prompt",
    started_at: str | None = None,
    max_duration_ms: Column | int = DEFAULT_DURATION_MS,
    cancelled_at: Column | None = None,
    max_keywords: int | None = None,
) -> DataFrame:
    """Jobs with their keywords and, if started, the interval in which they count posts.

    All keywords of a prompt count unless ``max_keywords`` limits them. The interval ends after ``max_duration_ms`` (0 = never) or at the cancellation.
    """
    out = jobs.withColumn("keywords", F.array_distinct(extract_keywords(prompt, max_keywords)))
    if started_at is None:
        return out
    duration = max_duration_ms if isinstance(max_duration_ms, Column) else F.lit(max_duration_ms)
    begin = F.col(started_at).cast("timestamp_ntz")
    timed_end = F.when(
        duration > 0, begin + F.make_dt_interval(secs=(duration / F.lit(1000)).cast("decimal(18,6)"))
    )
    end = timed_end if cancelled_at is None else F.least(timed_end, cancelled_at.cast("timestamp_ntz"))
    return out.withColumns({"started_at": begin, "ends_at": end})


def _in_interval(at: Column) -> Column:
    at = at.cast("timestamp_ntz")
    return (at >= F.col("started_at")) & (F.col("ends_at").isNull() | (at < F.col("ends_at")))


def keyword_index(jobs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per job and keyword."""
    # explode_outer: explode would compute the keywords again in an inferred filter.
    return jobs.select(
        "job_id", *columns, F.explode_outer(F.array_distinct("keywords")).alias("_keyword")
    ).filter(F.col("_keyword").isNotNull())


def bin_width(jobs: DataFrame) -> int | None:
    """Microseconds of a time bin: the mean length of the bounded intervals, so that an interval lies in about two bins.

    None if no interval is bounded.
    """
    length = F.unix_micros(F.col("ends_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    mean = jobs.agg(F.avg(F.when(length > 0, length)).alias("mean")).first()["mean"]
    return None if mean is None else max(int(mean), 1)


def binned_index(index: DataFrame, width: int | None) -> DataFrame:
    """The index with ``_bin``: a row per time bin that an interval meets, or one without a bin.

    Without a bin are intervals that never end and those of more than ``MOST_BINS`` bins, so the index grows with the number of
    jobs only. An empty interval matches nothing and has no row.
    """
    begin, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("started_at", "ends_at"))
    some = index.filter(F.col("started_at").isNotNull() & (F.col("ends_at").isNull() | (F.col("ends_at") > F.col("started_at"))))
    if width is None:
        return some.withColumn("_bin", F.lit(None).cast("long"))
    first, last = F.floor(begin / F.lit(width)), F.floor((end - F.lit(1)) / F.lit(width))
    bins = F.when(F.col("ends_at").isNull() | (last - first >= MOST_BINS), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(first, last))
    return some.withColumn("_bin", F.explode(bins))


def match_pairs(
    posts: DataFrame,
    jobs: DataFrame,
    key: str = "post_id",
    text: str = "text",
    event_time: str | None = None,
    keep: tuple[str, ...] = (),
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    words: str | None = None,
    listed: bool = False,
) -> DataFrame:
    """One (key, *keep, job_id) row per post and job where any keyword is a whole word of the post.

    With ``listed`` one row per post, with all its jobs in ``jobs`` in the place of ``job_id``. By broadcast and without intervals
    a token then meets one row with all jobs of its keyword, and a post puts together a list per keyword, however often it comes.

    ``jobs`` has ``job_id`` and ``keywords`` ([a-z0-9_] only, as ``extract_keywords`` yields),
    plus the interval columns when ``event_time`` is given. ``keep`` names narrow columns of the
    posts. Every post is cut into its distinct tokens, which meet the keywords in an equi-join.
    The text itself is never shuffled. ``words`` names a ready ``word_list`` column, if any.

    With ``event_time`` the join is on keyword and time bin, so a post meets the jobs of its own time and not all that
    ever had its word; jobs without end are met by the keyword alone.

    * ``broadcast``: the measured keyword table goes to the tasks, so tokens never leave the task
      that read the post; all keywords of a pair meet there too, so the distinct step has
      removed the repeats before its shuffle.
    * ``shuffle``: (key, token) rows are shuffled, salted so that a word found in a third of the
      posts is spread over many tasks.
    """
    interval = ["started_at", "ends_at"] if event_time else []
    index = keyword_index(jobs, interval)
    if strategy == "auto":
        strategy = "broadcast" if fits_broadcast(index, broadcast_bytes) else "shuffle"
    at = [event_time] if event_time and event_time not in keep else []
    distinct_words = F.array_distinct(words) if words else token_set(text)
    tokens = posts.select(key, *keep, *at, F.explode_outer(distinct_words).alias("_token"))
    same = F.col("_token") == F.col("_keyword")
    if listed and not event_time and strategy == "broadcast":
        by_keyword = index.groupBy("_keyword").agg(_listed("job_id").alias("_jobs"))
        lists = _joined(tokens, by_keyword, same, strategy, key).groupBy(key, *keep).agg(F.collect_set("_jobs").alias("_lists"))
        return lists.select(key, *keep, F.array_distinct(F.flatten("_lists")).alias("jobs"))
    if listed:
        pairs = match_pairs(posts, jobs, key, text, event_time, keep, strategy, broadcast_bytes, words)
        return pairs.groupBy(key, *keep).agg(_listed("job_id").alias("jobs"))
    if not event_time:
        return _joined(tokens, index, same, strategy, key).select(key, *keep, "job_id").distinct()
    width = bin_width(jobs)
    binned = binned_index(index, width)
    here = _in_interval(F.col(event_time))
    pairs = _joined(tokens, binned.filter(F.col("_bin").isNull()).drop("_bin"), same & here, strategy, key).select(key, *keep, "job_id")
    if width is not None:
        time = F.unix_micros(F.col(event_time).cast("timestamp"))
        timed = tokens.withColumn("_time_bin", F.floor(time / F.lit(width)))
        on = same & (F.col("_time_bin") == F.col("_bin")) & here
        near = _joined(timed, binned.filter(F.col("_bin").isNotNull()), on, strategy, key)
        pairs = pairs.unionByName(near.select(key, *keep, "job_id"))
    return pairs.distinct()


def _listed(column: str) -> Column:
    """All values of a group, nulls too, which a list leaves out."""
    return F.transform(F.collect_list(F.struct(column)), lambda one: one[column])


def _joined(tokens: DataFrame, index: DataFrame, on: Column, strategy: str, key: str) -> DataFrame:
    if strategy == "broadcast":
        return tokens.join(F.broadcast(index), on)
    tokens, index, same_salt = _salted(tokens, index, key)
    return tokens.join(index, on & same_salt)


def _salted(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, Column]:
    """Spread equal join values of ``left`` over SALTS tasks by its key; ``right`` is repeated."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left, right, F.col("_salt") == F.col("_copy")


def match_posts(posts: DataFrame, jobs: DataFrame, key: str = "post_id", **options) -> DataFrame:
    """``match_pairs`` with all columns of the posts; ``key`` must be unique among the posts."""
    pairs = match_pairs(posts, jobs, key, **options).select(key, "job_id")
    return posts.join(pairs, key).select(*posts.columns, "job_id")


def match_literals(
    posts: DataFrame,
    jobs: DataFrame,
    key: str = "post_id",
    text: str = "text",
    strategy: str = "auto",
) -> DataFrame:
    """As ``match_posts`` for keywords with punctuation or accents; returns (key, job_id).

    No theta join: every keyword has an anchor that any matching text must contain as a token,
    so an equi-join on the anchor proposes the pairs and the pattern decides them.
    """
    index = (
        keyword_index(jobs, [])
        .filter(F.length("_keyword") > 0)
        .select(
            "job_id",
            anchor_token(F.col("_keyword")).alias("_anchor"),
            is_plain(F.col("_keyword")).alias("_plain"),
            keyword_pattern(F.array("_keyword")).alias("_pattern"),
        )
    )
    anchors = F.explode_outer(F.array_union(token_set(text), gap_set(text))).alias("_token")
    hit = F.col("_plain") | F.regexp_like(text, F.col("_pattern"))
    on = F.col("_token") == F.col("_anchor")
    if strategy == "auto":
        strategy = "broadcast" if fits_broadcast(index) else "shuffle"
    if strategy == "broadcast":
        pairs = posts.select(key, text, anchors).join(F.broadcast(index), on)
    else:
        tokens, index, same_salt = _salted(posts.select(key, anchors), index, key)
        proposed = tokens.join(index, on & same_salt).select(key, "job_id", "_plain", "_pattern")
        pairs = proposed.join(posts.select(key, text), key)
    return pairs.filter(hit).select(key, "job_id").distinct()


def match_statistics(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Matched posts per registered job, 0 for a job without any."""
    counts = matches.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        jobs.select("job_id")
        .join(counts, "job_id", "left")
        .select("job_id", F.coalesce("_n", F.lit(0)).alias("matched_count"))
    )


def match_totals(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: posts matched over all jobs, number of jobs."""
    return match_statistics(matches, jobs).agg(
        F.sum("matched_count").alias("total_matched"), F.count(F.lit(1)).alias("active_jobs")
    )


def expired_jobs(jobs: DataFrame, matches: DataFrame, as_of: Column) -> DataFrame:
    """Jobs whose time is over at ``as_of``, with what they matched (the batch form of expiry)."""
    over = jobs.filter(F.col("ends_at") <= as_of.cast("timestamp_ntz"))
    counts = matches.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    return over.join(counts, "job_id", "left").select(
        "job_id",
        F.coalesce("_n", F.lit(0)).alias("total_items"),
        F.col("ends_at").alias("completed_at"),
    )

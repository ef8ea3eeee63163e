"""Per-job results: counts, averages, distributions, headline statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.functions.labels import LIVE_BAND, score_label
from sentispark.functions.numeric import (
    SCORE_UNIT,
    epoch_ms,
    mean_score,
    percent_of,
    round_half_up,
    score_units,
    units_mean,
)
from sentispark.scale import join_per_key
from sentispark.schemas import LABELS
from sentispark.session import materialize

SCORE = "sentiment_score"
LABEL = "sentiment_label"


def count_per_job(rows: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Rows per job; with ``jobs``, 0 for those without rows."""
    counts = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("data_points"))
    if jobs is None:
        return counts
    return jobs.select("job_id").join(counts, "job_id", "left").fillna(0, ["data_points"])


def average_per_job(rows: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Average score per job; with ``jobs``, null for those without rows."""
    averages = rows.groupBy("job_id").agg(mean_score(SCORE).alias("average_sentiment"))
    return averages if jobs is None else jobs.select("job_id").join(averages, "job_id", "left")


def label_distribution(rows: DataFrame) -> DataFrame:
    """Only the labels that occur."""
    return rows.groupBy("job_id", F.col(LABEL).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def _label_counts(label: Column) -> list[Column]:
    return [F.count_if(label == name).alias(name) for name in LABELS]


def distribution_pivot(rows: DataFrame) -> DataFrame:
    """One row per job with a count for each label; unknown labels are ignored."""
    return rows.groupBy("job_id").agg(*_label_counts(F.col(LABEL)))


def pivot_distribution(distribution: DataFrame) -> DataFrame:
    """The same from an aggregated (job, label, count) table."""
    return distribution.groupBy("job_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("label") == n, F.col("count"))), F.lit(0)).alias(n)
            for n in LABELS
        ]
    )


def nss(positive: Column, neutral: Column, negative: Column) -> Column:
    """Net sentiment score, -100..100; 0 without rows."""
    total = positive + neutral + negative
    return (
        F.when(total > 0, round_half_up((positive - negative) / total * F.lit(100.0)))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _nss_columns() -> Column:
    return nss(F.col("positive"), F.col("neutral"), F.col("negative"))


def net_sentiment(rows: DataFrame) -> DataFrame:
    return distribution_pivot(rows).withColumn("nss", _nss_columns())


def live_distribution(rows: DataFrame, band: float = LIVE_BAND) -> DataFrame:
    """Counts by score instead of label (neutral inclusive at the band), with their score."""
    counts = rows.groupBy("job_id").agg(*_label_counts(score_label(SCORE, band)))
    return counts.withColumn("nss", _nss_columns())


def largest_remainder(parts: list[Column], total: Column) -> list[Column]:
    """Whole percents of ``parts`` summing to 100; larger remainders first, then list order."""
    exact = [p / total * F.lit(100.0) for p in parts]
    floors = [F.floor(e) for e in exact]
    rests = [e - f for e, f in zip(exact, floors)]
    missing = F.lit(100) - sum(floors[1:], floors[0])
    out = []
    for i, rest in enumerate(rests):
        ahead = F.lit(0)
        for j, other in enumerate(rests):
            if j != i:
                before = other >= rest if j < i else other > rest
                ahead = ahead + before.cast("int")
        bonus = (ahead < missing).cast("int")
        out.append(F.when(total > 0, floors[i] + bonus).otherwise(F.lit(0)).cast("long"))
    return out


def _with_total(counts: DataFrame) -> DataFrame:
    return counts.withColumn("total", F.col("positive") + F.col("neutral") + F.col("negative"))


def breakdown(rows: DataFrame) -> DataFrame:
    """Counts by score band with percents that add up to 100."""
    counts = _with_total(rows.groupBy("job_id").agg(*_label_counts(score_label(SCORE))))
    percents = largest_remainder([F.col(n) for n in LABELS], F.col("total"))
    return counts.select("*", *[p.alias(f"{n}_percent") for n, p in zip(LABELS, percents)])


def rounded_breakdown(rows: DataFrame) -> DataFrame:
    """Counts by label, every percent rounded alone (may not add up to 100)."""
    counts = _with_total(distribution_pivot(rows))
    return counts.select(
        "*", *[percent_of(F.col(n), F.col("total")).alias(f"{n}_percent") for n in LABELS]
    )


def pie_rows(rows: DataFrame) -> DataFrame:
    """Three rows per job for a pie chart and its legend."""
    counts = _with_total(distribution_pivot(rows))
    slices = F.array(
        *[
            F.struct(
                F.lit(n.capitalize()).alias("name"),
                F.col(n).alias("value"),
                percent_of(F.col(n), F.col("total")).alias("percent"),
            )
            for n in LABELS
        ]
    )
    return counts.select("job_id", F.inline(slices))


def job_metrics(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs with count and average, both null for a job without rows; one grouped pass."""
    metrics = rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("data_points_count"), mean_score(SCORE).alias("average_sentiment")
    )
    return jobs.join(metrics, "job_id", "left")


def completion_records(
    rows: DataFrame, jobs: DataFrame, completed_at: Column, default_average: float = 0.5
) -> DataFrame:
    """What a completed job announces; a job without rows reports the default average."""
    return job_metrics(jobs.select("job_id"), rows).select(
        "job_id",
        F.lit("completed").alias("status"),
        F.coalesce("average_sentiment", F.lit(default_average)).alias("average_sentiment"),
        F.coalesce("data_points_count", F.lit(0)).alias("data_points_count"),
        completed_at.alias("completed_at"),
    )


def result_headers(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Job row with average, total and distribution: the head of a result bundle.

    The rows themselves stay a table keyed by job (``normalize.result_rows``); packing them
    into one value per job would put a whole job into one task.
    """
    summary = rows.groupBy("job_id").agg(
        mean_score(SCORE).alias("average_sentiment"),
        F.count(F.lit(1)).alias("total_data_points"),
        *_label_counts(F.col(LABEL)),
    )
    return jobs.join(summary, "job_id", "left").fillna(0, ["total_data_points", *LABELS])


def row_time() -> Column:
    return F.coalesce(F.col("analyzed_at"), F.col("published_at"))


def _trend_parts(
    rows: DataFrame, window_ms: int, as_of: Column | None, at: Column | None, more: tuple[Column, ...] = ()
) -> DataFrame:
    """Per job: count, first and last time, count and score units of both windows, and ``more`` aggregates.

    Seen from a given time this is one pass. Seen from each job's last row it is two, the first
    one's table of one row per job joined to the rows of the second; a window over each job would
    be one, but would move all rows of a job into one task.
    """
    points = rows.withColumns({"_t": epoch_ms(at if at is not None else row_time()), "_u": score_units(SCORE)})
    spans = [F.count(F.lit(1)).alias("n"), F.min("_t").alias("first_ms"), F.max("_t").alias("last_ms"), *more]
    recent = F.col("_age") <= window_ms
    previous = (F.col("_age") > window_ms) & (F.col("_age") <= 2 * window_ms)
    sides = [
        F.count_if(recent).alias("recent_n"),
        F.sum(F.when(recent, F.col("_u"))).alias("recent_u"),
        F.count_if(previous).alias("previous_n"),
        F.sum(F.when(previous, F.col("_u"))).alias("previous_u"),
    ]
    if as_of is not None:
        aged = points.withColumn("_age", epoch_ms(as_of) - F.col("_t"))
        return aged.groupBy("job_id").agg(*spans, *sides).withColumn("last_ms", epoch_ms(as_of))
    heads = materialize(points.groupBy("job_id").agg(*spans))
    narrow = points.select("job_id", "_t", "_u")
    aged = join_per_key(narrow, heads.select("job_id", "last_ms"), "job_id").withColumn("_age", F.col("last_ms") - F.col("_t"))
    windows = aged.filter(F.col("_age") <= 2 * window_ms).groupBy("job_id").agg(*sides)
    return heads.join(windows, "job_id", "left").fillna(0, ["recent_n", "previous_n"])


def _velocity() -> Column:
    return F.when(
        (F.col("n") >= 5) & (F.col("recent_n") > 0) & (F.col("previous_n") > 0),
        units_mean(F.col("recent_u"), F.col("recent_n"))
        - units_mean(F.col("previous_u"), F.col("previous_n")),
    )


def posts_per_minute_of(count: Column, duration_ms: Column, least_ms: int = 5000) -> Column:
    rate = round_half_up(count / (duration_ms / F.lit(60000.0)) * F.lit(10.0)) / F.lit(10.0)
    return F.when(duration_ms >= least_ms, rate)


def volume_trend_of(recent: Column, previous: Column, least: int = 3) -> Column:
    change = round_half_up((recent - previous) / previous * F.lit(100.0))
    return F.when((recent >= least) & (previous >= least), change)


def velocity(
    rows: DataFrame, window_ms: int = 30_000, as_of: Column | None = None, at: Column | None = None
) -> DataFrame:
    """Average score of the last window minus that of the one before.

    Seen from each job's last row, or from ``as_of`` for live jobs (then usually with the
    arrival time as ``at``). Null below five rows or when a window is empty.
    """
    return _trend_parts(rows, window_ms, as_of, at).select("job_id", _velocity().alias("velocity"))


def posts_per_minute(rows: DataFrame, as_of: Column | None = None, at: Column | None = None) -> DataFrame:
    t = epoch_ms(at if at is not None else row_time())
    last = epoch_ms(as_of) if as_of is not None else F.col("last_ms")
    return (
        rows.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"))
        .select("job_id", posts_per_minute_of(F.col("n"), last - F.col("first_ms")).alias("posts_per_minute"))
    )


def volume_trend(
    rows: DataFrame, window_ms: int = 30_000, as_of: Column | None = None, at: Column | None = None
) -> DataFrame:
    return _trend_parts(rows, window_ms, as_of, at).select(
        "job_id",
        "recent_n",
        "previous_n",
        volume_trend_of(F.col("recent_n"), F.col("previous_n")).alias("volume_trend"),
    )


def stats_bundle(
    rows: DataFrame,
    window_ms: int = 30_000,
    live: bool = False,
    as_of: Column | None = None,
    at: Column | None = None,
) -> DataFrame:
    """All headline numbers, one row per job.

    Completed jobs count by stored label and round percents alone; live jobs take the score
    from the wide band and the percents from the narrow one, summing to 100.
    """
    by_label = _label_counts(score_label(SCORE) if live else F.col(LABEL))
    band = score_label(SCORE, LIVE_BAND)
    heads = (
        F.sum("_u").alias("_units"),
        *by_label,
        F.count_if(band == "positive").alias("_live_pos"),
        F.count_if(band == "neutral").alias("_live_neu"),
        F.count_if(band == "negative").alias("_live_neg"),
    )
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    if live:
        percents = largest_remainder([F.col(n) for n in LABELS], total)
        score = nss(F.col("_live_pos"), F.col("_live_neu"), F.col("_live_neg"))
    else:
        percents = [percent_of(F.col(n), total) for n in LABELS]
        score = _nss_columns()
    return _trend_parts(rows, window_ms, as_of, at, heads).select(
        "job_id",
        units_mean(F.col("_units"), F.col("n")).alias("average_sentiment"),
        score.alias("nss"),
        F.col("n").alias("total_posts"),
        *LABELS,
        *[p.alias(f"{n}_percent") for n, p in zip(LABELS, percents)],
        _velocity().alias("velocity"),
        posts_per_minute_of(F.col("n"), F.col("last_ms") - F.col("first_ms")).alias("posts_per_minute"),
        volume_trend_of(F.col("recent_n"), F.col("previous_n")).alias("volume_trend"),
    )

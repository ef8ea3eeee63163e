"""Result queries over the scored rows."""

from pyspark.sql import functions as F

from sentispark.operators import results as R
from sentispark.operators import series as S
from sentispark.operators.feed import running_count
from sentispark.operators.normalize import result_rows
from sentispark.operators.validate import check_results
from sentispark.plans.registry import BY_TYPE, BY_USER, query
from sentispark.sources.tables import events_as_scored, users_as_jobs

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
_MEAN = "sum(u) / 1e8 / count(*)"


def _by_user(spark, folder):
    return events_as_scored(spark, folder, "user_id")


@query(
    "count_per_job",
    f"""WITH {BY_USER}
    SELECT CAST(c_custkey AS VARCHAR) AS job_id, count(id) AS data_points
    FROM customer LEFT JOIN scored_u ON job_id = CAST(c_custkey AS VARCHAR) GROUP BY 1""",
)
def count_per_job(spark, folder):
    return R.count_per_job(_by_user(spark, folder), users_as_jobs(spark, folder))


@query(
    "average_per_job",
    f"""WITH {BY_USER}, a AS (SELECT job_id, {_MEAN} AS m FROM scored_u GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS job_id, m AS average_sentiment
    FROM customer LEFT JOIN a ON job_id = CAST(c_custkey AS VARCHAR)""",
)
def average_per_job(spark, folder):
    return R.average_per_job(_by_user(spark, folder), users_as_jobs(spark, folder))


@query(
    "job_metrics",
    f"""WITH {BY_USER}, a AS (SELECT job_id, count(*) AS n, {_MEAN} AS m FROM scored_u GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS prompt, n AS data_points_count,
           m AS average_sentiment
    FROM customer LEFT JOIN a ON job_id = CAST(c_custkey AS VARCHAR)""",
)
def job_metrics(spark, folder):
    return R.job_metrics(users_as_jobs(spark, folder), _by_user(spark, folder))


@query(
    "completion_record",
    f"""WITH {BY_USER}, a AS (SELECT job_id, count(*) AS n, {_MEAN} AS m FROM scored_u GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS job_id, 'completed' AS status,
           coalesce(m, CAST(0.5 AS DOUBLE)) AS average_sentiment, coalesce(n, 0) AS data_points_count,
           '2024-02-01' AS completed_at
    FROM customer LEFT JOIN a ON job_id = CAST(c_custkey AS VARCHAR)""",
)
def completion_record(spark, folder):
    return R.completion_records(
        _by_user(spark, folder), users_as_jobs(spark, folder), F.lit("2024-02-01")
    )


@query(
    "label_distribution",
    f"""WITH {BY_USER} SELECT job_id, label, count(*) AS count FROM scored_u GROUP BY 1, 2""",
)
def label_distribution(spark, folder):
    return R.label_distribution(_by_user(spark, folder))


_PIVOT = """count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'neutral') AS neutral,
           count(*) FILTER (label = 'negative') AS negative"""


@query("distribution_pivot", f"WITH {BY_USER} SELECT job_id, {_PIVOT} FROM scored_u GROUP BY 1")
def distribution_pivot(spark, folder):
    return R.pivot_distribution(R.label_distribution(_by_user(spark, folder)))


_NSS = """CAST(CASE WHEN positive + neutral + negative = 0 THEN 0
      ELSE floor((positive - negative) / (positive + neutral + negative) * 100.0::DOUBLE + 0.5) END AS BIGINT) AS nss"""


@query(
    "nss",
    f"""WITH {BY_USER}, d AS (SELECT job_id, {_PIVOT} FROM scored_u GROUP BY 1) SELECT *, {_NSS} FROM d""",
)
def nss(spark, folder):
    return R.net_sentiment(_by_user(spark, folder))


def _band(b):
    return f"""count(*) FILTER (s > {b}) AS positive, count(*) FILTER (s >= -{b} AND s <= {b}) AS neutral,
           count(*) FILTER (s < -{b}) AS negative"""


@query(
    "live_distribution",
    f"""WITH {BY_USER}, d AS (SELECT job_id, {_band(0.2)} FROM scored_u GROUP BY 1) SELECT *, {_NSS} FROM d""",
)
def live_distribution(spark, folder):
    return R.live_distribution(_by_user(spark, folder))


# The remainders are ranked with a window over the three unpivoted parts.
_REMAINDERS = """
    e AS (SELECT job_id, total, name, ord, n, n / total * 100.0::DOUBLE AS x
          FROM (SELECT job_id, total, unnest(['positive', 'neutral', 'negative']) AS name,
                       unnest([1, 2, 3]) AS ord, unnest([positive, neutral, negative]) AS n FROM d)),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY x - floor(x) DESC, ord) AS rk,
                 100 - sum(floor(x)) OVER (PARTITION BY job_id) AS missing FROM e),
    p AS (SELECT job_id, name, CAST(floor(x) + CASE WHEN rk <= missing THEN 1 ELSE 0 END AS BIGINT) AS pct FROM r)"""


def _percent(n):
    return f"max(pct) FILTER (name = '{n}') AS {n}_percent"


@query(
    "breakdown_largest_remainder",
    f"""WITH {BY_USER},
    d AS (SELECT *, positive + neutral + negative AS total
          FROM (SELECT job_id, {_band(0.1)} FROM scored_u GROUP BY 1)), {_REMAINDERS}
    SELECT d.*, q.* EXCLUDE (job_id) FROM d JOIN (
      SELECT job_id, {_percent('positive')}, {_percent('neutral')}, {_percent('negative')}
      FROM p GROUP BY 1) q USING (job_id)""",
)
def breakdown_largest_remainder(spark, folder):
    return R.breakdown(_by_user(spark, folder))


def _rounded(n):
    return f"CAST(floor({n} / total * 100.0::DOUBLE + 0.5) AS BIGINT)"


@query(
    "breakdown_rounded",
    f"""WITH {BY_USER}, d AS (SELECT *, positive + neutral + negative AS total
        FROM (SELECT job_id, {_PIVOT} FROM scored_u GROUP BY 1))
    SELECT *, {_rounded('positive')} AS positive_percent, {_rounded('neutral')} AS neutral_percent,
           {_rounded('negative')} AS negative_percent FROM d""",
)
def breakdown_rounded(spark, folder):
    return R.rounded_breakdown(_by_user(spark, folder))


@query(
    "pie_rows",
    f"""WITH {BY_USER}, d AS (SELECT *, positive + neutral + negative AS total
        FROM (SELECT job_id, {_PIVOT} FROM scored_u GROUP BY 1))
    SELECT job_id, 'Positive' AS name, positive AS value, {_rounded('positive')} AS percent FROM d
    UNION ALL SELECT job_id, 'Neutral', neutral, {_rounded('neutral')} FROM d
    UNION ALL SELECT job_id, 'Negative', negative, {_rounded('negative')} FROM d""",
)
def pie_rows(spark, folder):
    return R.pie_rows(_by_user(spark, folder))


@query(
    "job_results",
    f"""WITH {BY_USER}, a AS (SELECT job_id, {_MEAN} AS m, count(*) AS n, {_PIVOT} FROM scored_u GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS prompt, m AS average_sentiment,
           coalesce(n, 0) AS total_data_points, coalesce(positive, 0) AS positive,
           coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative
    FROM customer LEFT JOIN a ON job_id = CAST(c_custkey AS VARCHAR)""",
)
def job_results(spark, folder):
    return R.result_headers(users_as_jobs(spark, folder), _by_user(spark, folder))


@query(
    "result_rows",
    f"""WITH {BY_TYPE} SELECT id, text_content, label AS sentiment_label, s AS sentiment_score,
       'bluesky' AS source, source_url, author_name, epoch_us(published_at) AS published_us,
       epoch_us(analyzed_at) AS analyzed_us FROM scored_t""",
)
def results_projected(spark, folder):
    rows = result_rows(events_as_scored(spark, folder))
    return rows.select(
        *rows.columns[:-2],
        F.unix_micros(F.col("published_at").cast("timestamp")).alias("published_us"),
        F.unix_micros(F.col("analyzed_at").cast("timestamp")).alias("analyzed_us"),
    )


@query(
    "result_contract",
    f"""WITH {BY_USER}
    SELECT 'job_id is a uuid' AS rule, count(*) AS violations FROM scored_u
    UNION ALL SELECT 'label is known', count(*) FILTER (event_type NOT IN ('positive', 'neutral', 'negative')) FROM scored_u
    UNION ALL SELECT 'score within -1..1', count(*) FILTER ((value - 50) / 50 > 1) FROM scored_u
    UNION ALL SELECT 'status is known', count(*) FILTER (user_id % 5 = 0) FROM scored_u
    UNION ALL SELECT 'average within -1..1', count(*) FILTER (value / 50 > 1 AND user_id % 2 = 0) FROM scored_u
    UNION ALL SELECT 'count is not negative', count(*) FILTER (user_id < 5) FROM scored_u
    UNION ALL SELECT unnest(['text present', 'id present', 'source present']), 0
    UNION ALL SELECT unnest(['prompt present', 'creation time present']), count(*) FROM scored_u""",
)
def result_contract(spark, folder):
    # Raw values as scores and event types as labels: data that breaks the rules.
    rows = _by_user(spark, folder).withColumns(
        {
            "sentiment_label": F.col("event_type"),
            "sentiment_score": (F.col("value") - 50) / 50,
            "status": F.when(F.col("user_id") % 5 == 0, "stopped").otherwise("completed"),
            "average_sentiment": F.when(F.col("user_id") % 2 == 0, F.col("value") / 50),
            "data_points_count": F.col("user_id") - 5,
        }
    )
    return check_results(rows)


def _bucket_sql(time, ms):
    return f"""SELECT job_id, {time} // {ms} * {ms} AS b, sum(u) AS us, count(*) AS n FROM scored_{{0}} GROUP BY 1, 2"""


@query(
    "bucket_series",
    f"""WITH {BY_TYPE}, b AS ({_bucket_sql('pub_ms', 1000).format('t')})
    SELECT job_id, b // 1000 AS time, us / 1e8 / n AS value, n AS post_count FROM b""",
)
def bucket_series(spark, folder):
    return S.bucket_series(events_as_scored(spark, folder))


_CHART = """SELECT job_id, b // 1000 AS time, us / 1e8 / n AS value, n AS post_count,
    CAST(sum(n) OVER w AS BIGINT) AS total_posts, sum(us) OVER w / 1e8 / sum(n) OVER w AS cumulative_average
    FROM b WINDOW w AS (PARTITION BY job_id ORDER BY b ROWS UNBOUNDED PRECEDING)"""


@query(
    "cumulative_series",
    f"""WITH {BY_TYPE}, b AS ({_bucket_sql('pub_ms', HOUR_MS).format('t')}) {_CHART}""",
)
def cumulative_series(spark, folder):
    return S.chart_series(events_as_scored(spark, folder), bucket_ms=HOUR_MS)


@query(
    "cumulative_series_live_clock",
    f"""WITH {BY_USER}, b AS ({_bucket_sql('ana_ms', HOUR_MS).format('u')}) {_CHART}""",
)
def cumulative_series_live_clock(spark, folder):
    return S.chart_series(_by_user(spark, folder), time_col="analyzed_at", bucket_ms=HOUR_MS)


_TREND = f"""
    m AS (SELECT job_id, count(*) AS n, min(ana_ms) AS first_ms, max(ana_ms) AS last_ms FROM scored_u GROUP BY 1),
    g AS (SELECT job_id, n, first_ms, last_ms,
      sum(u) FILTER (last_ms - ana_ms <= {DAY_MS}) / 1e8 / nullif(count(*) FILTER (last_ms - ana_ms <= {DAY_MS}), 0) AS ra,
      sum(u) FILTER (last_ms - ana_ms > {DAY_MS} AND last_ms - ana_ms <= {2 * DAY_MS}) / 1e8
        / nullif(count(*) FILTER (last_ms - ana_ms > {DAY_MS} AND last_ms - ana_ms <= {2 * DAY_MS}), 0) AS pa,
      count(*) FILTER (last_ms - ana_ms <= {DAY_MS}) AS recent_n,
      count(*) FILTER (last_ms - ana_ms > {DAY_MS} AND last_ms - ana_ms <= {2 * DAY_MS}) AS previous_n
      FROM scored_u JOIN m USING (job_id) GROUP BY ALL)"""
_VELOCITY = "CASE WHEN n >= 5 THEN ra - pa END AS velocity"
_RATE = """CASE WHEN last_ms - first_ms >= 5000
       THEN floor(n / ((last_ms - first_ms) / 60000.0::DOUBLE) * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE END AS posts_per_minute"""
_VOLUME = """CASE WHEN recent_n >= 3 AND previous_n >= 3
       THEN CAST(floor((recent_n - previous_n) / previous_n * 100.0::DOUBLE + 0.5) AS BIGINT) END AS volume_trend"""


@query("velocity", f"WITH {BY_USER}, {_TREND} SELECT job_id, {_VELOCITY} FROM g")
def velocity(spark, folder):
    return R.velocity(_by_user(spark, folder), window_ms=DAY_MS)


@query(
    "velocity_live",
    f"WITH {BY_USER}, {_TREND.replace('max(ana_ms) AS last_ms', 'epoch_ms(TIMESTAMP ' + chr(39) + '2024-01-31' + chr(39) + ') AS last_ms')} SELECT job_id, {_VELOCITY} FROM g",
)
def velocity_live(spark, folder):
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    return R.velocity(_by_user(spark, folder), DAY_MS, as_of=as_of, at=F.col("analyzed_at"))


@query("posts_per_minute", f"WITH {BY_USER}, {_TREND} SELECT job_id, {_RATE} FROM g")
def posts_per_minute(spark, folder):
    return R.posts_per_minute(_by_user(spark, folder))


@query(
    "volume_trend", f"WITH {BY_USER}, {_TREND} SELECT job_id, recent_n, previous_n, {_VOLUME} FROM g"
)
def volume_trend(spark, folder):
    return R.volume_trend(_by_user(spark, folder), window_ms=DAY_MS)


@query(
    "stats_bundle",
    f"""WITH {BY_USER}, {_TREND},
    d AS (SELECT job_id, {_MEAN} AS average_sentiment, count(*) AS total, {_PIVOT} FROM scored_u GROUP BY 1)
    SELECT job_id, average_sentiment, {_NSS}, total AS total_posts, positive, neutral, negative,
      {_rounded('positive')} AS positive_percent, {_rounded('neutral')} AS neutral_percent,
      {_rounded('negative')} AS negative_percent, {_VELOCITY}, {_RATE}, {_VOLUME}
    FROM d JOIN g USING (job_id)""",
)
def stats_bundle(spark, folder):
    return R.stats_bundle(_by_user(spark, folder), window_ms=DAY_MS)


@query(
    "stats_bundle_live",
    f"""WITH {BY_USER}, {_TREND},
    d AS (SELECT job_id, {_MEAN} AS average_sentiment, count(*) AS total, {_band(0.1)},
      count(*) FILTER (s > 0.2) AS lp, count(*) FILTER (s < -0.2) AS ln FROM scored_u GROUP BY 1), {_REMAINDERS},
    q AS (SELECT job_id, {_percent('positive')}, {_percent('neutral')}, {_percent('negative')} FROM p GROUP BY 1)
    SELECT job_id, average_sentiment, CAST(floor((lp - ln) / d.total * 100.0::DOUBLE + 0.5) AS BIGINT) AS nss,
      d.total AS total_posts, positive, neutral, negative, positive_percent, neutral_percent, negative_percent,
      {_VELOCITY}, {_RATE}, {_VOLUME}
    FROM d JOIN g USING (job_id) JOIN q USING (job_id)""",
)
def stats_bundle_live(spark, folder):
    return R.stats_bundle(_by_user(spark, folder), window_ms=DAY_MS, live=True)


@query(
    "running_total",
    f"""WITH {BY_TYPE} SELECT job_id, id,
      row_number() OVER (PARTITION BY job_id ORDER BY analyzed_at, id) AS total_processed FROM scored_t""",
)
def running_total(spark, folder):
    rows = events_as_scored(spark, folder).select("job_id", "id", "analyzed_at")
    return running_count(rows, ["analyzed_at", "id"]).drop("analyzed_at")


@query(
    "throughput",
    """SELECT epoch_us(ts) // 60000000 * 60 AS window_start, count(*) AS messages_received,
      count(*) FILTER (event_type <> 'error') AS posts_processed,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS total_matched,
      floor(count(*) / 60.0::DOUBLE * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS messages_per_second
    FROM events GROUP BY 1""",
)
def throughput(spark, folder):
    events = events_as_scored(spark, folder)
    kind = F.col("event_type")
    return S.throughput(events, F.col("published_at"), kind != "error", kind == "purchase")

"""Store, job table, feed and lifecycle queries."""

from pyspark.sql import functions as F

from sentispark.operators import datagen, explore, feed, lifecycle
from sentispark.plans.registry import BY_TYPE, BY_USER, query
from sentispark.session import fresh_dir
from sentispark.sources import jobs as job_table
from sentispark.sources import store
from sentispark.sources.tables import events_as_scored, orders_as_jobs, table


def _ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def _repeated(spark, folder):
    """Scored rows whose address and day repeat; a tenth of the users have no address."""
    rows = events_as_scored(spark, folder)
    url = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("https://x/"), F.col("props")))
    return rows.withColumns(
        {"source_url": url, "published_at": F.date_trunc("day", "published_at").cast("timestamp_ntz")}
    )


_REPEATED = f"""{BY_TYPE}, repeated AS (SELECT id, seq, job_id, CASE WHEN user_id % 10 <> 0 THEN 'https://x/' || props END AS url,
      date_trunc('day', published_at) AS day, published_at AS collected_at, s FROM scored_t),
    firsts AS (SELECT * FROM repeated WHERE url IS NULL UNION ALL
      SELECT * FROM repeated WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id, url, day ORDER BY collected_at, id) = 1)"""
_ARRIVAL = ("collected_at", "id")


def _arrival():
    return [F.col(c) for c in _ARRIVAL]


@query("dedupe_first", f"WITH {_REPEATED} SELECT id, job_id, url AS source_url FROM firsts")
def dedupe_first(spark, folder):
    return store.first_arrivals(_repeated(spark, folder), _arrival()).select("id", "job_id", "source_url")


@query(
    "insert_if_absent",
    f"""WITH {_REPEATED} SELECT id, job_id FROM firsts f WHERE url IS NULL OR NOT EXISTS (
      SELECT 1 FROM firsts o WHERE o.job_id = f.job_id AND o.url = f.url AND o.day = f.day AND o.s > 0.5)""",
)
def insert_if_absent(spark, folder):
    rows = _repeated(spark, folder)
    # The store already holds the clearly positive first arrivals with an address.
    stored = store.first_arrivals(rows, _arrival()).filter(
        (F.col("sentiment_score") > 0.5) & F.col("source_url").isNotNull()
    )
    return store.absent_rows(rows, stored, _arrival()).select("id", "job_id")


@query(
    "stored_inserts",
    f"""WITH {_REPEATED} SELECT job_id, count(*) AS n FROM firsts GROUP BY 1""",
)
def stored_inserts(spark, folder):
    """Two batches written to a chunked table, the second repeating the first."""
    path = fresh_dir(spark, "scored")
    rows = _repeated(spark, folder)
    addressed = rows.filter(F.col("source_url").isNotNull())
    store.insert_if_absent(addressed, path, _arrival())
    # Rows without address never conflict, so only the second batch brings them.
    store.insert_if_absent(rows, path, _arrival())
    return store.scan_rows(spark, path).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "duplicate_keys",
    f"""WITH {_REPEATED} SELECT job_id, url AS source_url, count(*) AS copies FROM repeated
      WHERE url IS NOT NULL GROUP BY job_id, url, day HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    return store.duplicate_keys(_repeated(spark, folder)).select("job_id", "source_url", "copies")


@query(
    "time_chunks",
    """SELECT CAST(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS DATE)::VARCHAR AS chunk_start, count(*) AS n
    FROM events GROUP BY 1""",
)
def time_chunks(spark, folder):
    rows = store.with_chunk(events_as_scored(spark, folder))
    return rows.groupBy(F.col("chunk_start").cast("string").alias("chunk_start")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "late_rows_in_chunks",
    """SELECT CAST(time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-01') AS DATE)::VARCHAR AS chunk_start,
      o_orderstatus AS job_id, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def late_rows_in_chunks(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("job_id"), F.col("o_orderdate").alias("published_at")
    )
    return store.with_chunk(orders).groupBy(
        F.col("chunk_start").cast("string").alias("chunk_start"), "job_id"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "retention_chunks",
    """SELECT event_id::VARCHAR AS id FROM events
    WHERE time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY > TIMESTAMP '2024-04-14' - INTERVAL 90 DAY""",
)
def retention_chunks(spark, folder):
    return store.apply_retention(events_as_scored(spark, folder), _ntz("2024-04-14")).select("id")


@query(
    "retention_exact",
    "SELECT event_id::VARCHAR AS id FROM events WHERE ts >= TIMESTAMP '2024-04-14' - INTERVAL 90 DAY",
)
def retention_exact(spark, folder):
    return store.within_retention(events_as_scored(spark, folder), _ntz("2024-04-14")).select("id")


def _deleted(spark, folder):
    return table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("job_id"))


@query(
    "cascade_delete",
    f"WITH {BY_USER} SELECT id, job_id FROM scored_u WHERE job_id NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)",
)
def cascade_delete(spark, folder):
    rows = events_as_scored(spark, folder, "user_id").select("id", "job_id")
    return store.without_jobs(rows, _deleted(spark, folder)).select("id", "job_id")


@query(
    "delete_counts",
    f"""WITH {BY_USER} SELECT s_suppkey::VARCHAR AS job_id, count(id) AS deleted FROM supplier
    LEFT JOIN scored_u ON job_id = s_suppkey::VARCHAR GROUP BY 1""",
)
def delete_counts(spark, folder):
    return store.deleted_counts(events_as_scored(spark, folder, "user_id"), _deleted(spark, folder))


@query(
    "stored_after_delete_and_retention",
    f"""WITH {BY_USER} SELECT job_id, count(*) AS n FROM scored_u WHERE job_id NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)
      AND published_at >= TIMESTAMP '2024-01-11' GROUP BY 1""",
)
def stored_after_delete_and_retention(spark, folder):
    """The same deletions on a written table, by chunk."""
    path = fresh_dir(spark, "scored")
    store.write_rows(events_as_scored(spark, folder, "user_id"), path)
    store.delete_jobs(spark, path, _deleted(spark, folder))
    store.drop_expired(spark, path, _ntz("2024-04-14"))
    return store.scan_rows(spark, path).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


# --- jobs ------------------------------------------------------------------------------------

_JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderdate AS created_at,
      CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status FROM orders)"""


@query(
    "jobs_newest",
    f"WITH {_JOBS} SELECT job_id, status, epoch_us(created_at) AS created_us FROM jobs WHERE user_id = 17 ORDER BY created_at DESC",
)
def jobs_newest(spark, folder):
    jobs = explore.newest_jobs(orders_as_jobs(spark, folder), 17)
    return jobs.select("job_id", "status", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


@query(
    "job_page",
    f"WITH {_JOBS} SELECT job_id, user_id FROM jobs ORDER BY created_at DESC, job_id LIMIT 10 OFFSET 20",
)
def job_page(spark, folder):
    order = [F.col("created_at").desc(), F.col("job_id")]
    return explore.page_of(orders_as_jobs(spark, folder), order, page=3, size=10).select("job_id", "user_id")


@query("user_scope", f"WITH {_JOBS} SELECT job_id, user_id FROM jobs WHERE user_id = 42")
def user_scope(spark, folder):
    return explore.jobs_of(orders_as_jobs(spark, folder), 42).select("job_id", "user_id")


@query(
    "terminal_jobs",
    f"WITH {_JOBS} SELECT job_id, status IN ('completed', 'failed') AS terminal FROM jobs",
)
def terminal_jobs(spark, folder):
    return orders_as_jobs(spark, folder).select("job_id", feed.is_terminal().alias("terminal"))


@query(
    "status_update",
    f"""WITH {_JOBS}, up AS (SELECT l_orderkey AS job_id, arg_max(CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'completed'
        ELSE 'in_progress' END, l_suppkey * 1000000 + l_partkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY 1)
    SELECT job_id, coalesce(s, status) AS status, epoch_us(CASE WHEN s IS NULL THEN created_at ELSE TIMESTAMP '2024-02-01' END) AS updated_us
    FROM jobs LEFT JOIN up USING (job_id)""",
)
def status_update(spark, folder):
    jobs = lifecycle.update_status(orders_as_jobs(spark, folder), _updates(spark, folder), _ntz("2024-02-01"))
    return jobs.select("job_id", "status", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


def _updates(spark, folder):
    status = (
        F.when(F.col("l_returnflag") == "A", "failed")
        .when(F.col("l_returnflag") == "R", "completed")
        .otherwise("in_progress")
    )
    seq = F.col("l_suppkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), status.alias("status"), seq.alias("seq")
    )


# Line items as lifecycle events of their order: returned = completed, accepted = failed.
_EVENTS = """ev AS (SELECT l_orderkey AS job_id, l_shipdate AS ts, l_suppkey * 1000000 + l_partkey * 10 + l_linenumber AS seq,
      CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'completed' ELSE 'initial_batch' END AS type,
      CASE WHEN l_returnflag = 'A' THEN 'error ' || l_linenumber END AS error_message FROM lineitem)"""


def lifecycle_events(spark, folder):
    kind = (
        F.when(F.col("l_returnflag") == "A", "failed")
        .when(F.col("l_returnflag") == "R", "completed")
        .otherwise("initial_batch")
    )
    seq = F.col("l_suppkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_shipdate").alias("ts"),
        seq.alias("seq"),
        kind.alias("type"),
        F.when(kind == "failed", F.concat(F.lit("error "), F.col("l_linenumber"))).alias("error_message"),
    )


# Written as a fold over the ordered events, independently of the aggregate form.
LIFECYCLE_SQL = f"""WITH {_JOBS}, {_EVENTS},
    folded AS (SELECT job_id, list_reduce(list_prepend({{'s': 'start', 't': NULL::TIMESTAMP, 'e': NULL::VARCHAR}},
        list({{'s': type, 't': ts, 'e': error_message}} ORDER BY ts, seq)), lambda acc, x:
        CASE WHEN x.s IN ('completed', 'failed') THEN x WHEN acc.s = 'start' THEN x ELSE acc END) AS f FROM ev GROUP BY 1)
    SELECT job_id,
      CASE WHEN f.s IN ('completed', 'failed') THEN f.s WHEN f.s = 'initial_batch' AND status = 'pending' THEN 'in_progress' ELSE status END AS status,
      epoch_us(CASE WHEN f.s IN ('completed', 'failed') OR (f.s = 'initial_batch' AND status = 'pending') THEN f.t ELSE created_at END) AS updated_us,
      epoch_us(CASE WHEN f.s = 'completed' THEN f.t END) AS completed_us, CASE WHEN f.s = 'failed' THEN f.e END AS error_message
    FROM jobs LEFT JOIN folded USING (job_id)"""


@query("lifecycle_fold", LIFECYCLE_SQL)
def lifecycle_fold(spark, folder):
    return _outcomes(lifecycle.fold_lifecycle(orders_as_jobs(spark, folder), lifecycle_events(spark, folder)))


@query("lifecycle_two_batches", LIFECYCLE_SQL)
def lifecycle_two_batches(spark, folder):
    """The events before and from a date on, folded one batch after the other."""
    events = lifecycle_events(spark, folder)
    early = F.col("ts") < _ntz("1998-06-01")
    first = lifecycle.fold_lifecycle(orders_as_jobs(spark, folder), events.filter(early))
    return _outcomes(lifecycle.fold_lifecycle(first, events.filter(~early)))


def _outcomes(jobs):
    return jobs.select(
        "job_id",
        "status",
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"),
        F.unix_micros(F.col("completed_at").cast("timestamp")).alias("completed_us"),
        "error_message",
    )


@query(
    "completion_progress",
    f"""WITH {BY_USER}, e AS (SELECT c_custkey::VARCHAR AS job_id, CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS expected FROM customer),
    n AS (SELECT job_id, count(*) AS n FROM scored_u GROUP BY 1)
    SELECT job_id, coalesce(n, 0) AS processed, expected,
      CASE WHEN expected > 0 THEN coalesce(n, 0) / expected ELSE 1.0::DOUBLE END AS ratio, greatest(expected - coalesce(n, 0), 0) AS missing
    FROM e LEFT JOIN n USING (job_id)""",
)
def completion_progress(spark, folder):
    expected = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.floor(F.abs("c_acctbal") / 100).alias("expected")
    )
    return lifecycle.progress(events_as_scored(spark, folder, "user_id"), expected)


@query(
    "completion_decision",
    """SELECT p_partkey, CASE WHEN p_size > 45 THEN 'running' WHEN 18 + p_size % 4 >= 20 THEN 'complete'
      WHEN w >= 30000 AND (18 + p_size % 4) / 20 >= 0.95 AND i >= 15000 THEN 'fallback' ELSE 'wait' END AS decision,
      (i > 3600000 AND p_size % 2 = 1) OR w > 86400000 AS expired
    FROM (SELECT *, p_retailprice * 30 AS w, (p_partkey % 7) * 3000 + p_size * 100000 AS i FROM part)""",
)
def completion_decision(spark, folder):
    waited = F.col("p_retailprice") * 30
    idle = (F.col("p_partkey") % 7) * 3000 + F.col("p_size") * 100_000
    expected = F.when(F.col("p_size") <= 45, F.lit(20))
    return table(spark, folder, "part").select(
        "p_partkey",
        lifecycle.completion_decision(18 + F.col("p_size") % 4, expected, waited, idle).alias("decision"),
        lifecycle.tracker_expired(idle, waited, F.col("p_size") % 2 == 0).alias("expired"),
    )


FAILURE_SQL = """WITH f AS (SELECT props AS content, event_type = 'error' AS permanent FROM events),
    c AS (SELECT content, count(*) FILTER (NOT permanent) AS t, count(*) FILTER (permanent) AS p FROM f GROUP BY 1)
    SELECT content, t - (t + r) // 4 AS retried, (t + r) // 4 + p AS discarded, (t + r) % 4 AS retries
    FROM (SELECT *, length(content) % 3 AS r FROM c)"""


@query("retry_routing", FAILURE_SQL)
def retry_routing(spark, folder):
    failures = table(spark, folder, "events").select(
        F.col("props").alias("content"), (F.col("event_type") == "error").alias("permanent")
    )
    attempts = failures.select("content").distinct().select(
        F.sha1("content").alias("message_key"), (F.length("content") % 3).alias("retries")
    )
    return lifecycle.route_failures(failures, attempts).drop("message_key")


# --- feed ------------------------------------------------------------------------------------


@query(
    "update_feed",
    f"""WITH {BY_TYPE}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY analyzed_at, id) AS total_processed FROM scored_t)
    SELECT job_id, id, total_processed, id AS message_id, text_content AS message_text FROM n WHERE user_id % 10 <> 0""",
)
def update_feed(spark, folder):
    rows = events_as_scored(spark, folder).withColumn("is_duplicate", F.col("user_id") % 10 == 0)
    messages = feed.update_feed(rows, ["analyzed_at", "id"])
    return messages.select(
        "job_id",
        "id",
        "total_processed",
        F.get_json_object("message", "$.dataPoint.id").alias("message_id"),
        F.get_json_object("message", "$.dataPoint.textContent").alias("message_text"),
    )


@query(
    "history_live_union",
    f"""WITH {BY_TYPE} SELECT id, CASE WHEN published_at < TIMESTAMP '2024-01-20' THEN 'history' ELSE 'live' END AS part,
      epoch_us(CASE WHEN published_at < TIMESTAMP '2024-01-20' THEN analyzed_at ELSE analyzed_at + INTERVAL 5 SECOND END) AS received_us
    FROM scored_t""",
)
def history_live_union(spark, folder):
    rows = events_as_scored(spark, folder).select("id", "job_id", "published_at", "analyzed_at")
    history = rows.filter(F.col("published_at") < _ntz("2024-01-20")).withColumn("part", F.lit("history"))
    # The stream repeats the second half of the history, and itself after a reconnect.
    live = rows.filter(F.col("published_at") >= _ntz("2024-01-10")).withColumns(
        {"part": F.lit("live"), "received_at": F.col("analyzed_at") + F.expr("INTERVAL 5 SECONDS")}
    )
    again = live.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 HOUR"))
    both = feed.history_and_live(history, live.unionByName(again))
    return both.select("id", "part", F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"))


def _feed(spark, folder):
    rows = events_as_scored(spark, folder)
    jobs = orders_as_jobs(spark, folder).withColumn("job_id", F.col("job_id").cast("string"))
    failed = jobs.filter("status = 'pending'").withColumn("error_message", F.lit("gone"))
    return feed.union_feed(
        [
            feed.envelope(rows, "job.data_update", ["id", "sentiment_label"]),
            feed.envelope(jobs, "job.status", ["job_id", "status"]),
            feed.envelope(failed, "job.failed", ["job_id", "error_message"]),
            feed.envelope(rows.filter("event_type = 'signup'"), "job.unknown", ["id"]),
            rows.filter("event_type = 'error'").select(F.lit("heartbeat").alias("type"), F.lit(None).cast("string").alias("data")),
        ]
    )


_FEED = f"""{BY_TYPE}, {_JOBS}, feed AS (
      SELECT 'job.data_update' AS type, job_id, '{{"id":"' || id || '","sentiment_label":"' || label || '"}}' AS data FROM scored_t
      UNION ALL SELECT 'job.status', job_id::VARCHAR, '{{"job_id":"' || job_id || '","status":"' || status || '"}}' FROM jobs
      UNION ALL SELECT 'job.failed', job_id::VARCHAR, '{{"job_id":"' || job_id || '","error_message":"gone"}}' FROM jobs WHERE status = 'pending'
      UNION ALL SELECT 'job.unknown', job_id, '{{"id":"' || id || '"}}' FROM scored_t WHERE event_type = 'signup'
      UNION ALL SELECT 'heartbeat', NULL, NULL FROM scored_t WHERE event_type = 'error')"""


@query("event_envelope", f"WITH {_FEED} SELECT type, job_id, data FROM feed")
def event_envelope(spark, folder):
    return _feed(spark, folder).select("type", "job_id", "data")


@query(
    "job_subscription",
    f"WITH {_FEED} SELECT type, job_id, data FROM feed WHERE (job_id = 'click' OR type = 'heartbeat') AND type <> 'job.unknown'",
)
def job_subscription(spark, folder):
    return feed.subscribe(_feed(spark, folder), "click").select("type", "job_id", "data")


@query(
    "built_rows",
    f"""WITH {BY_USER}, d AS (SELECT job_id, label, count(*) AS n FROM scored_u GROUP BY 1, 2),
    i AS (SELECT job_id, label, unnest(range(n)) AS i FROM d)
    SELECT job_id || '-' || label || '-' || i AS id, job_id, label AS sentiment_label,
      CASE label WHEN 'positive' THEN 6 + i % 4 WHEN 'neutral' THEN i % 3 - 1 ELSE -6 - i % 4 END / 10.0::DOUBLE AS sentiment_score FROM i""",
)
def built_rows(spark, folder):
    from sentispark.operators.results import distribution_pivot

    return datagen.sentiment_batch(distribution_pivot(events_as_scored(spark, folder, "user_id")))


# --- tables as written -----------------------------------------------------------------------


def _stored_events(spark, folder, part=None):
    rows = events_as_scored(spark, folder)
    return rows if part is None else rows.filter(F.col("seq") % 2 == part)


@query("append_batch", f"WITH {BY_TYPE} SELECT job_id, count(*) AS n, sum(seq)::BIGINT AS seqs FROM scored_t GROUP BY 1")
def append_batch(spark, folder):
    """Two batches appended one after the other, counted in the store."""
    path = fresh_dir(spark, "store")
    for part in (0, 1):
        store.append_rows(_stored_events(spark, folder, part), path)
    return store.scan_rows(spark, path).groupBy("job_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("rows_of_job", f"WITH {BY_TYPE} SELECT id, job_id, label AS sentiment_label FROM scored_t WHERE job_id = 'click'")
def rows_of_job(spark, folder):
    path = fresh_dir(spark, "store")
    store.write_rows(_stored_events(spark, folder), path)
    return store.scan_rows(spark, path, "click").select("id", "job_id", "sentiment_label")


@query(
    "insert_if_absent_stored",
    f"""WITH {_REPEATED}, old AS (SELECT DISTINCT job_id, url, day FROM repeated WHERE url IS NOT NULL AND seq % 2 = 0)
    SELECT id, job_id, url AS source_url FROM repeated WHERE url IS NULL UNION ALL
    SELECT id, job_id, url FROM repeated ANTI JOIN old USING (job_id, url, day) WHERE url IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY job_id, url, day ORDER BY collected_at, id) = 1""",
)
def insert_if_absent_stored(spark, folder):
    """All rows against a store that has those of even numbers; the inserted ones come back."""
    path = fresh_dir(spark, "store")
    rows = _repeated(spark, folder)
    store.insert_if_absent(rows.filter("seq % 2 = 0"), path, _arrival())
    return store.insert_if_absent(rows, path, _arrival()).select("id", "job_id", "source_url")


@query(
    "delete_then_insert",
    f"WITH {BY_TYPE} SELECT id, job_id FROM scored_t WHERE job_id <> 'click' OR seq % 2 = 1",
)
def delete_then_insert(spark, folder):
    """Rows of a job stored after its deletion stay."""
    path = fresh_dir(spark, "store")
    store.append_rows(_stored_events(spark, folder, 0), path)
    store.delete_jobs(spark, path, spark.createDataFrame([("click",)], "job_id string"))
    store.append_rows(_stored_events(spark, folder, 1), path)
    return store.scan_rows(spark, path).select("id", "job_id")


@query(
    "job_table_after_updates",
    """WITH u AS (SELECT l_orderkey AS job_id, arg_max(CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'completed' ELSE 'in_progress' END,
        l_suppkey * 1000000 + l_partkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS job_id, coalesce(s, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'completed' END) AS status
    FROM orders LEFT JOIN u ON o_orderkey = u.job_id WHERE o_orderkey % 7 <> 0""",
)
def job_table_after_updates(spark, folder):
    """Jobs created in two calls, updated, and every seventh deleted."""
    path = fresh_dir(spark, "jobs")
    jobs = orders_as_jobs(spark, folder)
    job_table.create_jobs(jobs.filter("job_id % 2 = 0"), path)
    job_table.create_jobs(jobs.filter("job_id % 2 = 1"), path)
    job_table.set_status(spark, path, _updates(spark, folder), _ntz("2024-02-01"))
    job_table.delete_jobs(spark, path, jobs.filter("job_id % 7 = 0"))
    return job_table.read_jobs(spark, path).select("job_id", "status")

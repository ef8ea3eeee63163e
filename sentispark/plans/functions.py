"""Scalar functions over whole columns of the tables."""

from pyspark.sql import functions as F

from sentispark.functions import labels as L
from sentispark.functions import text as X
from sentispark.functions.keywords import token_set
from sentispark.functions.numeric import clamp
from sentispark.plans.registry import BY_TYPE, query
from sentispark.sources.tables import events_as_scored, table, text_table


@query(
    "labels_of_scores",
    f"""WITH {BY_TYPE} SELECT id, CASE WHEN s < -0.1 THEN 'negative' WHEN s > 0.1 THEN 'positive' ELSE 'neutral' END AS label,
      CASE WHEN s >= 0.4 THEN '😊' WHEN s >= 0.1 THEN '🙂' WHEN s >= -0.1 THEN '😐' WHEN s >= -0.4 THEN '😕' ELSE '😞' END AS emoji,
      (s + 1) / 2 * 100 AS percent, greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), (value - 50) / 25)) AS clamped,
      s > 0 AS has_plus,
      CASE WHEN s < -0.1 THEN 'Negative' WHEN s > 0.1 THEN 'Positive' ELSE 'Neutral' END AS title FROM scored_t""",
)
def labels_of_scores(spark, folder):
    score = F.col("sentiment_score")
    return events_as_scored(spark, folder).select(
        "id",
        L.score_label(score).alias("label"),
        L.score_emoji(score).alias("emoji"),
        L.score_percent(score).alias("percent"),
        clamp((F.col("value") - 50) / 25).alias("clamped"),
        L.signed_score(score).startswith("+").alias("has_plus"),
        L.capitalized(L.score_label(score)).alias("title"),
    )


@query(
    "signed_score_text",
    """SELECT o_orderkey, CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '-' ELSE '' END || abs(c) // 100 || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') AS text
    FROM (SELECT o_orderkey, o_custkey % 201 - 100 AS c FROM orders)""",
)
def signed_score_text(spark, folder):
    score = (F.col("o_custkey") % 201 - 100) / 100
    return table(spark, folder, "orders").select("o_orderkey", L.signed_score(score).alias("text"))


_NSS_LABELS = """CASE WHEN n >= 50 THEN 'Very Positive' WHEN n >= 20 THEN 'Positive' WHEN n >= -20 THEN 'Neutral'
      WHEN n >= -50 THEN 'Negative' ELSE 'Very Negative' END AS description,
      CASE WHEN n >= 50 THEN 'Very Bullish' WHEN n >= 20 THEN 'Bullish' WHEN n > -20 THEN 'Neutral'
      WHEN n > -50 THEN 'Bearish' ELSE 'Very Bearish' END AS market"""


@query(
    "nss_labels",
    f"SELECT p_partkey, n AS nss, {_NSS_LABELS} FROM (SELECT p_partkey, p_partkey % 201 - 100 AS n FROM part)",
)
def nss_labels(spark, folder):
    nss = F.col("p_partkey") % 201 - 100
    return table(spark, folder, "part").select(
        "p_partkey",
        nss.alias("nss"),
        L.nss_description(nss).alias("description"),
        L.nss_market_label(nss).alias("market"),
    )


@query(
    "velocity_labels",
    f"""WITH {BY_TYPE} SELECT id, CASE WHEN s >= 0.2 THEN 'Rapidly Improving' WHEN s >= 0.05 THEN 'Improving'
      WHEN s <= -0.2 THEN 'Rapidly Declining' WHEN s <= -0.05 THEN 'Declining' ELSE 'Stable' END AS label FROM scored_t""",
)
def velocity_labels(spark, folder):
    return events_as_scored(spark, folder).select(
        "id", L.velocity_label(F.col("sentiment_score")).alias("label")
    )


@query(
    "model_labels",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN p ELSE -p END AS score,
      CASE WHEN p < 0.6 THEN 'neutral' WHEN l_returnflag = 'A' THEN 'positive' ELSE 'negative' END AS label, p AS confidence
    FROM (SELECT *, least(CAST(1 AS DOUBLE), l_quantity / 40) AS p FROM lineitem)""",
)
def model_labels(spark, folder):
    label = F.when(F.col("l_returnflag") == "A", "Positive").otherwise("NEGATIVE")
    items = table(spark, folder, "lineitem").withColumn(
        "s", L.class_to_sentiment(label, F.col("l_quantity") / 40)
    )
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.col("s.score").alias("score"),
        F.col("s.label").alias("label"),
        F.col("s.confidence").alias("confidence"),
    )


@query(
    "top_class",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= l_tax THEN 'discount' ELSE 'tax' END AS label,
      greatest(l_discount, l_tax) AS score FROM lineitem""",
)
def top_class(spark, folder):
    classes = F.array(
        F.struct(F.lit("discount").alias("label"), F.col("l_discount").alias("score")),
        F.struct(F.lit("tax").alias("label"), F.col("l_tax").alias("score")),
    )
    best = table(spark, folder, "lineitem").withColumn("best", L.top_class(classes))
    return best.select(
        "l_orderkey", "l_linenumber", F.col("best.label").alias("label"), F.col("best.score").alias("score")
    )


@query(
    "normalize_labels",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'positive' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'negative'
      ELSE 'neutral' END AS label FROM customer""",
)
def normalize_labels(spark, folder):
    raw = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "POSITIVE")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Negative")
        .otherwise(F.col("c_mktsegment"))
    )
    return table(spark, folder, "customer").select("c_custkey", L.normalize_label(raw).alias("label"))


@query(
    "blank_texts",
    "SELECT doc_id, regexp_full_match(text, '\\s*') AS blank, len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda w: lower(w)), lambda w: w <> ''))) AS tokens FROM documents",
)
def blank_texts(spark, folder):
    return text_table(spark, folder, "documents").select(
        "doc_id", L.is_blank("text").alias("blank"), F.size(token_set("text")).alias("tokens")
    )


@query(
    "truncate_text",
    """SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS model_md5,
      CASE WHEN length(text) > 120 THEN trim(substr(text, 1, 120), E' \\t\\r\\n') || '...' ELSE text END AS short FROM documents""",
)
def truncate_text(spark, folder):
    return text_table(spark, folder, "documents").select(
        "doc_id",
        F.md5(X.truncate_for_model("text")).alias("model_md5"),
        X.truncate_text("text", 120).alias("short"),
    )


_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[/!]?[A-Za-z][^>]*>', '', 'g')"


@query(
    "clean_html",
    f"SELECT page_id, length({_STRIPPED}) AS n, md5({_STRIPPED}) AS text_md5 FROM pages",
)
def clean_html(spark, folder):
    pages = text_table(spark, folder, "pages").select("page_id", X.strip_html("html").alias("plain"))
    return pages.select("page_id", F.length("plain").alias("n"), F.md5("plain").alias("text_md5"))


@query(
    "safe_urls",
    """SELECT page_id, url AS plain, '' AS no_scheme, '' AS script, '/' || page_id AS relative, '' AS mail FROM pages""",
)
def safe_urls(spark, folder):
    url = F.col("url")
    return text_table(spark, folder, "pages").select(
        "page_id",
        X.safe_url(url).alias("plain"),
        X.safe_url(F.regexp_replace(url, "^https?:", "")).alias("no_scheme"),
        X.safe_url(F.concat(F.lit(" JavaScript:open("), url, F.lit(")"))).alias("script"),
        X.safe_url(F.concat(F.lit("/"), F.col("page_id"))).alias("relative"),
        X.safe_url(F.concat(F.lit("mailto:"), url)).alias("mail"),
    )


@query(
    "log_safe_text",
    """SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\\r\\n\\t]', ' ', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g')), 1, 100) AS logged FROM documents""",
)
def log_safe_text(spark, folder):
    return text_table(spark, folder, "documents").select("doc_id", X.log_safe("text").alias("logged"))


_AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"


@query(
    "relative_times",
    f"""SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago'
      WHEN d < 7 THEN d || 'd ago' ELSE strftime(ts, '%b %-d') END AS age,
      strftime(ts, '%b %-d, %Y, %-I:%M:%S %p') AS full_time
    FROM (SELECT event_id, ts, floor(x / 60000.0)::BIGINT AS m, floor(x / 3600000.0)::BIGINT AS h, floor(x / 86400000.0)::BIGINT AS d
      FROM (SELECT event_id, ts, epoch_us({_AS_OF}) // 1000 - epoch_us(ts) // 1000 AS x FROM events))""",
)
def relative_times(spark, folder):
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        "event_id",
        X.relative_time("ts", as_of, suffix=True).alias("age"),
        X.full_date_time("ts").alias("full_time"),
    )


@query(
    "relative_dates_with_year",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 2001 THEN strftime(o_orderdate, '%b %-d') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS age
    FROM orders""",
)
def relative_dates_with_year(spark, folder):
    as_of = F.lit("2001-12-31").cast("timestamp_ntz")
    # All orders are older than a week by then.
    return table(spark, folder, "orders").select("o_orderkey", X.relative_time("o_orderdate", as_of, show_year=True).alias("age"))


@query("message_keys", "SELECT conv_id, turn, sha1(text) AS message_key FROM conversations")
def message_keys(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", X.message_key("text").alias("message_key")
    )


@query(
    "retryable_errors",
    """SELECT event_id, event_type IN ('click', 'view') AS ingest_retry, event_type IN ('click', 'purchase') AS event_retry FROM events""",
)
def retryable_errors(spark, folder):
    message = (
        F.when(F.col("event_type") == "click", "Connection reset")
        .when(F.col("event_type") == "view", "Temporary outage")
        .when(F.col("event_type") == "purchase", "getaddrinfo ENOTFOUND host")
        .when(F.col("event_type") == "signup", "validation failed")
    )
    return table(spark, folder, "events").select(
        "event_id",
        X.is_retryable(message).alias("ingest_retry"),
        X.is_retryable(message, X.EVENT_RETRY_WORDS).alias("event_retry"),
    )


@query(
    "post_urls",
    """SELECT event_id, 'https://bsky.app/profile/user' || user_id || '/post/' || CASE WHEN event_type = 'error' THEN '' ELSE 'r' || event_id END AS url,
      'https://bsky.app/profile/user' || user_id || CASE WHEN event_type = 'error' THEN '' ELSE '/post/r' || event_id END AS url_or_profile FROM events""",
)
def post_urls(spark, folder):
    uri = F.concat(
        F.lit("at://did/app.bsky.feed.post/"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("r"), F.col("event_id"))),
    )
    author = F.concat(F.lit("user"), F.col("user_id"))
    return table(spark, folder, "events").select(
        "event_id",
        X.post_url(author, uri).alias("url"),
        X.post_url(author, uri, fallback=True).alias("url_or_profile"),
    )

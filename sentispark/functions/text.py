"""Text, URL and time formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentispark.functions.numeric import epoch_ms

_SPACE = r"[\s\x{feff}\p{Z}]+"


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_space(text: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_as_column(text), rf"^{_SPACE}|{_SPACE}$", "")


def truncate_for_model(text: Column | str, limit: int = 500) -> Column:
    text = _as_column(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(
        text
    )


def truncate_text(text: Column | str, limit: int) -> Column:
    text = _as_column(text)
    return F.when(
        F.length(text) > limit, F.concat(trim_space(F.substring(text, 1, limit)), F.lit("..."))
    ).otherwise(text)


def strip_html(text: Column | str) -> Column:
    """Text of a fragment: script and style bodies, comments and tags removed.

    Meant for reading, not for protecting a browser: entities stay as they are.
    """
    text = F.regexp_replace(_as_column(text), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(text, r"<[/!]?[A-Za-z][^>]*>", "")


def safe_url(url: Column | str) -> Column:
    """http(s) and relative URLs pass; ``//host`` and every other scheme become ''."""
    url = _as_column(url)
    # A browser's URL parser drops outer controls and inner tabs and line ends first.
    cleaned = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    scheme = F.lower(F.regexp_extract(cleaned, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return (
        F.when(url.startswith("//"), "")
        .when(scheme.isin("", "http", "https"), url)
        .otherwise("")
    )


def log_safe(text: Column | str, limit: int = 100) -> Column:
    text = F.regexp_replace(_as_column(text), r"[\r\n\t]", " ")
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
    return F.substring(trim_space(text), 1, limit)


def full_date_time(ts: Column | str) -> Column:
    return F.date_format(_as_column(ts), "MMM d, yyyy, h:mm:ss a")


def relative_time(
    ts: Column | str, as_of: Column, suffix: bool = False, show_year: bool = False
) -> Column:
    """``just now`` / minutes / hours / days / date, seen from ``as_of``."""
    ts = _as_column(ts)
    diff = epoch_ms(as_of) - epoch_ms(ts)
    minutes = F.floor(diff / F.lit(60_000))
    hours = F.floor(diff / F.lit(3_600_000))
    days = F.floor(diff / F.lit(86_400_000))
    ago = F.lit(" ago" if suffix else "")
    date = F.date_format(ts, "MMM d")
    if show_year:
        date = F.when(F.year(ts) != F.year(as_of), F.date_format(ts, "MMM d, yyyy")).otherwise(date)
    return (
        F.when(ts.isNull(), F.lit(None))
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), ago))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h"), ago))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d"), ago))
        .otherwise(date)
    )


def message_key(content: Column | str) -> Column:
    return F.sha1(_as_column(content))


# Message parts that mark an error as worth a retry, per consumer.
INGEST_RETRY_WORDS = ("timeout", "connection", "econnrefused", "temporary")
EVENT_RETRY_WORDS = ("timeout", "connection", "econnrefused", "enotfound")


def is_retryable(error: Column | str, words: tuple[str, ...] = INGEST_RETRY_WORDS) -> Column:
    return F.coalesce(F.lower(_as_column(error)).rlike("(" + "|".join(words) + ")"), F.lit(False))


def post_url(author: Column, uri: Column, fallback: bool = False) -> Column:
    """Web address of a post; with ``fallback``, the profile when the post key is empty."""
    rkey = F.element_at(F.split(uri, "/"), -1)
    profile = F.concat(F.lit("https://bsky.app/profile/"), author)
    full = F.concat(profile, F.lit("/post/"), rkey)
    return F.when(rkey == "", profile).otherwise(full) if fallback else full

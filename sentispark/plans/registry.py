"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentispark.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same rows from the same tables."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(use_utc(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_SCORED = """
scored_{name} AS (
  SELECT *, CASE WHEN abs(s) < 0.6 THEN 'neutral' WHEN s > 0 THEN 'positive' ELSE 'negative' END AS label,
         CAST(round(s * 1e8) AS BIGINT) AS u,
         epoch_us(published_at) // 1000 AS pub_ms, epoch_us(analyzed_at) // 1000 AS ana_ms
  FROM (
    SELECT CAST(event_id AS VARCHAR) AS id, CAST({job} AS VARCHAR) AS job_id,
           greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), (value - 50) / 50)) AS s,
           ts AS published_at, ts + INTERVAL 90 SECOND AS analyzed_at, event_id AS seq,
           user_id, event_type, props, value,
           'user' || user_id AS author_name, event_type || ' ' || props AS text_content,
           'https://bsky.app/profile/' || user_id || '/post/' || event_id AS source_url
    FROM events))
"""
BY_TYPE = _SCORED.format(name="t", job="event_type")
BY_USER = _SCORED.format(name="u", job="user_id")

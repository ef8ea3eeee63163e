"""Author handles and job existence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.functions.numeric import round_half_up
from sentispark.scale import join_per_key
from sentispark.session import materialize


def distinct_authors(posts: DataFrame, did: str = "did") -> DataFrame:
    return posts.select(did).distinct()


def attach_handles(posts: DataFrame, handles: DataFrame) -> DataFrame:
    """Fill ``handle`` from a (did, handle) table; the did stands in for an unknown one.

    The handle table is broadcast if it measures small; otherwise the join is salted, as one
    very active author may have written a third of the posts. Of several handles of a did the
    first in order counts, so a repeated did never multiplies posts.
    """
    known = _one_per_did(handles, "_handle")
    return join_per_key(posts, known, "did", "left").select(
        *[
            F.coalesce("handle", "_handle", "did").alias("handle") if c == "handle" else c
            for c in posts.columns
        ]
    )


def _one_per_did(handles: DataFrame, name: str) -> DataFrame:
    return handles.groupBy("did").agg(F.min("handle").alias(name))


def resolve_unique(dids: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Handle of every distinct id: from the cached table, else from the fresh one, else null.

    The inputs are made distinct first, so the joins see every id once however often it occurs.
    """
    unique = dids.select("did").distinct()
    valid = F.coalesce(F.col("did").startswith("did:"), F.lit(False))
    found_cached = _one_per_did(cached, "_cached").withColumn("_hit", F.lit(True))
    found_fresh = _one_per_did(fresh, "_fresh")
    hit = valid & F.coalesce("_hit", F.lit(False))
    return (
        unique.join(found_cached, "did", "left")
        .join(found_fresh, "did", "left")
        .select(
            "did",
            F.when(hit, F.col("_cached")).when(valid, F.col("_fresh")).alias("handle"),
            hit.alias("from_cache"),
            valid.alias("valid"),
        )
    )


def resolve_handles(dids: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """One output row per input row: handle (null when unknown or malformed) and cache flag."""
    resolved = materialize(
        resolve_unique(dids, cached, fresh).filter(F.col("did").isNotNull()).drop("valid")
    )
    return join_per_key(dids, resolved, "did", "left").fillna(False, ["from_cache"])


def lookup_coverage(resolved: DataFrame) -> DataFrame:
    """Requests, hits, misses, failures and hit rate over ``resolve_unique`` rows."""
    requests = F.count(F.lit(1))
    hits = F.count_if("from_cache")
    return resolved.agg(
        requests.alias("total_requests"),
        hits.alias("cache_hits"),
        F.count_if(F.col("valid") & ~F.col("from_cache")).alias("cache_misses"),
        F.count_if(F.col("valid") & ~F.col("from_cache") & F.col("handle").isNull()).alias("failures"),
        F.when(requests > 0, round_half_up(hits / requests * F.lit(1000.0)) / F.lit(1000.0))
        .otherwise(F.lit(0.0))
        .alias("hit_rate"),
    )


def of_known_jobs(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    return join_per_key(messages, jobs.select("job_id"), "job_id", "left_semi")


def orphans(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    return join_per_key(messages, jobs.select("job_id"), "job_id", "left_anti")

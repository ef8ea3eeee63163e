"""Row checks: every one adds a ``reason``, null when the row is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentispark.schemas import JOB_STATUSES, LABELS

FAR_FUTURE_YEARS = 10


def _empty(name: str) -> Column:
    column = F.col(name)
    return column.isNull() | (F.length(column) == 0)


def check_required(df: DataFrame, texts: list[str], values: list[str] = ()) -> DataFrame:
    """``texts`` must be non-empty, ``values`` only present."""
    reason = F.lit(None).cast("string")
    for name in reversed([*texts, *values]):
        missing = F.col(name).isNull() if name in values else _empty(name)
        reason = F.when(missing, f"missing {name}").otherwise(reason)
    return df.withColumn("reason", reason)


def check_raw_records(df: DataFrame) -> DataFrame:
    return check_required(df, ["job_id", "text_content"])


def check_ingestion_complete(df: DataFrame) -> DataFrame:
    return check_required(df, ["job_id"], ["total_items"])


def check_job_start(df: DataFrame) -> DataFrame:
    return check_required(df, ["job_id", "prompt"])


def check_prompts(df: DataFrame, low: int = 3, high: int = 500) -> DataFrame:
    size = F.length("prompt")
    return df.withColumn(
        "reason",
        F.when(_empty("prompt"), "prompt empty")
        .when(size < low, "prompt too short")
        .when(size > high, "prompt too long"),
    )


def check_dates(
    df: DataFrame,
    as_of: Column,
    years: int = FAR_FUTURE_YEARS,
    columns: tuple[str, ...] = ("published_at", "collected_at"),
) -> DataFrame:
    """Dates that do not parse, or lie more than ``years`` of 365 days ahead, are rejected.

    Text dates are parsed into the column; a missing date counts as unparsable.
    """
    limit = as_of.cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(years * 365))
    parsed = {
        c: (
            F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
            if dict(df.dtypes)[c] == "string"
            else F.col(c).cast("timestamp_ntz")
        )
        for c in columns
    }
    df = df.withColumns(parsed)
    reason = F.lit(None).cast("string")
    for c in reversed(columns):
        reason = (
            F.when(F.col(c).isNull(), f"invalid {c}")
            .when(F.col(c) > limit, f"{c} too far in the future")
            .otherwise(reason)
        )
    return df.withColumn("reason", reason)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNull()).drop("reason")


def check_results(rows: DataFrame) -> DataFrame:
    """Violations of the result contract, one row per rule.

    A required column that is not there is violated by every row; so is a required null value.
    """
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    rules = {
        "job_id is a uuid": ("job_id", lambda c: c.rlike(uuid)),
        "status is known": ("status", lambda c: c.isin(*JOB_STATUSES)),
        "label is known": ("sentiment_label", lambda c: c.isin(*LABELS)),
        "score within -1..1": ("sentiment_score", lambda c: c.between(-1, 1)),
        "average within -1..1": ("average_sentiment", lambda c: c.between(-1, 1)),
        "count is not negative": ("data_points_count", lambda c: c >= 0),
        "text present": ("text_content", lambda c: c.isNotNull()),
        "id present": ("id", lambda c: c.isNotNull()),
        "source present": ("source", lambda c: c.isNotNull()),
        "prompt present": ("prompt", lambda c: c.isNotNull()),
        "creation time present": ("created_at", lambda c: c.isNotNull()),
    }
    # Optional fields may be absent; all others must be there.
    optional = {"average_sentiment", "data_points_count"}
    counts, names = [], []
    for rule, (column, test) in rules.items():
        found = test(F.col(column)) if column in rows.columns else F.lit(None)
        ok = F.coalesce(found, F.lit(column in optional))
        counts.append(F.count_if(~ok))
        names.append(rule)
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), c.alias("violations")) for n, c in zip(names, counts)]
    )
    return rows.agg(pairs.alias("pairs")).select(F.inline("pairs"))

"""Numeric helpers shared by the aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are summed as whole units of 1e-8: finer than the 32-bit scores at rest, and the sum
# does not depend on the order in which tasks finish. The units are decimals, whose sums have ten digits
# more: a 64-bit sum would overflow at 9e10 rows of one key.
SCORE_UNIT = 1e8


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round_half_up(value: Column) -> Column:
    """Round halves towards plus infinity (-2.5 -> -2)."""
    return F.floor(value + F.lit(0.5))


def clamp(value: Column | str, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _as_column(value)))


def score_units(score: Column | str) -> Column:
    return F.round(_as_column(score).cast("double") * F.lit(SCORE_UNIT)).cast("long").cast("decimal(18,0)")


def units_mean(total_units: Column, count: Column) -> Column:
    return F.when(count > 0, total_units.cast("double") / F.lit(SCORE_UNIT) / count)


def mean_score(score: Column | str, where: Column | None = None) -> Column:
    """Average score as an aggregate; null when no row qualifies."""
    units = score_units(score)
    if where is not None:
        units = F.when(where, units)
    return F.sum(units).cast("double") / F.lit(SCORE_UNIT) / F.count(units)


def epoch_ms(ts: Column | str) -> Column:
    return F.unix_millis(_as_column(ts).cast("timestamp"))


def percent_of(part: Column, total: Column) -> Column:
    return F.when(total > 0, round_half_up(part / total * F.lit(100.0))).otherwise(F.lit(0)).cast("long")
